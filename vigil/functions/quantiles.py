"""Exact percentiles by distributed selection.

``F.percentile`` and ``F.median`` gather every distinct value of a column in
one task.  Here a sketch (bounded in size, merged like any partial aggregate)
brackets each wanted rank, one pass counts the values around the bracket, and
only the few values inside are sorted.  All ranks of a column share its sketch,
a value is placed among all their brackets at once.  Where a bracket still holds too many,
the selection goes on inside it, so no task and no driver ever holds more than
``MAX_INSIDE`` values for a rank.  Ends of a bracket are values of the column,
and equal values are counted at its ends: columns of few distinct values are
settled by the counts alone.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch (rank error of one in so many) and values of a bracket that are fetched.
ACCURACY, MAX_INSIDE = 10_000, 10_000


@dataclass
class _Rank:
    """The ``rank``-th (from 0) of the ``n`` values of a column strictly between two others (None: no bound)."""

    column: int
    asked: int
    rank: int
    n: int
    low: float | None = None
    high: float | None = None

    def value(self, names: list[str]) -> Column:
        """The column where it lies in the range, else null.  NaN is the largest value, as in an ordering."""
        x = F.col(names[self.column])
        if self.low is not None:
            x = F.when(x > F.lit(self.low), x)
        return x if self.high is None else F.when(F.col(names[self.column]) < F.lit(self.high), x)

    def range(self) -> tuple:
        return self.column, self.low, self.high


def _less(a: np.ndarray, b: float) -> np.ndarray:
    """a < b where NaN is the largest value."""
    return ~np.isnan(a) if math.isnan(b) else a < b


def _strictly_between(v: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """The sorted ones of ``v`` in a range."""
    if low is not None:
        v = v[~_less(v, low) & ~((v == low) | (np.isnan(v) & math.isnan(low)))]
    return np.sort(v if high is None else v[_less(v, high)])


def _long(values: DataFrame, columns: list[tuple[int, Column]], kind: str) -> DataFrame:
    """(j, v): one row for every column that is not null in a row; ``columns``: (j, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), v.cast(kind).alias("v")) for j, v in columns])).alias("p")
    return values.select(pairs).select("p.j", "p.v").where(F.col("v").isNotNull())


def _fetch(values: DataFrame, names: list[str], ranks: list[_Rank]) -> dict[tuple, np.ndarray]:
    """The sorted values of every range that ``ranks`` lie in; a value that several ranges of a column hold comes once."""
    ranges = {r.range(): r for r in ranks}
    wanted: dict[int, Column] = {}
    for r in ranges.values():
        inside = r.value(names).isNotNull()
        wanted[r.column] = wanted[r.column] | inside if r.column in wanted else inside
    some = values.where(functools.reduce(Column.__or__, wanted.values()))
    got = _long(some, [(i, F.when(c, F.col(names[i]))) for i, c in wanted.items()], "double").toArrow()
    j, v = got["j"].to_numpy(), got["v"].to_numpy()
    return {(i, low, high): _strictly_between(v[j == i], low, high) for i, low, high in ranges}


def _counts(values: DataFrame, edges: list[tuple[Column, list[float]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (value, its ascending edges): how many values lie below each edge, and how many on it."""
    places = []
    for j, (x, ends) in enumerate(edges):
        # A place is even between edges and odd on one.  Arrays keep the generated code small, whatever their length.
        known = F.array(*[F.lit(float(e)) for e in ends])
        place = 2 * F.size(F.filter(known, lambda e: e < x)) + F.array_contains(known, x).cast("int")   # noqa: B023
        places.append((j, F.when(x.isNotNull(), place)))
    n = [np.zeros(2 * len(ends) + 1, dtype=np.int64) for _, ends in edges]
    for r in _long(values, places, "int").groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["j"]][r["v"]] = r["n"]
    return [((np.cumsum(c) - c)[1::2], c[1::2]) for c in n]


def _narrowed(values: DataFrame, names: list[str], ranks: list[_Rank], accuracy: int) -> tuple[list[_Rank], list[tuple[_Rank, float]]]:
    """(ranks that still lie in a range, ranks that are settled) after one sketch of every range and one count."""
    ranges: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        ranges.setdefault(r.range(), []).append(r)
    sketches = []
    for i, group in enumerate(ranges.values()):
        shares = [min(max((r.rank + 0.5) / r.n + e / accuracy, 0.0), 1.0) for r in group for e in (-2, 2)]
        sketches.append(F.percentile_approx(group[0].value(names), shares, accuracy).alias(f"s{i}"))
    found = [list(s) for s in values.agg(*sketches).first()]
    same = lambda x: None if math.isnan(x) else x
    ends = [sorted({same(x): x for x in e}.values(), key=lambda x: (math.isnan(x), x)) for e in found]
    counts = _counts(values, [(group[0].value(names), e) for group, e in zip(ranges.values(), ends)])
    left, settled = [], []
    for group, edges, known, (less, on) in zip(ranges.values(), found, ends, counts):
        place = {same(x): i for i, x in enumerate(known)}
        for at, r in enumerate(group):
            a, b = edges[2 * at:2 * at + 2]
            ia, ib = place[same(a)], place[same(b)]
            below, to_b = int(less[ia]), int(less[ib])             # values below a, below b
            upto_a, upto_b = below + int(on[ia]), to_b + int(on[ib])
            if r.rank < below:
                left.append(_Rank(r.column, r.asked, r.rank, below, r.low, a))
            elif r.rank < upto_a:
                settled.append((r, a))
            elif r.rank < to_b:
                left.append(_Rank(r.column, r.asked, r.rank - upto_a, to_b - upto_a, a, b))
            elif r.rank < upto_b:
                settled.append((r, b))
            else:
                left.append(_Rank(r.column, r.asked, r.rank - upto_b, r.n - upto_b, b, r.high))
    return left, settled


def _select(values: DataFrame, names: list[str], sizes: list[int], ranks: list[set[int]], accuracy: int,
            max_inside: int) -> dict[tuple[int, int], float]:
    """(column, rank) -> value for the asked ranks (from 0) of every column."""
    todo = [_Rank(i, rank, rank, n) for i, (n, asked) in enumerate(zip(sizes, ranks)) for rank in sorted(asked)]
    found: dict[tuple[int, int], float] = {}
    while todo:
        small = [r for r in todo if r.n <= max_inside]
        if small:
            inside = _fetch(values, names, small)
            found.update({(r.column, r.asked): float(inside[r.range()][r.rank]) for r in small})
        todo = [r for r in todo if r.n > max_inside]
        if todo:
            todo, settled = _narrowed(values, names, todo, accuracy)
            found.update({(r.column, r.asked): float(x) for r, x in settled})
    return found


def _sized(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[str], list[int]]:
    names = [f"v{i}" for i in range(len(columns))]
    values = df.select(*[c.cast("double").alias(n) for n, c in zip(names, columns.values())])
    return values, names, list(values.agg(*[F.count(n).alias(n) for n in names]).first())


def smallest(df: DataFrame, columns: dict[str, Column], share: float, accuracy: int = ACCURACY,
             max_inside: int = MAX_INSIDE) -> dict[str, tuple[int, float | None]]:
    """For every column, how many of its values make up ``share`` (rounded) and the largest of these smallest values."""
    values, names, sizes = _sized(df, columns)
    counts = [math.floor(share * n + 0.5) for n in sizes]
    found = _select(values, names, sizes, [{m - 1} if m else set() for m in counts], accuracy, max_inside)
    return {name: (m, found.get((i, m - 1))) for i, (name, m) in enumerate(zip(columns, counts))}


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float], accuracy: int = ACCURACY,
                max_inside: int = MAX_INSIDE) -> dict[str, list[float | None]]:
    """Linear percentiles of every column, exact, nulls left out; None for a column without values.

    ``df`` is read a few times: hand it over cut or persisted where it is costly.
    """
    values, names, sizes = _sized(df, columns)
    ends = lambda s, n: (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))
    found = _select(values, names, sizes, [{e for s in shares for e in ends(s, n)} if n else set() for n in sizes], accuracy, max_inside)

    def linear(i: int, share: float) -> float:
        low, high = ends(share, sizes[i])
        at, a, b = share * (sizes[i] - 1), found[i, low], found[i, high]
        return a if low == high or a == b else (high - at) * a + (at - low) * b

    return {name: [linear(i, s) if sizes[i] else None for s in shares] for i, name in enumerate(columns)}


def percentile(df: DataFrame, column: Column, share: float) -> float | None:
    """One exact linear percentile of one column."""
    return percentiles(df, {"x": column}, [share])["x"][0]
