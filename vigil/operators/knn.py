"""Exact k-nearest neighbours (Euclidean, exactly k, ties broken by
neighbour id) over a metric partition, for any number and spread of points.

Equal points are collapsed first: of each distinct vector only its few
smallest ids can be anybody's neighbour, so half of all points in one place
cost one point.  Distinct vectors are dealt into cells by their nearest pivot
(pivots are data points drawn by a hash; cells that are too large get more
pivots, and parts by hash where the bound on pivots is reached).  Then

1. each query is measured against its own cell, which bounds the distance of
   its k-th neighbour from above;
2. it goes on only to cells whose points can lie within that bound: by the
   triangle inequality over the cell's nearest and farthest point from its
   pivot, and by the plane half-way between two pivots;
3. inside a cell it meets only points whose distance from the pivot fits;
4. the candidates of its cells are merged to the k smallest.

What a cell's queries can reach at all is settled once for them together, by the
distances between pivots, before single queries are looked at; so is which
pivots there are, on a part of the points (where cells lie steers cost, not results).

Cells that lie together form a block of up to ``BLOCK_ROWS`` points.  A query is
sent to a block once, however many of its cells it must look into (those are
marked by a bit each): where bounds rule little out, as in many dimensions, rows
sent grow with the blocks and not with the cells.  A task holds one block and a
bounded number of queries, and keeps k neighbours of each; the pivots and one
row per cell are broadcast (``MAX_PIVOTS`` bounds them).  Bounds carry a margin
above floating error and above the width of a tie, so nothing is lost.

Inside, points are known by numbers in the order of their ids, so that nothing
but the last join carries text.

Rows without an id or vector, or with a null or NaN coordinate, are no points.
Ids must be unique; vectors must be of one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import cut_lineage

# Comparison key: distances and scores are compared on a grid of about 11
# significant digits (1e-9 below 100, coarser by 100× per two decades), then
# by id.  Mathematically equal values (common on discrete features) then tie
# deterministically no matter how a platform orders a floating-point sum.  The
# key is the value on its grid, so that keys of different grids compare too.
# Fixed ladder of (upper bound, grid) pairs; the SQL twin uses the same values.
RANK_LADDER = [(1e2, 1e-9), (1e4, 1e-7), (1e6, 1e-5), (1e8, 1e-3), (1e10, 1e-1), (1e12, 1e1)]

#: Most distinct points of a cell; most of a block.
CELL_ROWS, BLOCK_ROWS = 2048, 65536
#: Most queries whose bounds one task takes from their cell.
TASK_QUERIES = 16384
#: Bytes of the vectors of a block, and blocks that small inputs are dealt into at least.
BLOCK_BYTES, MIN_BLOCKS = 32 << 20, 4
#: Parts in which a block meets as many queries as it has points; every part gets a copy of the block, every block one of a
#: query, so that what is sent grows with the sum of blocks and parts, and tasks with their product.
PARTS = 1.5
#: Neighbours found in a task until they are cut to the k nearest.
MERGE_AT = 1 << 21
#: Most pivots (they are broadcast), and rounds in which large cells get more of them.
MAX_PIVOTS, SPLIT_ROUNDS = 20_000, 4
#: Points, at about, by which the sizes of cells are judged while pivots are chosen; nearest cells that bound a query's k-th
#: distance where its own holds fewer than k points.
SIZED_ROWS, NEAR_CELLS = 1 << 18, 64
#: A vector with more than one in this many points is joined by broadcast.
HEAVY = 1000
#: Rows of a distance matrix that are computed at a time.
CHUNK = 512
#: Parts of one pivot's cell in a cell number.
_PARTS = 1 << 20
#: Cell numbers are below this.
_SOURCES = 1 << 40

NEAR = "array<struct<key: double, nbr: {0}, dist: double, of: {0}>>"
ROUTES = "source long, block long, cell long, n long, ids array<{0}>, vecs binary, bounds array<double>, hits binary"
CELLS = "cell long, radius binary, vecs binary, ids array<array<{0}>>"


def rank_key(d):
    d = np.asarray(d, dtype=np.float64)
    ad = np.abs(d)
    out = d.copy()
    done = np.zeros(d.shape, dtype=bool)
    for bound, g in RANK_LADDER:
        sel = (~done) & (ad < bound)
        inv = 1.0 / g if g < 1 else None
        out[sel] = np.floor(d[sel] * inv + 0.5) / inv if inv else np.floor(d[sel] / g + 0.5) * g
        done |= sel
    return out


def rank_key_col(c):
    """Spark twin of ``rank_key`` (same operations; one floor per arm kind)."""
    ax = F.abs(c)
    inv = None
    div = None
    for bound, g in RANK_LADDER:
        if g < 1:
            inv = F.when(ax < F.lit(bound), F.lit(1.0 / g)) if inv is None else inv.when(ax < F.lit(bound), F.lit(1.0 / g))
        else:
            div = F.when(ax < F.lit(bound), F.lit(g)) if div is None else div.when(ax < F.lit(bound), F.lit(g))
    last_inv = max(b for b, g in RANK_LADDER if g < 1)
    last = max(b for b, _ in RANK_LADDER)
    return (F.when(ax < F.lit(last_inv), F.floor(c * inv + F.lit(0.5)).cast("double") / inv)
             .when(ax < F.lit(last), F.floor(c / div + F.lit(0.5)).cast("double") * div)
             .otherwise(c.cast("double")))


def to_vectors(df: DataFrame, id_col: str, feature_cols: list[str] | None = None,
               vector_col: str | None = None) -> DataFrame:
    """(id string, vec array<double>) from feature columns or an array column."""
    if vector_col is not None:
        vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    else:
        vec = F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols])
    return df.select(F.col(id_col).cast("string").alias("id"), vec.alias("vec"))


# ------------------------------------------------------------ distances
def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by |a|² + |b|² − 2ab, and a bound of their error per
    row that also covers the width of a tie."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d2 = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    np.maximum(d2, 0.0, out=d2)
    return d2, 1e-8 * (1.0 + aa + (bb.max() if len(bb) else 0.0))


def _kth(d2: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Upper bound of each row's k-th smallest distance."""
    return np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1] + error) * (1 + 1e-8) + 1e-8


def _vectors(column, rows: int) -> np.ndarray:
    """A list column (or several) as one matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, -1)


def _packed(x: np.ndarray) -> bytes:
    """The values' bytes: four a value where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _unpacked(raw: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * rows * dims else np.float64).astype(np.float64).reshape(rows, dims)


def _packed_cells(base: DataFrame) -> DataFrame:
    """Cells (cell, points) with the points' radii and vectors as bytes."""
    kind = base.schema["points"].dataType.elementType["id"].dataType.simpleString()
    at, number = base.columns.index("points"), base.columns.index("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(at)
                points, n = lists.flatten(), pa.compute.list_value_length(lists).to_numpy()
                vecs, radius = _vectors(points.field("vec"), len(points)), points.field("radius").to_numpy(zero_copy_only=False)
                ends = np.cumsum(n)
                parts = [slice(end - rows, end) for end, rows in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(number), pa.array([radius[x].tobytes() for x in parts], pa.binary()),
                     pa.array([_packed(vecs[x]) for x in parts], pa.binary()), _lists(points.field("ids"), n)],
                    names=["cell", "radius", "vecs", "ids"])

    return base.mapInArrow(run, CELLS.format(kind))


class _Points:
    """The points of the packed cells of a table, each cell's by their distance from its pivot."""

    def __init__(self, table: pa.Table, dims: int):
        lists = table.column("ids").combine_chunks()
        rows = pa.compute.list_value_length(lists).to_numpy()
        self.cells = table.column("cell").to_numpy()
        self.ends = np.cumsum(rows)
        self.radius = np.frombuffer(b"".join(table.column("radius").to_pylist()))
        self.vecs = np.concatenate([_unpacked(x, n, dims) for x, n in zip(table.column("vecs").to_pylist(), rows.tolist())])
        names = lists.flatten()
        self.counts = np.diff(names.offsets.to_numpy())
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.names = names.flatten()
        self.rank = self._rank(self.names)

    @staticmethod
    def _rank(names: pa.Array) -> np.ndarray:
        if pa.types.is_integer(names.type):
            return names.to_numpy(zero_copy_only=False)
        out = np.empty(len(names), dtype=np.int64)
        out[np.argsort(np.asarray(names.to_pylist(), dtype=object), kind="stable")] = np.arange(len(names))
        return out

    def nearest(self, i: int, q: np.ndarray, bounds: np.ndarray, to_pivot: np.ndarray, k: int) -> Iterator[tuple]:
        """(rows, keys, places of names, distances, points) of up to k neighbours in the i-th cell of each query
        within its bound, in parts."""
        order = np.argsort(to_pivot, kind="stable")
        start, end = (self.ends[i - 1] if i else 0), self.ends[i]
        radius = self.radius[start:end]
        for at in range(0, len(q), CHUNK):
            rows = order[at:at + CHUNK]
            far = bounds[rows].max()
            lo = start + np.searchsorted(radius, (to_pivot[rows].min() - far) * (1 - 1e-9) - 1e-6)
            hi = start + np.searchsorted(radius, (to_pivot[rows].max() + far) * (1 + 1e-9) + 1e-6, side="right")
            if lo >= hi:
                continue
            some = self.vecs[lo:hi]
            d2, error = _squared(q[rows], some)
            r, c = np.nonzero(d2 <= (bounds[rows] ** 2 + error)[:, None])
            if not len(r):
                continue
            diff = q[rows[r]] - some[c]
            dist = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            key, c = rank_key(dist), c + lo
            # Of the points at one distance, those with the smallest ids hold the k smallest ids of that distance.
            r, c, key, dist = _first_k(r, (self.rank[self.starts[c]], key), k, c, key, dist)
            n = self.counts[c]
            name = np.repeat(self.starts[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            r, key, dist, c = np.repeat(r, n), np.repeat(key, n), np.repeat(dist, n), np.repeat(c, n)
            r, name, key, dist, c = _first_k(r, (self.rank[name], key), k, name, key, dist, c)
            yield rows[r], key, name, dist, c


def _first_k(rows: np.ndarray, by: tuple, k: int, *arrays: np.ndarray) -> tuple:
    """Rows and arrays in the order of (row, last of ``by``, ..., first), the first k of each row."""
    order = np.lexsort((*by, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return (rows[keep], *(a[order][keep] for a in arrays))


# ------------------------------------------------------------ cells
class _Pivots:
    """Pivots and what is known of every cell: pivot, points, smallest and largest radius."""

    def __init__(self, vecs: np.ndarray, parts: np.ndarray):
        self.vecs, self.parts = vecs, parts
        self.apart = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of every row and the exact distance from it."""
        best = np.empty(len(x), dtype=np.int64)
        # |x - p|² less |x|²: what a row's distances share does not tell which is least.
        twice, own = -2.0 * self.vecs.T, np.einsum("ij,ij->i", self.vecs, self.vecs)
        for at in range(0, len(x), CHUNK):
            d2 = x[at:at + CHUNK] @ twice
            d2 += own
            best[at:at + CHUNK] = d2.argmin(axis=1)
        diff = x - self.vecs[best]
        return best, np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """The place of every row in an order that halves the rows at the median of their widest dimension, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= 1:
            out.append(rows)
            continue
        some = x[rows]
        rows = rows[np.argsort(some[:, (some.max(axis=0) - some.min(axis=0)).argmax()], kind="stable")]
        todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    place = np.empty(len(x), dtype=np.int64)
    place[np.concatenate(out)] = np.arange(len(x))
    return place


class _Cells:
    """Broadcast summary: pivots and, per cell, its number, pivot, points, radii and block."""

    def __init__(self, pivots: _Pivots, number: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.number, self.n, self.low, self.high = pivots, number, n, low, high
        self.pivot = number // _PARTS
        most = max(CELL_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (8 * pivots.vecs.shape[1] + 1)))
        self.block_rows = min(most, max(CELL_ROWS, math.ceil(n.sum() / MIN_BLOCKS)))
        order = np.lexsort((number, _side_by_side(pivots.vecs)[self.pivot]))
        self.block = np.empty(len(number), dtype=np.int64)
        self.block[order] = (np.cumsum(n[order]) - n[order]) // self.block_rows

    def within_reach(self, q: np.ndarray, own: int, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cells that can hold a neighbour) parts of queries that lie with one pivot, ``own``."""
        p = self.pivots.vecs
        diff = q - p[own]
        radius = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        apart, wide = _squared(p[own:own + 1], p)
        apart, wide = np.sqrt(apart[0]), 4 * math.sqrt(wide[0]) + 1e-6
        order = np.argsort(radius + bounds, kind="stable")
        for at in range(0, len(q), CHUNK):
            rows = order[at:at + CHUNK]
            x, bound = q[rows], bounds[rows]
            # No query here reaches past ``far`` from the pivot: neither cells that begin beyond it, nor those beyond planes.
            far = (radius[rows] + bound).max() * (1 + 1e-6) + wide
            some = np.flatnonzero((apart[self.pivot] - self.high <= far) & (apart[self.pivot] <= 2 * far))
            pivots, at_pivot = np.unique(self.pivot[some], return_inverse=True)
            d2, error = _squared(x, p[pivots])
            d = np.sqrt(d2)
            slack = np.sqrt(error)[:, None]                   # error of a root of a squared distance
            least = np.maximum(d[:, at_pivot] - self.high[some], self.low[some] - d[:, at_pivot]) - slack
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d2 - (radius[rows] ** 2)[:, None] - 4 * error[:, None]) / (2 * (apart[pivots] + slack))
            np.maximum(least, plane[:, at_pivot], out=least)
            row, cell = np.nonzero(least <= bound[:, None] * (1 + 1e-9) + 1e-8)
            yield rows[row], some[cell]

    def fallback(self, q: np.ndarray, own: int, k: int) -> np.ndarray:
        """Upper bound of the k-th distance of queries that lie with one pivot from the cells' sizes and radii alone; infinite
        with fewer than k points."""
        p = self.pivots.vecs
        apart, error = _squared(p[own:own + 1], p)
        order = np.argsort(np.sqrt(apart[0] + error[0])[self.pivot] + self.high, kind="stable")
        order = order[:max(NEAR_CELLS, int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1)]
        out = np.full(len(q), np.inf)
        for at in range(0, len(q), CHUNK):
            d2, error = _squared(q[at:at + CHUNK], p[self.pivot[order]])
            reach = np.sqrt(d2 + error[:, None]) + self.high[order]
            by = np.argsort(reach, axis=1)
            have = np.cumsum(self.n[order][by], axis=1) >= k
            found = have.any(axis=1)
            at_k = by[np.arange(len(reach)), have.argmax(axis=1)]
            out[at:at + CHUNK][found] = reach[np.arange(len(reach)), at_k][found] * (1 + 1e-8) + 1e-8
        return out


def _dealt(points: DataFrame, pivots: _Pivots) -> DataFrame:
    """``points`` (id, vec, ...) with the number of their pivot and the distance from it."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    schema = points.select("*", F.lit(0).cast("long").alias("pivot"), F.lit(0.0).alias("radius")).schema
    at = points.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, radius = shared.value.nearest(_vectors(batch.column(at), batch.num_rows))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(radius)],
                                                 names=[*batch.schema.names, "pivot", "radius"])

    return points.mapInArrow(run, schema)


def _in_cells(dealt: DataFrame, pivots: _Pivots) -> DataFrame:
    """Points that were dealt to pivots with the number of their cell: a pivot's only one, or that of their part by hash."""
    split = np.flatnonzero(pivots.parts > 1)
    if not len(split):
        return dealt.withColumn("cell", F.col("pivot") * _PARTS)
    parts = F.broadcast(dealt.sparkSession.createDataFrame(pa.table({"pivot": split.astype(np.int64), "_parts": pivots.parts[split]})))
    part = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1)))
    return dealt.join(parts, "pivot", "left").select(*dealt.columns, (F.col("pivot") * _PARTS + part).alias("cell"))


def _draw(points: DataFrame, n: int) -> list:
    """Vectors of ``n`` points drawn by a hash."""
    return [r["vec"] for r in points.orderBy(F.xxhash64("id"), "id").limit(n).select("vec").collect()]


def partition(points: DataFrame, n: int, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, _Cells]:
    """Distinct points (id, vec, ids) dealt into cells of at most about ``cell_rows``, and the summary of the cells.

    There are √n cells at least, so that a query meets few points in many small cells.  Pivots are chosen on a part of many
    points; all points are dealt once.
    """
    share = max(1, n // SIZED_ROWS)
    some = points.select("id", "vec")
    if share > 1:
        some = cut_lineage(some.where(F.pmod(F.xxhash64("id", F.lit(share)), F.lit(share)) == 0))
    vecs = _draw(some, min(max_pivots, max(1, math.ceil(math.sqrt(n)), math.ceil(2 * n / cell_rows)))) or _draw(points, 1)
    for at in range(SPLIT_ROUNDS):
        pivots = _Pivots(np.array(vecs, dtype=np.float64), np.ones(len(vecs), dtype=np.int64))
        room = max_pivots - len(vecs)
        if room <= 0 or at == SPLIT_ROUNDS - 1:
            break
        dealt = cut_lineage(_dealt(some, pivots))
        large = cut_lineage(dealt.groupBy("pivot").agg((F.count(F.lit(1)) * share).alias("n")).where(F.col("n") > cell_rows))
        if large.isEmpty():
            break
        by_hash = Window.partitionBy("pivot").orderBy(F.xxhash64("id"), "id")
        more = (dealt.join(F.broadcast(large), "pivot").withColumn("_r", F.row_number().over(by_hash))
                     .where(F.col("_r") <= F.least(F.ceil(2 * F.col("n") / cell_rows), F.lit(room))))
        vecs += [r["vec"] for r in more.orderBy("_r", "pivot").limit(room).select("vec").collect()]
    dealt = cut_lineage(_dealt(points, pivots))
    summed = lambda by: (_in_cells(dealt, pivots).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("low"),
                                                                  F.max("radius").alias("high")).orderBy(by).collect())
    rows = summed("cell")
    large = [r for r in rows if r["n"] > 2 * cell_rows]
    if large:
        pivots.parts[[r["cell"] // _PARTS for r in large]] = [math.ceil(r["n"] / cell_rows) for r in large]
        rows = summed("cell")
    numbers, n_of, low, high = (np.array([r[c] for r in rows]) for c in ("cell", "n", "low", "high"))
    return _in_cells(dealt, pivots), _Cells(pivots, numbers.astype(np.int64), n_of.astype(np.int64), low.astype(float), high.astype(float))


# ------------------------------------------------------------ search
def _lists(values, counts: np.ndarray):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def routes(queries: DataFrame | None, points: DataFrame, summary: _Cells, k: int) -> DataFrame:
    """One row for every cell that some query of a cell must look into: how many look there (n) and, as bits, which.

    Their ids, vectors and bounds of the k-th distance are on the first row of each (source cell, block).
    ``queries``: (id, vec, pivot, cell), distinct, None for the points themselves; ``points``: (id, vec, pivot, cell).
    """
    shared = points.sparkSession.sparkContext.broadcast(summary)
    asked = points if queries is None else queries
    kind = _id_type(asked)
    id_type = pa.int64() if kind == "bigint" else pa.string()
    schema = pa.schema([("source", pa.int64()), ("block", pa.int64()), ("cell", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(id_type)),
                        ("vecs", pa.binary()), ("bounds", pa.list_(pa.float64())), ("hits", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        out = []
        cells: _Cells = shared.value
        q = _vectors(left.column("vec"), left.num_rows)
        ids = left.column("id").combine_chunks()
        own = int(left.column("pivot")[0].as_py())                # a group's queries lie in one cell
        bounds = np.full(len(q), np.inf)
        if right.num_rows >= k:
            points = _vectors(right.column("vec"), right.num_rows)
            for at in range(0, len(q), CHUNK):
                bounds[at:at + CHUNK] = _kth(*_squared(q[at:at + CHUNK], points), k)
        else:
            bounds = cells.fallback(q, own, k)
        row, cell = (np.concatenate(x) for x in zip(*cells.within_reach(q, own, bounds)))
        order = np.lexsort((row, cell, cells.block[cell]))
        row, cell = row[order], cell[order]
        block = cells.block[cell]
        source = int(left.column("cell")[0].as_py())
        if "_part" in left.column_names:
            source += int(left.column("_part")[0].as_py()) * _SOURCES
        for of_block in np.split(np.arange(len(row)), np.flatnonzero(np.diff(block)) + 1) if len(row) else []:
            sent = np.unique(row[of_block])
            payload = [ids.take(pa.array(sent)), _packed(q[sent]), bounds[sent]]
            for one in np.split(of_block, np.flatnonzero(np.diff(cell[of_block])) + 1):
                hit = np.zeros(len(sent), dtype=bool)
                hit[np.searchsorted(sent, row[one])] = True
                out.append((source, int(block[one[0]]), int(cells.number[cell[one[0]]]), len(one), *payload, np.packbits(hit).tobytes()))
                payload = [None, None, None]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    if queries is None:
        return points.groupBy("cell").applyInArrow(lambda table: run(table, table), ROUTES.format(kind))
    # A cell that many queries lie in meets them in parts, each with a copy of its points.
    parts = (queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).cast("int").alias("_parts")))
    queries = queries.join(parts, "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    copies = points.select("cell", "vec").join(parts, "cell").select(
        "cell", "vec", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return (queries.select("id", "vec", "pivot", "cell", "_part").groupBy("cell", "_part").cogroup(copies.groupBy("cell", "_part"))
                   .applyInArrow(run, ROUTES.format(kind)))


def _candidates(found: DataFrame, base: DataFrame, summary: _Cells, k: int) -> DataFrame:
    """(id, near, home): the k nearest points of each block for every query routed to it; ``of`` is the id of the
    neighbour's vector, ``home`` the block that the query lies in."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(summary)
    kind = base.schema["points"].dataType.elementType["id"].dataType.simpleString()
    asked = found.schema["ids"].dataType.elementType.simpleString()
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    near_type = pa.list_(pa.struct([("key", pa.float64()), ("nbr", arrow[kind]), ("dist", pa.float64()), ("of", arrow[kind])]))
    schema = pa.schema([("id", arrow[asked]), ("near", near_type), ("home", pa.int64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        dims = shared.value.pivots.vecs.shape[1]
        points = _Points(right, dims)
        payload = left.filter(left.column("ids").is_valid())
        ids = payload.column("ids").combine_chunks()
        sizes = pa.compute.list_value_length(ids).to_numpy()
        ids = ids.flatten()
        cell_of = payload.column("source").to_numpy() % _SOURCES
        home = np.repeat(shared.value.block[np.searchsorted(shared.value.number, cell_of)], sizes)
        q = np.concatenate([np.zeros((0, dims)), *(_unpacked(x, n, dims) for x, n in zip(payload.column("vecs").to_pylist(), sizes.tolist()))])
        bounds = payload.column("bounds").combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()
        first = dict(zip(payload.column("source").to_pylist(), zip(np.cumsum(sizes) - sizes, sizes)))
        lookers: dict[int, list] = {}
        for source, cell, hits in zip(*(left.column(c).to_pylist() for c in ("source", "cell", "hits"))):
            at, n = first[source]
            lookers.setdefault(cell, []).append(at + np.flatnonzero(np.unpackbits(np.frombuffer(hits, np.uint8), count=n)))
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float, np.int64))
        new, size = [], 0

        def merge():
            """The k nearest of what was found so far; they bound what is left to find."""
            rows, name, sort, dist, point = (np.concatenate(x) for x in zip(kept, *new))
            rows, name, sort, dist, point = _first_k(rows, (points.rank[name], sort), k, name, sort, dist, point)
            last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, np.int64)
            full = last[np.diff(np.append(-1, last)) == k]
            bounds[rows[full]] = np.minimum(bounds[rows[full]], dist[full] * (1 + 1e-8) + 1e-8)
            return rows, name, sort, dist, point

        for i, cell in enumerate(points.cells.tolist()):
            if cell not in lookers:
                continue
            rows = np.concatenate(lookers.pop(cell))
            mine = q[rows]
            to_pivot = mine - shared.value.pivots.vecs[cell // _PARTS]
            to_pivot = np.sqrt(np.einsum("ij,ij->i", to_pivot, to_pivot))
            for at, sort, name, dist, point in points.nearest(i, mine, bounds[rows], to_pivot, k):
                new.append((rows[at], name, sort, dist, point))
                size += len(at)
            if size > MERGE_AT:
                kept, new, size = merge(), [], 0
        rows, name, sort, dist, point = merge()
        if not len(rows):
            return schema.empty_table()
        start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        near = pa.StructArray.from_arrays([pa.array(sort), points.names.take(pa.array(name)), pa.array(dist),
                                           points.names.take(pa.array(points.starts[point]))], names=["key", "nbr", "dist", "of"])
        return pa.table([ids.take(pa.array(rows[start])), _lists(near, np.diff(np.append(start, len(rows)))), pa.array(home[rows[start]])],
                        schema=schema)

    # A block meets its queries in parts.  There is one row per block.
    parts = (found.groupBy("block").agg(F.sum(F.size(F.coalesce("ids", F.array()))).alias("_n"))
                  .select("block", F.ceil(F.col("_n") * PARTS / summary.block_rows).cast("int").alias("_parts")))
    parts = F.broadcast(cut_lineage(parts))
    block = F.broadcast(spark.createDataFrame(pa.table({"cell": summary.number, "block": summary.block})))
    queries = found.join(parts, "block").withColumn("_part", F.pmod(F.xxhash64("source"), F.col("_parts")).cast("int")).drop("_parts")
    points = (_packed_cells(base).join(block, "cell").join(parts, "block")
                  .select(F.col("block").alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_copy"),
                          "cell", "radius", "vecs", "ids"))
    return (queries.groupBy("block", "_part").cogroup(points.groupBy("_block", "_copy"))
                   .applyInArrow(run, f"id {asked}, near {NEAR.format(kind)}, home long"))


def _is_point():
    return F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))


def distinct_points(points: DataFrame, keep: int) -> DataFrame:
    """(vec, id, ids): distinct vectors with their ``keep`` smallest ids, the first of which names them.

    The rank limit is applied before the shuffle too, so a vector that half of all rows hold is few rows there.
    """
    # Sorts compare the hash, and vectors only where it is equal.
    by_id = Window.partitionBy("_h", "vec").orderBy("id")
    return (points.where(_is_point()).withColumn("_h", F.xxhash64("vec")).withColumn("_r", F.row_number().over(by_id))
                  .where(F.col("_r") <= keep).groupBy("_h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                  .select(F.get("ids", F.lit(0)).alias("id"), "vec", "ids"))


def search_plan(queries: DataFrame | None, base: DataFrame, k: int, cell_rows: int = CELL_ROWS,
                max_pivots: int = MAX_PIVOTS) -> tuple[DataFrame, DataFrame, _Cells] | None:
    """Routes of distinct ``queries`` (those of ``base`` itself if None) and the cells of ``base``; None without points."""
    base = cut_lineage(base)
    n = base.count()
    if not n:
        return None
    dealt, summary = partition(base, n, cell_rows, max_pivots)
    asked = None if queries is None else _in_cells(_dealt(queries, summary.pivots), summary.pivots).select("id", "vec", "pivot", "cell")
    cells = cut_lineage(dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("radius", "id", "vec", "ids"))).alias("points")))
    found = cut_lineage(routes(asked, dealt.select("id", "vec", "pivot", "cell"), summary, k))
    return found, cells, summary


def _search(queries: DataFrame | None, base: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """(id of a distinct query, home, nbrs, dists, ofs): its k nearest in order.  The rows of one home lie together."""
    plan = search_plan(queries, base, k, cell_rows)
    if plan is None:
        return base.sparkSession.createDataFrame([], "id long, home long, nbrs array<long>, dists array<double>, ofs array<long>")
    found, cells, summary = plan
    fields = ["key", "nbr", "dist", "of"]
    # A list of structs takes half as much again as an array a field: it is sent as arrays.
    sent = _candidates(found, cells, summary, k).select("home", "id", *[F.col(f"near.{c}").alias(c) for c in fields]).repartition("home")
    # Most queries look into one block, whose list is in order as it is.
    parts = sent.groupBy("home", "id").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    zipped = F.transform("parts", lambda x: F.arrays_zip(*[x[c].alias(c) for c in fields]))
    merged = F.when(F.size("parts") > 1, F.slice(F.sort_array(F.flatten(zipped)), 1, k)).alias("near")
    return parts.select("id", "home", F.get("parts", F.lit(0)).alias("one"), merged).select(
        "id", "home", *[F.when(F.col("near").isNull(), F.col("one")[c]).otherwise(F.col("near")[c]).alias(f"{c}s") for c in fields[1:]])


def _numbered(points: DataFrame) -> DataFrame:
    """(id, vec, name) of the points: ``id`` is a number in the order of their names."""
    points = points.where(_is_point()).select(F.col("id").alias("name"), "vec")
    return cut_lineage(points.orderBy("name").withColumn("id", F.monotonically_increasing_id()))


def _members(points: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, name, of) of all points; ``of`` is the id of the point's vector."""
    by = ["_h", "vec"]                       # sorts compare the hash first
    points = points.withColumn("_h", F.xxhash64("vec"))
    per_vec = distinct.select(F.xxhash64("vec").alias("_h"), "vec", F.col("id").alias("of"))
    total = points.count()
    heavy = cut_lineage(points.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(total / HEAVY, 1)).select(by))
    if heavy.isEmpty():
        return points.join(per_vec, by).select("id", "name", "of")
    hot_vec = cut_lineage(per_vec.join(F.broadcast(heavy), by))        # fewer than HEAVY vectors are heavy
    hot = points.join(F.broadcast(hot_vec), by)
    rest = points.join(F.broadcast(heavy), by, "left_anti").join(per_vec, by)
    return hot.select("id", "name", "of").unionByName(rest.select("id", "name", "of"))


class Neighbours(NamedTuple):
    """Points (id, name, of), distinct vectors (id, size: points of it, up to k) and the k nearest points of each
    vector, its own points included (id, home, nbrs, dists, ofs); vectors of one home lie near each other."""

    members: DataFrame
    vectors: DataFrame
    lists: DataFrame


def neighbour_lists(points: DataFrame, k: int, block_rows: int = CELL_ROWS) -> Neighbours:
    """The k nearest of every distinct vector of (id string, vec array<double>), and whose vector is which."""
    points = _numbered(points)
    distinct = cut_lineage(distinct_points(points.select("id", "vec"), k))
    lists = cut_lineage(_search(None, distinct, k, block_rows))
    return Neighbours(cut_lineage(_members(points, distinct)), distinct.select("id", F.size("ids").alias("size")), lists)


def _ranked(lists: DataFrame, base: DataFrame) -> DataFrame:
    """(id, nbr, dist, rank) from lists (id, near), with the names of ``base`` (id, name) for its numbers."""
    flat = (lists.select("id", F.posexplode("near").alias("_at", "_n"))
                 .select("id", F.col("_n.nbr").alias("_nbr"), F.col("_n.dist").alias("dist"), (F.col("_at") + 1).alias("rank")))
    names = base.select(F.col("id").alias("_nbr"), F.col("name").alias("nbr"))
    return flat.join(names, "_nbr").select("id", "nbr", "dist", "rank")


def knn(points: DataFrame, k: int, block_rows: int = CELL_ROWS, n: int | None = None) -> DataFrame:
    """Exact kNN over (id string, vec array<double>) → (id, nbr, dist, rank), self excluded.

    ``n`` is the number of points (counted if not given), ``block_rows`` the most distinct points of a cell.
    """
    if n is None:
        n = points.count()
    k = max(1, min(k, n - 1))
    members, _, lists = neighbour_lists(points, k + 1, block_rows)
    near = F.arrays_zip(F.col("nbrs").alias("nbr"), F.col("dists").alias("dist"))
    lists = lists.select(F.col("id").alias("of"), near.alias("near"))
    others = F.slice(F.filter("near", lambda x: x["nbr"] != F.col("id")), 1, k)
    return _ranked(members.join(lists, "of").select(F.col("name"), others.alias("near")).withColumnRenamed("name", "id"), members)


def knn_query(queries: DataFrame, base: DataFrame, k: int, block_rows: int = CELL_ROWS,
              n_base: int | None = None, n_queries: int | None = None) -> DataFrame:
    """K nearest ``base`` rows for every ``queries`` row (two different sets, nothing excluded)."""
    queries, base = _numbered(queries), _numbered(base)
    asked = cut_lineage(distinct_points(queries.select("id", "vec"), 1))
    lists = _search(asked.select("id", "vec"), distinct_points(base.select("id", "vec"), k), k, block_rows)
    near = F.arrays_zip(F.col("nbrs").alias("nbr"), F.col("dists").alias("dist"))
    lists = lists.select(F.col("id").alias("of"), near.alias("near"))
    return _ranked(_members(queries, asked).join(lists, "of").select(F.col("name").alias("id"), "near"), base)
