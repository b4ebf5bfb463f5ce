"""Substring deduplication by level-wise doubling of repeated word windows.

A window of ``min_words`` words can only repeat if its shorter windows do.  At
each level (``start_words``, doubled up to ``min_words``) every window still in
question is represented by its smallest sub-window hash of that length; equal
windows have equal representatives, so a window whose representative occurs once
in the corpus is dropped.  Survivors are extended to twice the length; those
left at ``min_words`` are compared in full, and all but the earliest occurrence
(smallest document id, then start) are removed.

Hashes travel in byte blobs to hash buckets, documents to document buckets.  A
document's bucket and the holder of a hash are given by a hash of id and text, so
rows that share an id, null ids too, lie in different buckets; the id serves the
order of occurrences.  A removal names bucket, id, start and window hash, so it
meets only rows that hold this window there.  A hash that repeats within a batch or bucket is settled there and sent on once, so
a passage shared by any share of the documents costs one record a batch.  Window
identity at the last level is decided on 96 hash bits.

Words are runs of other than ASCII white space, unchanged.  Defined results:
null or empty text has no words; documents shorter than a window lose nothing;
rows with the same document id do not count as earlier than each other at the
same start; null ids come before all others; an empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (U64, _schemas, _to_batch, bucket_count, joined, lean, lean_cogroup, lean_group, runs, split, text_bytes, to_table,
                     window_hashes, word_hashes)

MIN_WORDS = 20
START_WORDS = 10
#: Stands for null document ids: before all others.
_NULL = -(1 << 63)
#: Marks a hash known to repeat, in place of its one holder.
_MANY = (1 << 63) - 1

_EXCHANGE = "bucket long, kind int, a binary, b binary, c binary, d binary, e binary"
_ANSWER = "part long, docs binary, values binary, windows binary"


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def representatives(words: np.ndarray, length: int, window: int) -> np.ndarray:
    """Smallest hash among the ``length``-windows inside each ``window``-window."""
    h = window_hashes(words, length)
    span, n = window - length + 1, len(words) - window + 1
    if n <= 0:
        return h[:0]
    size = 1
    while 2 * size <= span:                     # sliding minimum by doubling
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = span - size
    return np.minimum(h[:len(h) - rest], h[rest:])[:n] if rest else h[:n]


def _alive(words: np.ndarray, allowed: np.ndarray | None, length: int, window: int) -> np.ndarray:
    """Starts of the windows whose representative at the previous level repeats."""
    n = max(0, len(words) - window + 1)
    if allowed is None:
        return np.arange(n)
    if not n or not len(allowed):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.isin(representatives(words, length, window), allowed))


def _candidates(keys: list, texts: list, allowed: dict | None, previous: int, length: int, window: int,
                buckets: int, parts: int) -> list[tuple]:
    """Exchange rows of one level: single holders by hash bucket, settled repeats straight to their documents."""
    hashes, docs, twice = [], [], []
    for d, t in zip(keys, texts):
        words = word_hashes(_raw(t))
        starts = _alive(words, None if allowed is None else allowed.get(d, _NONE), previous, window)
        if not len(starts):
            continue
        rep = representatives(words, length, window)[starts]
        own = np.unique(rep)
        hashes.append(own)
        docs.append(np.full(len(own), d, dtype=np.int64))
        full = window_hashes(words, window)[starts]
        order = np.argsort(full)
        same = full[order][1:] == full[order][:-1]
        if same.any():                           # a window that repeats inside the document
            twice.append(rep[order[1:][same]])
    if not hashes:
        return []
    h, d = np.concatenate(hashes), np.concatenate(docs)
    del hashes, docs
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    del order
    number = runs(h)
    many = np.bincount(number)[number] > 1
    if twice:
        many |= np.isin(h, np.unique(np.concatenate(twice)))
    first = np.ones(len(h), dtype=bool)
    first[1:] = number[1:] != number[:-1]
    send = ~many | first
    holder = np.where(many, _MANY, d)
    rows = [(b, 0, x, y, None, None, None) for b, x, y in split(h[send], buckets, h[send], holder[send])]
    settled = many & (d != _MANY)
    part = _part(d[settled], parts)
    rows += [(p, 1, x, y, p.to_bytes(8, "little"), None, None) for p, x, y in split(part, parts, h[settled], d[settled])]
    return rows


_NONE = np.zeros(0, dtype=np.uint64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Document bucket of row keys; equal to ``_part_column`` for the same keys."""
    return (keys % np.int64(parts)).astype(np.uint64)


def _key_column():
    """Hash of id and text, never ``_MANY``; rows that share a key by chance are only looked at more often."""
    return F.least(F.xxhash64("doc_id", "text"), F.lit(_MANY - 1))


def _part_column(parts: int, min_words: int):
    """Texts too short for a window get no answers: any bucket will do, so equal ones are dealt out too."""
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * min_words - 1
    return F.pmod(F.when(short, F.monotonically_increasing_id()).otherwise(F.col("key")), F.lit(parts))


def _answers(table: pa.Table, parts: int, arrow: pa.Schema) -> pa.Table:
    """For one hash bucket: the holders of repeated hashes, by document bucket."""
    kind = table["kind"].to_numpy()
    rows = _passed(table, kind)
    single = table.filter(pa.array(kind == 0))
    h, d = joined(single["a"], np.uint64), joined(single["b"], np.int64)
    if len(h):
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        number = runs(h)
        weight = np.bincount(number, weights=np.where(d == _MANY, 2, 1))[number]
        back = (weight > 1) & (d != _MANY)
        rows += [(p, y, x, None) for p, x, y in split(_part(d[back], parts), parts, h[back], d[back])]
    return to_table(rows, arrow)


def _passed(table: pa.Table, kind: np.ndarray) -> list[tuple]:
    """Answers that were settled before the exchange."""
    settled = table.filter(pa.array(kind == 1))
    return [(int.from_bytes(p, "little"), d, v, w) for v, d, p, w in
            zip(*(settled[c].to_pylist() for c in ("a", "b", "c", "d")))]


def _by_doc(docs: np.ndarray, *values: np.ndarray) -> dict[int, list[np.ndarray]]:
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    cuts = np.flatnonzero(docs[1:] != docs[:-1]) + 1
    groups = zip(np.split(docs, cuts), *(np.split(v[order], cuts) for v in values))
    return {int(d[0]): v for d, *v in groups} if len(docs) else {}


def _windows(part: int, doc_ids: list, keys: list, texts: list, allowed: dict, previous: int, window: int,
             buckets: int) -> list[tuple]:
    """Exchange rows of the last level: the first occurrence of each window in this document bucket, and the others' removal.

    Rows of one id with the window at the same start stand or go together, so one of them is sent.
    """
    got: list[list[np.ndarray]] = [[], [], [], []]
    for d, k, t in zip(doc_ids, keys, texts):
        d = _NULL if d is None else d
        if k not in allowed:
            continue
        words = word_hashes(_raw(t))
        starts = _alive(words, allowed[k], previous, window)
        if len(starts):
            check = window_hashes(words, window, second=True)[starts] >> U64(32)
            for have, new in zip(got, (window_hashes(words, window)[starts], check.astype(np.uint32),
                                       np.full(len(starts), d, dtype=np.int64), starts.astype(np.int32))):
                have.append(new)
    if not got[0]:
        return []
    h, c, d, s = _sorted(*(np.concatenate(x) for x in got))
    first = _earliest(h, c, d, s)
    own = part.to_bytes(8, "little")
    rows = [(b, 0, *x, own) for b, *x in split(h[first], buckets, h[first], d[first], s[first], c[first])]
    later = ~first & _after_first(h, c, d, s)
    if later.any():
        rows.append((part, 1, s[later].tobytes(), d[later].tobytes(), own, h[later].tobytes(), None))
    return rows


def _sorted(h: np.ndarray, c: np.ndarray, d: np.ndarray, s: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((s, d, c, h))
    return tuple(x[order] for x in (h, c, d, s, *more))


def _earliest(h: np.ndarray, c: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows that open a run of equal windows."""
    number = runs(h, c)
    first = np.ones(len(h), dtype=bool)
    first[1:] = number[1:] != number[:-1]
    return first


def _after_first(h: np.ndarray, c: np.ndarray, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows that start strictly later than the opening row of their run."""
    first = np.flatnonzero(_earliest(h, c, d, s))[runs(h, c)]
    return (d != d[first]) | (s != s[first])


def _removed(table: pa.Table, parts: int, arrow: pa.Schema) -> pa.Table:
    """For one window bucket: the starts that have an earlier occurrence, by document bucket."""
    kind = table["kind"].to_numpy()
    rows = _passed(table, kind)
    single = table.filter(pa.array(kind == 0))
    h = joined(single["a"], np.uint64)
    if len(h):
        part = np.repeat(joined(single["e"], np.uint64), [len(x) // 8 for x in single["a"].to_pylist()])
        h, c, d, s, part = _sorted(h, joined(single["d"], np.uint32), joined(single["b"], np.int64), joined(single["c"], np.int32), part)
        later = _after_first(h, c, d, s)
        rows += [(p, *x) for p, *x in split(part[later], parts, d[later], s[later], h[later])]
    return to_table(rows, arrow)


def _held(words: np.ndarray, starts: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
    """Those of the removed ``starts`` of an id (sorted by ``_place``) at which this row holds the removed window."""
    own = np.arange(max(0, len(words) - size + 1))
    wanted, have = _place(windows, starts), _place(window_hashes(words, size), own)
    at = np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)
    return own[(wanted[at] == have) & (starts[at] == own)]


def _place(windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number for window hash and start."""
    return windows + starts.astype(np.uint64) * U64(0x9E3779B97F4A7C15)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, start_words: int = START_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept words are joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = text_bytes(docs)
    buckets = parts = bucket_count(spark, total)
    exchange, exchange_arrow = _schemas(spark, _EXCHANGE)
    answer, answer_arrow = _schemas(spark, _ANSWER)
    result, result_arrow = _schemas(spark, _RESULT)
    docs = docs.withColumn("key", _key_column())
    keyed = docs.withColumn("part", _part_column(parts, min_words))

    def first_level(batches):
        for batch in batches:
            yield _to_batch(_candidates(batch.column(2).to_pylist(), batch.column(1).to_pylist(), None, 0, start_words,
                                        min_words, buckets, parts), exchange_arrow)

    def settle(sent: DataFrame, fn) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lean_group(lambda t: fn(t, parts, answer_arrow)), answer)

    def extend(rows):
        """Cogroup function: exchange rows from the documents of a bucket and the hashes answered for them."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            allowed = {k: v for k, (v,) in _by_doc(joined(right["docs"], np.int64), joined(right["values"], np.uint64)).items()}
            part = left["part"][0].as_py() if left.num_rows else 0
            return to_table(rows(part, *(left[c].to_pylist() for c in ("doc_id", "key", "text")), allowed), exchange_arrow)
        return run

    def doubled(low: int):
        return extend(lambda p, d, k, t, ok: _candidates(k, t, ok, low, 2 * low, min_words, buckets, parts))

    def meet(answers: DataFrame, fn, schema) -> DataFrame:
        return keyed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lean_cogroup(fn), schema)

    level = start_words
    answers = settle(docs.mapInArrow(lean(first_level), exchange), _answers)
    while 2 * level < min_words:
        answers = settle(meet(answers, doubled(level), exchange), _answers)
        level *= 2
    sent = meet(answers, extend(lambda p, d, k, t, ok: _windows(p, d, k, t, ok, level, min_words, buckets)), exchange)
    removed = settle(sent, _removed)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, starts, windows = (joined(right[c], kind) for c, kind in
                                 (("docs", np.int64), ("values", np.int32), ("windows", np.uint64)))
        order = np.argsort(_place(windows, starts))
        removals, rows = _by_doc(docs[order], starts[order], windows[order]), []
        ids = left["doc_id"].to_pylist()
        several = {d for d, n in Counter(ids).items() if n > 1}
        for d, t in zip(ids, left["text"].to_pylist()):
            words = _raw(t).split()
            gone, which = removals.get(_NULL if d is None else d, (None, None))
            if gone is not None and (d is None or d in several):
                gone = _held(word_hashes(_raw(t)), gone, which, min_words)
            if gone is None:
                kept, n = words, 0
            else:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + min_words, -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(stay)]
                n = len(words) - len(kept)
            rows.append((d, len(words), n, b" ".join(kept).decode("utf-8", "surrogatepass")))
        return to_table(rows, result_arrow)

    return meet(removed, finish, result)


def result(docs: DataFrame) -> DataFrame:
    """Digest per document."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
