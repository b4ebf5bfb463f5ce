"""Size-aware heavy-light join of documents on word n-gram Jaccard similarity.

A document's set holds its distinct word n-grams.  Equal sets are one class.
Small sets enumerate fixed-size subsets: sets of sizes s and m are similar
exactly if they share a subset of the required overlap's size, so equal subset
keys are links without a further check.  Large sets go into inverted lists of
their prefixes (rare n-grams first) and candidates from a list are checked on
the whole sets.  The boundary is the size up to which enumeration costs less
than scanning, from the size histogram and list lengths of all documents.

Lists never emit all their pairs: each set of a list meets its next ``SHORT - 1``
by size (in short lists that is all), in longer ones also the list's first; after the links found so far are joined to
components, the sets of a long list that are still apart are paired exactly.  A
pair is checked unless a 64-slot sketch shows it far below the threshold (a
similar pair fails that with a probability below 1e-10), or unless the place of a
shared n-gram in the two prefixes leaves too few n-grams behind it.

Sets are known by 64-bit hashes of their n-grams.  Defined results: null or
empty text has an empty set and links with nothing; a text with fewer words than
n has its whole sequence as one element; rows that share a document id are one
document of all their links; a row without an id gets the component of an equal
set, if any, and links nothing; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (SLICE, U64, _schemas, _to_batch, add_columns, broadcast_if_small, bucket_count, checkpoint, free_name, joined, lean, lean_group, map_batches, mix, runs, slices,
                     split, text_bytes, to_table, window_hashes, word_hashes)
from .components import components

N = 5
PERCENT = 75
#: Lists up to this length give all their pairs.
SHORT = 16
#: Bound on the n-grams ordered as frequent (they are broadcast), and the count from which one is: lists of fewer give all their pairs.
MAX_FREQUENT, FREQUENT_AT = 500_000, SHORT
#: Members of a long list that meet in one block pair.
BLOCK = 2048
#: Largest size ever enumerated.
MAX_SMALL = 12
SKETCH = 64
#: Agreement of the sketches up to which a pair is far below the threshold (seven deviations and more).
FAR = 0.35

_ROWS = "bucket long, kind int, a binary, b binary, c binary, d binary"
_FOUND = "kind int, a binary, b binary, c binary, d binary"


def element_hashes(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text (A-Z lower-cased, words split at ASCII white space)."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(n, len(words))))


def set_id(elements: np.ndarray) -> int:
    return int(mix(np.array([mix(elements ^ U64(0x5DEECE66D)).sum(dtype=np.uint64)]) + U64(len(elements)))[0].view(np.int64))


def required(s: int, m: int, percent: int = PERCENT) -> int:
    """Smallest overlap of sets of sizes s and m that reaches the similarity."""
    return -(-percent * (s + m) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix_length(s: int, percent: int = PERCENT) -> int:
    return s - -(-percent * s // 100) + 1


def subset_count(s: int, most: int, percent: int = PERCENT) -> int:
    return sum(comb(s, required(s, m, percent)) for m in partners(s, percent) if m <= most and required(s, m, percent) <= s)


def boundary(histogram: dict[int, int], list_length: dict[int, float], percent: int = PERCENT) -> int:
    """Size up to which enumerating subsets costs less than scanning the lists of the prefixes."""
    best, best_gain, gain = 0, 0.0, 0.0
    for s in range(1, MAX_SMALL + 1):
        n = histogram.get(s, 0)
        gain += n * (prefix_length(s, percent) * list_length.get(s, 1.0) - subset_count(s, s, percent))
        if gain >= best_gain:
            best, best_gain = s, gain
    return best


def subset_keys(elements: np.ndarray, most: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(key, side): one key per partner size and subset of the required size; side 0 is the smaller set's."""
    s, out = len(elements), []
    mixed = mix(elements * U64(0x9E3779B97F4A7C15) + U64(1))
    for m in partners(s, percent):
        q = required(s, m, percent)
        if m > most or q > s or q > m:
            continue
        sums = np.array([mixed[list(c)].sum(dtype=np.uint64) for c in combinations(range(s), q)], dtype=np.uint64)
        tag = np.array([min(s, m) * 1000 + max(s, m)], dtype=np.uint64) * U64(0xD6E8FEB86659FD93)
        out += [(int(k), 0 if s < m else 1 if s > m else 2) for k in mix(sums + tag)]
    return out


def sketch(elements: np.ndarray) -> bytes:
    """One byte of the smallest hash in each of 64 hash ranges, and a byte that tells empty ranges."""
    out = np.zeros((2, SKETCH), dtype=np.uint8)
    slot = (elements >> U64(58)).astype(np.int64)
    first = np.ones(len(elements), dtype=bool)
    first[1:] = slot[1:] != slot[:-1]
    out[0, slot[first]] = (elements[first] & U64(0xFF)).astype(np.uint8)
    out[1, slot[first]] = 1
    return out.tobytes()


# ------------------------------------------------------------ counts

def count_keys(elements: np.ndarray) -> np.ndarray:
    """What n-grams are counted by: the first 40 bits of their hashes, in the order of the hashes."""
    return elements >> U64(24)


def ngram_counts(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int], dict[int, float]]:
    """(count keys of the frequent n-grams by rising count, size histogram of small sets, their mean list length).

    All documents are counted; equal sets of a batch once.  N-grams that share a key (one in thousands over a billion) are
    counted as one, which moves them in the order.
    """
    spark = docs.sparkSession
    buckets = bucket_count(spark, text_bytes(docs))
    rows, rows_arrow = _schemas(spark, _ROWS)
    found, found_arrow = _schemas(spark, "kind int, key long, n long")

    def send(batches):
        for batch in slices(batches, 2 * SLICE):
            sets = [element_hashes(t, n) for t in batch.column(1).to_pylist()]
            seen: dict[int, np.ndarray] = {set_id(e): e for e in sets if len(e)}
            sizes = np.bincount([len(e) for e in seen.values() if len(e) <= MAX_SMALL] or [0], minlength=MAX_SMALL + 1)
            k, c = np.unique(count_keys(np.concatenate(list(seen.values()) or [_EMPTY])), return_counts=True)
            # In order, the first bytes are long runs that the shuffle's compression takes out.
            out = [(b, 0, *x, None) for b, *x in split(k, buckets, (k >> U64(32)).astype(np.uint8), k.astype(np.uint32), c.astype(np.uint32))]
            yield _to_batch([*out, (0, 1, sizes.astype(np.int64).tobytes(), None, None, None)], rows_arrow)

    def count(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        out = []
        part = table.filter(pa.array(kind == 0))
        k = joined(part["a"], np.uint8).astype(np.int64) << 32 | joined(part["b"], np.uint32)
        if len(k):
            order = np.argsort(k)
            k, c = k[order], joined(part["c"], np.uint32)[order]
            start = np.flatnonzero(np.diff(k, prepend=-1))
            total = np.add.reduceat(c, start, dtype=np.int64)
            often = total >= FREQUENT_AT
            out += [(0, key, t) for key, t in zip(k[start[often]].tolist(), total[often].tolist())]
        for sizes in table.filter(pa.array(kind == 1))["a"].to_pylist():
            out += [(1, s, int(k)) for s, k in enumerate(np.frombuffer(sizes, np.int64)) if k]
        return to_table(out, found_arrow)

    counted = checkpoint(docs.mapInArrow(lean(send), rows).groupBy("bucket").applyInArrow(lean_group(count), found))
    top = (counted.where("kind = 0").orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).select("key", "n").toArrow())
    order = np.lexsort((top["key"].to_numpy(), top["n"].to_numpy())) if top.num_rows else []
    frequent = top["key"].to_numpy()[order].astype(np.uint64) if top.num_rows else _EMPTY
    histogram = {r.key: r.n for r in counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    spread = counted.where("kind = 0").agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
    mean = spread.s / spread.n if spread.n else 1.0
    return frequent, histogram, {s: min(mean, 1000.0) for s in histogram}


_EMPTY = np.zeros(0, dtype=np.uint64)


class Order:
    """Global order of n-grams: others by hash, then the frequent ones (by count key) from rarer to commoner, then by hash."""

    def __init__(self, frequent: np.ndarray):
        self.by_hash = np.argsort(frequent)
        self.keys = frequent[self.by_hash]

    def prefix(self, elements: np.ndarray, size: int) -> np.ndarray:
        if not len(self.keys):
            return elements[:size]
        key = count_keys(elements)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        often = self.keys[at] == key
        rare = elements[~often][:size]
        if len(rare) == size:
            return rare
        common = elements[often][np.argsort(self.by_hash[at[often]], kind="stable")]
        return np.concatenate([rare, common[:size - len(rare)]])


# ------------------------------------------------------------ lists

def _compatible(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.ones(len(a), dtype=bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first]


def _reachable(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m whose first common n-gram is at prefix places i and j can be similar."""
    return 1 + np.minimum(n - 1 - i, m - 1 - j) >= -(-percent * (n + m) // (100 + percent))


def _list_pairs(key: np.ndarray, sid: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> list[tuple]:
    """Pairs of short lists; of long ones the star, each set with its next few by size, and the members."""
    order = np.lexsort((sid, size, key))
    key, sid, size, place = key[order], sid[order], size[order].astype(np.int64), place[order].astype(np.int64)
    number = runs(key)
    length = np.bincount(number)[number]
    start = np.flatnonzero(np.diff(number, prepend=-1))[number]
    long = length > SHORT
    left, right = [], []
    at = np.arange(len(key))
    for step in range(1, SHORT):
        i = at[:-step] if step < len(at) else at[:0]
        j = i + step
        same = (number[i] == number[j]) & _compatible(size[i], size[j], percent)
        same &= _reachable(size[i], place[i], size[j], place[j], percent)
        left.append(i[same])
        right.append(j[same])
    star = at[long & (at > start)]
    star = star[_compatible(size[star], size[start[star]], percent)]
    i, j = np.concatenate([*left, start[star]]), np.concatenate([*right, star])
    a, b = _unique_pairs(np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]))
    rows = [(0, a.tobytes(), b.tobytes(), None, None)] if len(a) else []
    if long.any():
        rows.append((1, key[long].tobytes(), sid[long].tobytes(), size[long].tobytes(), place[long].tobytes()))
    return rows


def _subset_links(key: np.ndarray, sid: np.ndarray, side: np.ndarray) -> list[tuple]:
    """Links of equal subset keys: each side's first set with all of the other side (or of its own, if of one size)."""
    order = np.lexsort((sid, side, key))
    key, sid, side = key[order], sid[order], side[order]
    number = runs(key)
    out = []
    for mine, theirs in ((0, 1), (1, 0), (2, 2)):
        leader = np.full(number[-1] + 1, -1)
        members = np.flatnonzero(side == mine)[::-1]
        leader[number[members]] = members
        others = np.flatnonzero(side == theirs)
        others = others[leader[number[others]] >= 0]
        out.append((sid[leader[number[others]]], sid[others]))
    a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
    apart = a != b
    a, b = _unique_pairs(np.minimum(a, b)[apart], np.maximum(a, b)[apart])
    return [(2, a.tobytes(), b.tobytes(), None, None)] if len(a) else []


def _dedupe(key: np.ndarray, sid: np.ndarray, *other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of the lists that hold more than one."""
    order = np.lexsort((*other, sid, key))
    cols = [c[order] for c in (key, sid, *other)]
    first = np.ones(len(key), dtype=bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    cols = [c[first] for c in cols]
    number = runs(cols[0])
    shared = np.bincount(number)[number] > 1
    return tuple(c[shared] for c in cols)


def postings(docs: DataFrame, n: int, percent: int, small: int, order: Order, buckets: int) -> DataFrame:
    """Exchange rows: prefix postings (kind 0) and subset keys (1); equal sets of a batch send theirs once."""
    rows, arrow = _schemas(docs.sparkSession, _ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        for batch in slices(batches, 2 * SLICE):
            lists: list[tuple[np.ndarray, int, int]] = []
            keys: list[tuple[int, int, int]] = []
            seen = set()
            for t in batch.column(1).to_pylist():
                e = element_hashes(t, n)
                sid = set_id(e) if len(e) else 0
                if not len(e) or sid in seen:
                    continue
                seen.add(sid)
                if len(e) <= small:
                    keys += [(k, sid, side) for k, side in subset_keys(e, small, percent)]
                if 100 * len(e) >= percent * (small + 1):
                    lists.append((shared.value.prefix(e, prefix_length(len(e), percent)), sid, len(e)))
            out = []
            if lists:
                count = [len(p) for p, _, _ in lists]
                key = np.concatenate([p for p, _, _ in lists])
                sid = np.repeat(np.array([s for _, s, _ in lists], dtype=np.int64), count)
                size = np.repeat(np.array([m for _, _, m in lists], dtype=np.int32), count)
                place = np.concatenate([np.minimum(np.arange(c), 32767) for c in count]).astype(np.int16)
                out += [(b, 0, *x) for b, *x in split(mix(key), buckets, key, sid, size, place)]
            if keys:
                key, sid = np.array([k for k, _, _ in keys], dtype=np.uint64), np.array([s for _, s, _ in keys], dtype=np.int64)
                side = np.array([x for _, _, x in keys], dtype=np.int32)
                out += [(b, 1, *x, None) for b, *x in split(mix(key), buckets, key, sid, side)]
            yield _to_batch(out, arrow)

    return docs.mapInArrow(lean(run), rows)


def candidates(sent: DataFrame, percent: int) -> DataFrame:
    """Blobs per bucket: candidate pairs (kind 0), members of long lists (1) and certain links (2)."""
    found, arrow = _schemas(sent.sparkSession, _FOUND)

    def run(table: pa.Table) -> pa.Table:
        kind, out = table["kind"].to_numpy(), []
        for k, make in ((0, lambda *x: _list_pairs(*x, percent)), (1, _subset_links)):
            part = table.filter(pa.array(kind == k))
            if part.num_rows:
                more = [joined(part["d"], np.int16)] if k == 0 else []
                cols = _dedupe(joined(part["a"], np.uint64), joined(part["b"], np.int64), joined(part["c"], np.int32), *more)
                if len(cols[0]):
                    out += make(*cols)
        return to_table(out, arrow)

    return sent.groupBy("bucket").applyInArrow(lean_group(run), found)


def _pairs(blobs: DataFrame, kind: int) -> DataFrame:
    """(a, b) rows of the pair blobs of a kind."""
    out, arrow = _schemas(blobs.sparkSession, "a long, b long")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], schema=arrow)

    return blobs.where(F.col("kind") == kind).select("a", "b").mapInArrow(lean(run), out).distinct()


def _members(blobs: DataFrame) -> DataFrame:
    out, arrow = _schemas(blobs.sparkSession, "key long, sid long, size long, place long")

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], schema=arrow)

    return blobs.where("kind = 1").select("a", "b", "c", "d").mapInArrow(lean(run), out)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches do not rule them out, with the sketches' agreement."""
    k = classes.select("sid", "sketch")
    both = (pairs.join(k.withColumnsRenamed({"sid": "a", "sketch": "x"}), "a")
            .join(k.withColumnsRenamed({"sid": "b", "sketch": "y"}), "b"))

    def agree(x: list, y: list) -> list[tuple]:
        if not x:
            return []
        p = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), 2, SKETCH)
        q = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), 2, SKETCH)
        used = (p[:, 1] | q[:, 1]).sum(1)
        same = ((p[:, 0] == q[:, 0]) & (p[:, 1] == q[:, 1]) & (p[:, 1] > 0)).sum(1)
        near = (used < 56) | (same > FAR * used)
        return [(float(s) if ok else None,) for s, ok in zip(same / np.maximum(used, 1), near)]

    return add_columns(both, ["x", "y"], "near double", agree).where("near is not null").select("a", "b", "near")


def _check(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among ``pairs`` by the exact similarity of the whole sets."""
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(classes, "sid").select("rep", "sid")
    need = broadcast_if_small(need)
    texts = docs.join(need, docs["doc_id"] == need["rep"]).select("sid", "text")
    def own(sids: list, found: list) -> list[tuple]:
        """The sets of the texts whose set it is: other texts of the same document have others."""
        out = []
        for k, x in zip(sids, found):
            e = element_hashes(x, n)
            out.append((k, e.tobytes() if len(e) and set_id(e) == k else b""))
        return out

    sets = map_batches(texts, own, "sid long, e binary").where(F.length("e") > 0).dropDuplicates(["sid"])
    both = (pairs.select("a", "b").join(sets.withColumnsRenamed({"sid": "a", "e": "x"}), "a")
            .join(sets.withColumnsRenamed({"sid": "b", "e": "y"}), "b"))

    out, arrow = _schemas(docs.sparkSession, "a long, b long")

    def similar(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            rows = []
            for i in range(batch.num_rows):          # the sets are read in place, not copied
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    rows.append((a[i].as_py(), b[i].as_py()))
            yield _to_batch(rows, arrow)

    return both.select("a", "b", "x", "y").mapInArrow(lean(similar), out)


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    c = comp.select("node", "component")
    x = pairs.join(c.withColumnsRenamed({"node": "a", "component": "p"}), "a", "left")
    x = x.join(c.withColumnsRenamed({"node": "b", "component": "q"}), "b", "left")
    return x.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def _residual(members: DataFrame, comp: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a long list's sets that are in different components and that no bound rules out.

    Lists longer than ``BLOCK`` are dealt in pairs of blocks, so none is held whole.
    """
    c = members.join(comp.withColumnsRenamed({"node": "sid"}), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = (c.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
             .where("low < high").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    c = c.join(mixed, "key").join(classes.select("sid", "sketch"), "sid")
    c = c.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    c = c.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    buckets = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.withColumn("bucket", F.pmod(F.xxhash64("key", "low", "high"), F.lit(buckets)))
    out, arrow = _schemas(members.sparkSession, "a long, b long")

    def run(table: pa.Table) -> pa.Table:
        names = ("key", "low", "high", "mine", "sid", "size", "place", "component")
        cols = {x: table[x].to_numpy() for x in names}
        order = np.lexsort((cols["sid"], cols["high"], cols["low"], cols["key"]))
        cols = {x: v[order] for x, v in cols.items()}
        marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, 2, SKETCH)[order]
        number = runs(cols["key"], cols["low"], cols["high"])
        end = np.append(np.flatnonzero(np.diff(number)) + 1, len(number))[number]
        left, right = [], []
        sid, size, place, component = (cols[x] for x in ("sid", "size", "place", "component"))
        for i in range(len(number)):
            j = np.arange(i + 1, end[i])
            ok = (component[j] != component[i]) & _compatible(size[j], size[i], percent)
            if cols["low"][i] != cols["high"][i]:
                ok &= cols["mine"][j] != cols["mine"][i]
            j = j[ok & _reachable(size[i], place[i], size[j], place[j], percent)]
            if len(j):
                used = (marks[j, 1] | marks[i, 1]).sum(1)
                same = ((marks[j, 0] == marks[i, 0]) & (marks[j, 1] == marks[i, 1]) & (marks[j, 1] > 0)).sum(1)
                j = j[(used < 56) | (same > FAR * used)]
                left.append(np.full(len(j), sid[i]))
                right.append(sid[j])
        if not left:
            return to_table([], arrow)
        x, y = np.concatenate(left), np.concatenate(right)
        a, b = _unique_pairs(np.minimum(x, y), np.maximum(x, y))
        return pa.table([pa.array(a), pa.array(b)], schema=arrow)

    return c.select("bucket", "sketch", "key", "low", "high", "mine", "sid", "size", "place", "component").groupBy("bucket").applyInArrow(
        lean_group(run), out).distinct()


def _same_document(rows: DataFrame) -> DataFrame:
    """Links between the different sets of one document id: its smallest with each other."""
    known = rows.where("doc_id is not null and sid is not null").select("doc_id", "sid").distinct()
    low = known.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("top")).where("a < top")
    return known.join(low.select("doc_id", "a"), "doc_id").where("sid <> a").select("a", F.col("sid").alias("b")).distinct()


def link(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, components): (doc_id, sid, n_shingles) rows and (node, component) of linked set ids."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = map_batches(docs, lambda ids, texts: [
        (d, set_id(e) if len(e) else None, len(e), sketch(e)) for d, e in ((d, element_hashes(t, n)) for d, t in zip(ids, texts))],
        "doc_id long, sid long, n_shingles long, sketch binary")
    rows = checkpoint(rows)
    classes = checkpoint(rows.where("sid is not null").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")))
    docs_known = docs.where("doc_id is not null")
    frequent, histogram, lengths = ngram_counts(docs_known, n)
    small = boundary(histogram, lengths, percent)
    buckets = bucket_count(docs.sparkSession, text_bytes(docs))
    blobs = checkpoint(candidates(postings(docs_known, n, percent, small, Order(frequent), buckets), percent))
    near = checkpoint(_near(_pairs(blobs, 0), classes))
    certain = _pairs(blobs, 2)
    certain = certain.union(_same_document(rows))
    best = (near.select(F.col("a").alias("s"), "a", "b", "near").union(near.select("b", "a", "b", "near"))
            .groupBy("s").agg(F.max_by(F.struct("a", "b"), F.struct("near", "a", "b")).alias("p")).select("p.*").distinct())
    links = checkpoint(_check(best, docs_known, classes, n, percent).union(certain))
    comp = checkpoint(components(links))
    for step in (0, 1):                         # the other candidates, then what long lists still hold apart
        left = _apart(near, comp) if step == 0 else _residual(_members(blobs), comp, classes, percent)
        left = checkpoint(left)
        more = checkpoint(_check(left, docs_known, classes, n, percent))
        if more.limit(1).count():
            links = links.union(more)
            comp = checkpoint(components(links))
    return rows.select("doc_id", "sid", "n_shingles"), comp


def _grouped(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sid, n_shingles, component_id) of ``docs``, and the component id of every set that a document has."""
    rows, comp = link(docs, n, percent)
    known = rows.where("doc_id is not null").groupBy("doc_id", "sid").agg(F.max("n_shingles").alias("n_shingles"))
    node = F.coalesce("component", "sid")
    first = (known.where("sid is not null").join(comp, known["sid"] == comp["node"], "left").groupBy(node.alias("c"))
             .agg(F.min("doc_id").alias("component_id")))
    lead = checkpoint(known.select("sid").where("sid is not null").distinct().join(comp, F.col("sid") == F.col("node"), "left")
                      .select("sid", node.alias("c")).join(first, "c").select("sid", "component_id"))
    out = rows.join(lead, "sid", "left").select("doc_id", "sid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    # A document's rows without a set follow its other rows, if it has any.
    empty = rows.where("sid is null and doc_id is not null").select("doc_id").distinct()
    if empty.join(known.where("sid is not null").select("doc_id"), "doc_id", "left_semi").isEmpty():
        return out, lead
    other = (known.where("sid is not null").join(empty, "doc_id", "left_semi").join(lead, "sid")
             .groupBy("doc_id").agg(F.min("component_id").alias("c")))
    out = out.join(other, "doc_id", "left").select(
        "doc_id", "sid", "n_shingles", F.when(F.col("sid").isNull(), F.coalesce("c", "component_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out, lead


def groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the component is its smallest document id."""
    return _grouped(docs, n, percent)[0].select("doc_id", "n_shingles", "component_id")


def _one_of_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each value of ``by``, chosen by a hash of the row; Spark keeps one a task before it shuffles."""
    name = free_name(rows, "place")
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: of the document with the smallest id, one row if it has several.

    Rows without an id go if a document has an equal set; of the others one of each equal set stays, and one of
    each text without words.
    """
    rows, lead = _grouped(docs, n, percent)
    rows = checkpoint(rows)
    known = rows.where("doc_id is not null")
    gone = broadcast_if_small(known.where("component_id < doc_id").select("doc_id").distinct())
    several = broadcast_if_small(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not several.isEmpty():
        again = _one_of_each(kept.join(several, "doc_id", "left_semi").select(kept.columns), ["doc_id"])
        kept = kept.join(several, "doc_id", "left_anti").select(kept.columns).union(again)
    if rows.where("doc_id is null").isEmpty():
        return kept
    name = free_name(docs, "sid")
    nameless = add_columns(docs.where(F.col("doc_id").isNull()), ["text"], f"`{name}` long",
                           lambda texts: [(set_id(e) if len(e) else None,) for e in (element_hashes(t, n) for t in texts)])
    nameless = nameless.join(lead.select(F.col("sid").alias(name)), name, "left_anti").select(*[F.col(f"`{c}`") for c in (*docs.columns, name)])
    whole, empty = _one_of_each(nameless.where(F.col(name).isNotNull()), [name]), _one_of_each(nameless.where(F.col(name).isNull()), ["text"])
    return kept.union(whole.select(kept.columns)).union(empty.select(kept.columns))
