"""Spelling variants: words one edit apart, grouped under their commonest form.

Words are counted over all texts.  Each word of the vocabulary generates its
deletions and its replacements by a later letter (an insertion is the deletion
of the longer word, a replacement by an earlier letter that of the other word,
so every near pair is generated once).  Edits are never spelled out: the hash
of an edit follows from the hash of its word in constant time.  They are probed
against blocked Bloom filters of the vocabulary, one shard per word length, that
are broadcast; only positives are shuffled to a join with the vocabulary on the
hash, and a second join brings the word back, so that the edited string itself
decides.  A false positive costs a row, no hash decides a result.

The filters take ``BITS`` bits a word and at most ``MAX_BLOCKS`` blocks of 32
bytes: that bounds the broadcast.  Beyond that, more edits pass the filters and
are removed by the join; the results are the same.  Words of more than
``LONG`` characters share one shard.

A word's form is its near word with the largest count where that is at least
twice its own (ties: smallest in code-point order).  Counts at least double
along forms, so roots are found by pointer doubling in a few rounds.

Defined results: a null or empty text has no words; a null id hashes as the
empty string; repeated rows count again; an empty table, and one without any
word that is common enough, gives an empty result; of the table only id and
text are read, whatever else it holds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, _schemas, _table, checkpoint, mix, slices, to_table

#: Characters and occurrences that a word needs, and the share of (document, word) pairs that lose a character: one in so many.
MIN_CHARS, MIN_COUNT, DROP_ONE_IN = 5, 3, 97
#: A form has at least so many times the count of its word.
FORM_RATIO = 2
#: Bits of the filters for a word, and the most blocks that all filters take together (64 MB).
BITS, MAX_BLOCKS = 16, 1 << 21
#: Words beyond this length share a filter.
LONG = 64
#: Distinct words that a task counts before it passes them on, and edits that it holds at a time.
MAX_COUNTED, MAX_EDITS = 200_000, 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))

_CHAR = _table(1301, 256)
_SALT = _table(1302, 8) & U64(0xFFFFFFFF) | U64(1)
_BASE = int(_table(1303, 1)[0])
_INVERSE = U64(pow(_BASE, -1, 1 << 64))
_SIZE = _table(1304, 1)[0]


# ---------------------------------------------------------------- counts

def document_words(doc_id: int | None, text: str | None, drop_one_in: int | None = DROP_ONE_IN) -> Counter:
    """Words of a text with their counts: lower-cased runs, of which every pair whose hash says so loses a character."""
    out: Counter = Counter()
    if not text:
        return out
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(low)).items():
        if drop_one_in:
            h = zlib.crc32(run.encode(), start)
            if h % drop_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_one_in: int | None = DROP_ONE_IN) -> DataFrame:
    """(word, n) of all words that are long and common enough; counted in tasks before the shuffle."""
    out, arrow = _schemas(docs.sparkSession, "word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()
        for batch in slices(batches, 200):
            for d, t in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in document_words(d, t, drop_one_in).items():
                    if len(word) >= min_chars:
                        have[word] += n
                if len(have) >= MAX_COUNTED:
                    yield from to_table(list(have.items()), arrow).to_batches(10_000)
                    have.clear()
        yield from to_table(list(have.items()), arrow).to_batches(10_000)

    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)
                .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


# ---------------------------------------------------------------- hashes

def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each (all are below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def _finish(h: np.ndarray, size: int) -> np.ndarray:
    return mix(h + U64(int(_SIZE) * size & (1 << 64) - 1))


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit key of every word."""
    out = np.zeros(len(words), dtype=np.uint64)
    for at, codes in _by_length(words):
        out[at] = _finish((_CHAR[codes] * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64), codes.shape[1])
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points) of the words of each length, in parts of bounded size."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, (1 << 18) // max(int(size), 1))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            yield part, _codes([words[j] for j in part])


def edits(codes: np.ndarray, alphabets: dict[int, np.ndarray], shard_of) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, row, place and letter in one number, key) of the edits of words of one length, in bounded parts.

    The number is place * 256 + letter; letter 0 deletes.  A letter is deleted once per run of equal ones,
    and replaced by later letters that words of its length hold.
    """
    m, size = codes.shape
    power = _powers(size)
    rows = np.arange(m)
    terms = _CHAR[codes] * power[:-1]
    prefix = np.zeros((m, size + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=prefix[:, 1:])
    whole = prefix[:, -1]
    for i in range(size):
        mine = rows if i == 0 else np.flatnonzero(codes[:, i] != codes[:, i - 1])
        h = prefix[mine, i] + (whole[mine] - prefix[mine, i + 1]) * _INVERSE
        yield shard_of(size - 1), mine, np.full(len(mine), i << 8, dtype=np.int64), _finish(h, size - 1)
    letters = alphabets.get(shard_of(size), np.zeros(0, dtype=np.uint8))
    places = max(1, MAX_EDITS // max(m * len(letters), 1))
    for i in range(0, size, places):
        part = codes[:, i:i + places]
        row, place, letter = np.nonzero(part[:, :, None] < letters)
        old, new = part[row, place], letters[letter]
        place += i
        h = whole[row] + (_CHAR[new] - _CHAR[old]) * power[place]
        yield shard_of(size), row, (place.astype(np.int64) << 8) + new, _finish(h, size)


# ---------------------------------------------------------------- filters

def shard_of(size: int) -> int:
    return min(size, LONG + 1)


class Filters:
    """Blocked Bloom filters in one array: eight 32-bit lanes to a block, one bit a lane for each key."""

    def __init__(self, blocks: dict[int, tuple[int, int]], lanes: np.ndarray):
        self.blocks, self.lanes = blocks, lanes

    def contains(self, shard: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the vocabulary."""
        if shard not in self.blocks:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(len(keys))
        block = block_of(keys, *self.blocks[shard])
        for lane in range(8):
            hit = (self.lanes[block * 8 + lane] >> bit_of(keys, lane)) & np.uint32(1)
            keep = np.flatnonzero(hit)
            at, block, keys = at[keep], block[keep], keys[keep]
        return at


def block_of(keys: np.ndarray, start: int, count: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(count)) >> U64(32)).astype(np.int64) + start


def bit_of(keys: np.ndarray, lane: int) -> np.ndarray:
    return (((keys & U64(0xFFFFFFFF)) * _SALT[lane] & U64(0xFFFFFFFF)) >> U64(27)).astype(np.uint32)


def layout(counts: dict[int, int], bits: int = BITS, max_blocks: int = MAX_BLOCKS) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of every shard; together at most ``max_blocks`` and one for each shard."""
    total = sum(counts.values())
    share = min(bits / 256, max_blocks / max(total, 1))
    out, at = {}, 0
    for shard, n in sorted(counts.items()):
        out[shard] = (at, max(1, int(n * share)))
        at += out[shard][1]
    return out


def build_filters(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> Filters:
    """Filters of ``words`` (word, n, key): bits are or-ed per block in the cluster, and the blocks come to the driver."""
    counts = {r["shard"]: r["n"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONG + 1)).alias("shard"))
                                             .agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = layout(counts, max_blocks=max_blocks)
    out, arrow = _schemas(words.sparkSession, "block long, a long, b long, c long, d long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = np.minimum(np.asarray(batch.column(0)), LONG + 1)
            keys = np.asarray(batch.column(1)).view(np.uint64)
            for shard in np.unique(shards):
                mine = keys[shards == shard]
                block = block_of(mine, *blocks[int(shard)])
                bits = [U64(1) << bit_of(mine, lane).astype(np.uint64) for lane in range(8)]
                pairs = [(bits[i] | bits[i + 1] << U64(32)).view(np.int64) for i in range(0, 8, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block, *pairs)], schema=arrow)

    rows = (words.select(F.length("word").cast("long").alias("size"), "key").mapInArrow(run, out)
                 .groupBy("block").agg(*[F.bit_or(c).alias(c) for c in "abcd"])).toArrow()
    lanes = np.zeros((sum(n for _, n in blocks.values()), 4), dtype=np.int64)
    lanes[np.asarray(rows["block"])] = np.stack([np.asarray(rows[c]) for c in "abcd"], axis=1)
    return Filters(blocks, lanes.reshape(-1).view(np.uint32))


def _alphabets(words: DataFrame) -> dict[int, np.ndarray]:
    """Code points, in order, of the words of every shard: at most 90 a shard."""
    letter = F.explode(F.array_distinct(F.split("word", "")))
    rows = (words.select(F.least(F.length("word"), F.lit(LONG + 1)).alias("shard"), letter.alias("letter"))
                 .where(F.col("letter") != "").distinct().collect())
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(ord(r["letter"]))
    return {shard: np.array(sorted(codes), dtype=np.uint8) for shard, codes in out.items()}


# ---------------------------------------------------------------- pairs

def _with_keys(vocab: DataFrame) -> DataFrame:
    out, arrow = _schemas(vocab.sparkSession, "word string, n long, key long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 10_000):
            keys = word_keys(batch.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], schema=arrow)

    return vocab.select("word", F.col("n").cast("long")).mapInArrow(run, out)


def candidates(words: DataFrame, filters: Filters, alphabets: dict[int, np.ndarray]) -> DataFrame:
    """(key of an edit that passes the filters, source: key of its word, edit)."""
    spark: SparkSession = words.sparkSession
    out, arrow = _schemas(spark, "key long, source long, edit long")
    shared = spark.sparkContext.broadcast((filters.blocks, filters.lanes, alphabets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, lanes, letters = shared.value
        probe = Filters(blocks, lanes)
        for batch in slices(batches, 10_000):
            keys = np.asarray(batch.column(1)).view(np.uint64)
            for at, codes in _by_length(batch.column(0).to_pylist()):
                for shard, row, edit, key in edits(codes, letters, shard_of):
                    hit = probe.contains(shard, key)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[hit].view(np.int64)), pa.array(keys[at[row[hit]]].view(np.int64)), pa.array(edit[hit])], schema=arrow)

    return words.select("word", "key").mapInArrow(run, out)


def near_pairs(vocab: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once."""
    words = checkpoint(_with_keys(vocab))
    found = candidates(words, build_filters(words, max_blocks), _alphabets(words))
    met = found.join(words.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key").drop("key")
    place = F.shiftright("edit", 8).cast("int")
    letter = F.col("edit").bitwiseAND(F.lit(255))
    edited = F.concat(F.substring("word", F.lit(1), place), F.when(letter > 0, F.chr(letter)).otherwise(""),
                      F.substring("word", place + 2, F.length("word")))
    return (met.join(words.withColumnRenamed("key", "source"), "source").where(edited == F.col("other"))
               .select("word", "n", "other", "other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round doubles the steps that a row has taken."""
    rows = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        step = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = checkpoint(rows.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if rows.where("moved").isEmpty():
            return rows.select("word", "root")
        rows = rows.select("word", "root")


def group(vocab: DataFrame, ratio: float = FORM_RATIO, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(word, n) of distinct words over A-Z, a-z and the letters U+00C0 to U+00FF -> word, form, root, n, n_near, form_n."""
    vocab = checkpoint(vocab.select("word", "n"))
    pairs = near_pairs(vocab, max_blocks)
    both = F.explode(F.array(F.struct("word", F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("word")).alias("near")),
                             F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("least"), F.col("word")).alias("near")))).alias("p")
    near = pairs.select(both).select("p.word", "p.near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    has_form = -F.col("near.least") >= F.col("n") * ratio
    rows = checkpoint(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("near.word")).alias("form"),
        F.when(has_form, -F.col("near.least")).alias("form_n")))
    roots = _roots(rows.where(F.col("form").isNotNull()))
    return (rows.join(roots, "word", "left")
                .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long"), "form_n"))


def result(docs: DataFrame) -> DataFrame:
    return group(vocabulary(docs))


#: The query in SQL: checksums by their bit rule, near words by equal rests with one place left out.
ORACLE = r"""
WITH RECURSIVE table32 AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) r(b)
), low AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+') AS runs
  FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(runs) AS run FROM low) GROUP BY doc_id, run
), digits AS (
  SELECT doc_id, run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs
), bytes AS (
  SELECT doc_id, run, n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM digits
), sums AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || b, lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM bytes, table32
), kept AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM sums
), vocab AS (
  SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), rests AS (
  SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM vocab, unnest(range(1, length(word) + 1)) u(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM rests a JOIN vocab b ON a.rest = b.word
), ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM pairs
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON v.word = r.word AND place = 1
), walk AS (
  SELECT word, word AS at FROM forms
  UNION SELECT w.word, f.form FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.at AS root FROM walk w JOIN forms f ON w.at = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON f.word = e.word
"""
