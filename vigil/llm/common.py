"""Helpers shared by the operators: table readers, batch maps and word hashing.

Word hashes are polynomial hashes modulo 2**64 over a fixed table of random
byte values, finished by a bit mixer; windows of words hash the word hashes in
the same way.  Both are computed for whole texts with numpy prefix sums.
"""

from __future__ import annotations

import ctypes
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

U64 = np.uint64
#: ASCII white space that separates words.
SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Where that setting is absent (tests), the frame is persisted on the executors
    instead, so that it is evaluated once and later plans start from it.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Rows of a few numbers up to which a checked side of a join is broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` cut by a checkpoint and counted: hinted for broadcast up to ``max_rows``, else left to a shuffle join."""
    from pyspark.sql import functions as F
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= max_rows else df


#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 1000


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trim() -> None:
    """Hand memory that this process no longer uses back to the system; a worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:                   # a C library without it
        pass


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over the batches of a task that ends with its worker's memory trimmed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


def lean_group(fn: Callable[[pa.Table], pa.Table]):
    """A function over the table of a group that ends with its worker's memory trimmed."""
    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            trim()

    return run


def lean_cogroup(fn: Callable[[pa.Table, pa.Table], pa.Table]):
    """A function over the tables of a cogroup that ends with its worker's memory trimmed."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            trim()

    return run


def map_batches(df: DataFrame, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Replace the columns: ``fn(*columns)`` gets lists per slice of an Arrow batch and returns output rows."""
    out, arrow = _schemas(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _to_batch(fn(*(c.to_pylist() for c in batch.columns)), arrow)

    return df.mapInArrow(lean(run), out)


def add_columns(df: DataFrame, inputs: list[str], fields: str, fn: Callable[..., list[tuple]]) -> DataFrame:
    """Append columns computed from ``inputs``; all columns of ``df`` pass through untouched.

    ``fields`` must not clash with columns of ``df`` (see ``free_name``).
    """
    out, arrow = _schemas(df.sparkSession, fields)
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = _to_batch(fn(*(batch.column(i).to_pylist() for i in at)), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.columns], names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(lean(run), StructType([*df.schema.fields, *out.fields]))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Settings of the session that the operators run under.  Kinds of Python nodes that shorten their tracebacks get workers
#: of their own beside those that do not: with that off, all nodes share the workers of an executor, which then holds half
#: as many.  Batches of texts are held several times over (by the JVM, on the way, by the worker): 10,000 rows are too many.
SETTINGS = {"spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def _schemas(spark: SparkSession, schema: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    out = spark.createDataFrame([], schema).schema
    return out, to_arrow_schema(out)


def _to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)


def covered(span: tuple[int, int], starts: list[int], reach: list[int]) -> bool:
    """Whether one of some spans holds ``span``: ``starts`` in order, ``reach`` the furthest end up to each."""
    k = bisect_right(starts, span[0])
    return k > 0 and reach[k - 1] >= span[1]


def cover(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and furthest ends of ``spans`` for ``covered``."""
    spans = sorted(spans)
    return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))


# ---------------------------------------------------------------- hashing

def _table(seed: int, n: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(1, 2**63 - 1, size=n).astype(np.uint64) | U64(1)


_BYTE = _table(101, 256)
_B1, _B2, _W1, _W2 = (int(x) for x in _table(7, 4))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown by doubling, kept per base)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = have = (both[0], both[1])
        if size > 1 << 22:
            _POWERS.pop(base)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective bit mixer (SplitMix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each segment."""
    power, inverse = _powers(base, len(values) + 1)
    prefix = np.empty(len(values) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(values * power[:len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * inverse[starts]


#: Texts are hashed in pieces of about this many bytes, cut at white space.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        found = max(text.rfind(bytes([c]), at, cut) for c in SPACES)
        if found < at:                       # one word longer than a piece: extend to its end
            later = [p for p in (text.find(bytes([c]), cut) for c in SPACES) if p >= 0]
            found = min(later, default=len(text))
        yield text[at:found + 1]
        at = found + 1
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word (maximal run of bytes other than ASCII white space)."""
    out = [_piece_hashes(p) for p in _pieces(text)]
    return out[0] if len(out) == 1 else np.concatenate(out)


def _piece_hashes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, dtype=np.uint8)
    inside = np.empty(len(a) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_IS_SPACE[a], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    h = _segment_hash(_BYTE[a], starts, ends, _B1)
    return mix(h + (ends - starts).astype(np.uint64) * U64(_B2))


def window_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """64-bit hash of every window of ``size`` consecutive words (empty if fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size > 64:
        at = np.arange(n)
        return mix(_segment_hash(words, at, at + size, _W2 if second else _W1) + U64(size))
    base = U64(_W2 if second else _W1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h *= base
        h += words[j:j + n]
    return mix(h + U64(size))


# ---------------------------------------------------------------- buckets

def bucket_count(spark: SparkSession, total_bytes: int, target: int = 16 << 20) -> int:
    """Number of buckets that keeps each near ``target`` bytes and gives every shuffle partition work.

    A batch sends at most one record to each bucket, so more buckets than needed only cost records.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // target))


def text_bytes(docs: DataFrame) -> int:
    from pyspark.sql import functions as F
    return docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def split(keys: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each array's part) for every bucket that ``keys`` (uint64) fall into, rows in their order."""
    if not len(keys):
        return
    b = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    sorted_arrays = [a[order] for a in arrays]
    for part, *parts in zip(np.split(b[order], cuts), *(np.split(a, cuts) for a in sorted_arrays)):
        yield (int(part[0]), *(p.tobytes() for p in parts))


def joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """All binary values of a column as one array."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype=dtype)


def to_table(rows: list[tuple], arrow: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_to_batch(rows, arrow)], schema=arrow)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys each row of sorted arrays belongs to."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)
