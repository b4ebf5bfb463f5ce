"""Training-order materialisation by a keyed Feistel permutation.

Packed sequences get a dense index from per-window counts.  A balanced Feistel
network over the smallest even number of bits, walked until it falls below the
number of sequences, permutes the index to a global slot.  Sequences are range
partitioned by slot and written as shards of a fixed number of records of a
fixed stride, so slot k is record k % per_shard of shard k // per_shard, and a
reader resumes at any slot.

Defined results: the tokens are those of ``packing`` (null and empty texts give
the end id); short sequences are padded with ``pad``; repeated rows are
sequences of their own; an empty table gives no shards.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, _schemas, _to_batch, add_columns, broadcast_if_small, checkpoint, mix
from .packing import END_ID, LENGTH, WINDOW_TOKENS, assign, default_tokenizer, encoder

KEY = 20_240_501
ROUNDS = 6
PER_SHARD = 1024
PAD = 0
#: Bytes of one token in a shard; the vocabulary must fit.
TOKEN = np.dtype("<u2")


def permute(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Bijection of 0 .. total - 1 for each key."""
    half = max(1, -(-max(1, total - 1).bit_length() // 2))
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + U64(key) * U64(ROUNDS))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << shift | right

    out = network(index.astype(np.uint64))
    while (walk := out >= U64(total)).any():
        out[walk] = network(out[walk])
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
              window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """(sequence_id, n_tokens, tokens): whole packed sequences, as ``packing.pack`` lays them out."""
    path = tokenizer or default_tokenizer()
    out, arrow = _schemas(docs.sparkSession, "sequence_id long, n_tokens long, tokens binary")

    def flush(held: list[np.ndarray], window: int) -> pa.RecordBatch:
        first = TaskContext.get().partitionId() << 40 | window << 20
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for d, start, n, s, offset in assign([len(x) for x in held], length):
            parts.setdefault(s, []).append((offset, held[d][start:start + n]))
        rows = []
        for s in sorted(parts):
            tokens = np.concatenate([x for _, x in sorted(parts[s], key=lambda p: p[0])])
            rows.append((first + s, len(tokens), tokens.tobytes()))
        return _to_batch(rows, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, size, window = encoder(path), [], 0, 0
        if max(enc.tokenizer.get_vocab_size() - 1, end_id) > np.iinfo(TOKEN).max:
            raise ValueError("the vocabulary does not fit into the token type")
        for batch in batches:
            for text in batch.column(0):
                ids = np.append(np.frombuffer(enc.encode(text.as_py() or ""), "<u4"), end_id).astype(TOKEN)
                held.append(ids)
                size += len(ids)
                if size >= window_tokens:
                    yield flush(held, window)
                    held, size, window = [], 0, window + 1
        if held:
            yield flush(held, window)

    return docs.select("text").mapInArrow(run, out)


def slots(seqs: DataFrame, key: int = KEY) -> DataFrame:
    """``seqs`` with its global ``slot``."""
    window, part = F.shiftright("sequence_id", 20), F.shiftright("sequence_id", 40)
    counts = seqs.groupBy(window.alias("window"), part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("base"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("window")) - F.col("n")
    starts = broadcast_if_small(counts.withColumn("inside", inside).join(parts, "part")
                                .select("window", (F.col("base") + F.col("inside")).alias("start")))
    total = seqs.count()
    indexed = seqs.join(starts, window == F.col("window")).withColumn(
        "index", F.col("start") + F.col("sequence_id").bitwiseAND((1 << 20) - 1)).drop("window", "start")
    return add_columns(indexed, ["index"], "slot long",
                       lambda i: [(int(s),) for s in permute(np.array(i, dtype=np.int64), total, key)]).drop("index")


def shards(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, key: int = KEY, per_shard: int = PER_SHARD,
           pad: int = PAD) -> DataFrame:
    """(shard, first_slot, n_sequences, data): one row per shard, in ranges of shards and sorted in each; write it as Parquet."""
    placed = slots(checkpoint(sequences(docs, tokenizer, length)), key).withColumn("shard", F.floor(F.col("slot") / per_shard))
    out, arrow = _schemas(docs.sparkSession, "shard long, first_slot long, n_sequences long, data binary")
    stride = length * TOKEN.itemsize
    filler = np.full(length, pad, dtype=TOKEN).tobytes()

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["slot"].to_pylist(), table["tokens"].to_pylist()))
        data = b"".join(t + filler[len(t):stride] for _, t in rows)
        return pa.Table.from_batches([_to_batch([(table["shard"][0].as_py(), rows[0][0], len(rows), data)], arrow)], schema=arrow)

    ranged = placed.select("shard", "slot", "tokens").repartitionByRange("shard")
    return ranged.groupBy("shard").applyInArrow(build, out)


def read_from(written: DataFrame, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, data) of all records from ``slot`` on; earlier shards are not read."""
    stride = length * TOKEN.itemsize
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_sequences") - 1))
    rows = written.where(F.col("shard") >= slot // per_shard).select("first_slot", "data", at.alias("k"))
    return rows.select((F.col("first_slot") + F.col("k")).alias("slot"),
                       F.expr(f"substring(data, cast(k * {stride} as int) + 1, {stride})").alias("data")).where(F.col("slot") >= slot)


def result(docs: DataFrame) -> DataFrame:
    """A digest per shard."""
    return shards(docs).select("shard", "first_slot", "n_sequences", F.length("data").cast("long").alias("n_bytes"),
                               F.sha2("data", 256).alias("data_sha256"))
