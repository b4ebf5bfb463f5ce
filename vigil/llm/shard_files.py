"""Shard files of a training order: slot k is a seek.

``write`` puts every shard of ``training_order.shards`` into one file of a shared
folder: ``per_shard`` records of ``stride`` bytes and nothing else, so that slot k
stands at byte ``k % per_shard * stride`` of file ``k // per_shard``.  The tasks write
their own shards, each under a name of its own first and then renamed, so a task
that runs again, or twice at once, leaves the same file.  A manifest of a few
numbers is written last; a folder without one is unfinished.

``Reader`` reads records in order from any slot with one seek, ``scan`` does so
with one task a shard.  The folder is a path or URI that pyarrow's file systems
open (local, HDFS, S3); it must be one that all executors share.

Defined results: an empty table gives a manifest of no records; files of an
earlier, longer run in the same folder lie beyond the manifest and are not read;
a slot outside the order is an ``IndexError``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _schemas, _to_batch, checkpoint, lean
from .training_order import LENGTH, PER_SHARD, TOKEN

MANIFEST = "manifest.json"
#: Records that a task of ``scan`` holds at a time.
READ = 256


def _open(folder: str) -> tuple[files.FileSystem, str]:
    if ":" in folder.split("/", 1)[0]:
        return files.FileSystem.from_uri(folder.rstrip("/"))
    return files.LocalFileSystem(), folder.rstrip("/")


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write(shards: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> dict:
    """Write the rows of ``training_order.shards`` as files and the manifest, which is returned."""
    stride = length * TOKEN.itemsize
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    out, arrow = _schemas(shards.sparkSession, "shard long, n_sequences long, sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        for batch in batches:
            rows = []
            for shard, n, data in zip(*(batch.column(i) for i in range(3))):
                data = data.as_buffer()
                if len(data) != n.as_py() * stride:
                    raise ValueError(f"shard {shard} does not hold {n} records of {stride} bytes")
                final = f"{path}/{_name(shard.as_py())}"
                draft = f"{path}/.{_name(shard.as_py())}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as f:
                    f.write(data)
                system.move(draft, final)
                rows.append((shard.as_py(), n.as_py(), hashlib.sha256(data).hexdigest()))
            yield _to_batch(rows, arrow)

    written = checkpoint(shards.select("shard", "n_sequences", "data").mapInArrow(lean(run), out))
    row = written.agg(F.count("*").alias("shards"), F.sum("n_sequences").alias("records"), F.max("shard").alias("last"),
                      F.count_if((F.col("n_sequences") != per_shard)).alias("short")).first()
    if row.shards and (row.last != row.shards - 1 or row.short > 1):
        raise ValueError("the shards are not those of one whole order")
    manifest = {"stride": stride, "per_shard": per_shard, "shards": row.shards, "records": row.records or 0}
    draft = f"{path}/.{MANIFEST}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(json.dumps(manifest).encode())
    system.move(draft, f"{path}/{MANIFEST}")
    return manifest


class Reader:
    """Records of a written order, from any slot on."""

    def __init__(self, folder: str):
        self.system, self.path = _open(folder)
        with self.system.open_input_file(f"{self.path}/{MANIFEST}") as f:
            self.manifest = json.loads(f.read())
        self.stride, self.per_shard = self.manifest["stride"], self.manifest["per_shard"]

    def __len__(self) -> int:
        return self.manifest["records"]

    def records(self, slot: int = 0, count: int | None = None) -> Iterator[bytes]:
        """``count`` records (all that follow, if None) from ``slot`` on: one seek, then sequential reads."""
        end = len(self) if count is None else slot + count
        if not 0 <= slot <= end <= len(self):
            raise IndexError(f"slots {slot} to {end} of {len(self)}")
        while slot < end:
            shard, at = divmod(slot, self.per_shard)
            with self.system.open_input_file(f"{self.path}/{_name(shard)}") as f:
                f.seek(at * self.stride)
                for _ in range(min(self.per_shard - at, end - slot)):
                    yield f.read(self.stride)
                    slot += 1

    def __getitem__(self, slot: int) -> bytes:
        if not 0 <= slot < len(self):
            raise IndexError(f"slot {slot} of {len(self)}")
        return next(self.records(slot, 1))


def scan(spark: SparkSession, folder: str, slot: int = 0) -> DataFrame:
    """(slot, data) of all records from ``slot`` on; a task a shard, earlier shards are not opened."""
    reader = Reader(folder)
    total, per_shard, stride = len(reader), reader.per_shard, reader.stride
    out, arrow = _schemas(spark, "slot long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, end = max(slot, shard * per_shard), min(total, (shard + 1) * per_shard)
                for at in range(first, end, READ):
                    n = min(READ, end - at)
                    yield _to_batch(list(zip(range(at, at + n), reader.records(at, n))), arrow)

    low, high = min(slot // per_shard, reader.manifest["shards"]), reader.manifest["shards"]
    return spark.range(low, high, numPartitions=max(1, high - low)).mapInArrow(lean(run), out)
