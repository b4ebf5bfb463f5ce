"""Shard files: every record at its slot, resumed reads, repeated writes."""
import os
import tempfile

import pytest

from vigil.llm import shard_files, training_order


@pytest.fixture(scope="module")
def order(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 30)) for i in range(200)], "doc_id long, text string").repartition(3).cache()
    return training_order.shards(docs, length=64, per_shard=10).cache()


def test_slots_are_seeks(spark, order):
    folder = tempfile.mkdtemp(prefix="vigil-shards-", dir="/tmp") + "/out"
    want = [bytes(r.data) for r in training_order.read_from(order, 0, 64, 10).orderBy("slot").collect()]
    for _ in range(2):                                       # a second run leaves the same files
        manifest = shard_files.write(order, folder, length=64, per_shard=10)
        assert manifest == {"stride": 128, "per_shard": 10, "shards": -(-len(want) // 10), "records": len(want)}
        assert sorted(os.listdir(folder)) == ["manifest.json", *[f"shard-{i:08d}.bin" for i in range(manifest["shards"])]]
    for shard in (0, manifest["shards"] - 1):
        with open(f"{folder}/shard-{shard:08d}.bin", "rb") as f:
            assert f.read() == b"".join(want[shard * 10:shard * 10 + 10])
    reader = shard_files.Reader(folder)
    assert len(reader) == len(want) and list(reader.records()) == want
    for slot in (0, 1, 9, 10, 17, len(want) - 1):
        assert reader[slot] == want[slot] and list(reader.records(slot)) == want[slot:] and list(reader.records(slot, 1)) == want[slot:slot + 1]
    assert list(reader.records(len(want))) == []
    for bad in (-1, len(want)):
        with pytest.raises(IndexError):
            reader[bad]
    with pytest.raises(IndexError):
        next(reader.records(3, len(want)))
    for slot in (0, 17, len(want) - 1):
        got = shard_files.scan(spark, "file://" + folder, slot).collect()
        assert sorted((r.slot, bytes(r.data)) for r in got) == list(enumerate(want))[slot:]
    os.unlink(folder + "/shard-00000000.bin")                # a read from slot 10 on does not open it
    assert list(reader.records(10)) == want[10:] and shard_files.scan(spark, folder, 10).count() == len(want) - 10


def test_incomplete_orders_and_empty_tables(spark, order):
    folder = tempfile.mkdtemp(prefix="vigil-shards-", dir="/tmp")
    with pytest.raises(ValueError):
        shard_files.write(order.where("shard <> 1"), folder, length=64, per_shard=10)
    assert not os.path.exists(folder + "/manifest.json")
    assert shard_files.write(order.limit(0), folder, length=64, per_shard=10)["records"] == 0
    assert list(shard_files.Reader(folder).records()) == [] and shard_files.scan(spark, folder).count() == 0
