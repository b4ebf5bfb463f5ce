"""The permutation is a bijection; shards hold every packed sequence once and resume at any slot."""

import numpy as np
import pytest

from vigil.llm import packing, training_order


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(total):
    got = training_order.permute(np.arange(total), total)
    assert sorted(got) == list(range(total))
    assert total < 64 or (got != training_order.permute(np.arange(total), total, key=7)).any()


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(300)] + [(None, None)], "doc_id long, text string")
    docs = docs.repartition(3).cache()
    seqs = training_order.sequences(docs, length=64, window_tokens=3000).collect()
    pieces = packing.pack(docs, length=64, window_tokens=3000).collect()
    assert sum(r.n_tokens for r in seqs) == sum(r.length for r in pieces)
    written = training_order.shards(docs, length=64, per_shard=10)
    rows = training_order.read_from(written, 0, 64, 10).orderBy("slot").collect()
    n = training_order.sequences(docs, length=64).count()
    assert [r.slot for r in rows] == list(range(n))
    plain = sorted(bytes(r.tokens).ljust(128, b"\0") for r in training_order.sequences(docs, length=64).collect())
    assert sorted(bytes(r.data) for r in rows) == plain
    assert training_order.read_from(written, 17, 64, 10).count() == n - 17
    assert training_order.shards(docs.limit(0)).count() == 0
