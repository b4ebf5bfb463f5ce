"""Exact neighbours over the metric partition against brute force, and how little of the data it measures."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import knn as K


def brute(ids, x, qids, q, k, exclude):
    out = {}
    for i, v in zip(qids, q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        order = sorted((float(K.rank_key(d[j])), ids[j]) for j in range(len(ids)) if not (exclude and ids[j] == i))
        out[i] = [n for _, n in order[:k]]
    return out


def spread(kind, rng):
    if kind == "half equal":
        x = rng.normal(size=(400, 3))
        x[rng.random(400) < 0.5] = 1.0
    elif kind == "skewed":
        x = np.concatenate([rng.normal(size=(300, 4)) * 0.01, rng.normal(size=(80, 4)) * 10 + 50, 10.0 ** rng.uniform(-3, 5, (60, 4))])
    elif kind == "grid":
        x = rng.integers(0, 4, (500, 3)).astype(float)
    elif kind == "line":
        x = np.arange(300.0)[:, None]
    elif kind == "one place":
        x = np.zeros((90, 2))
    else:
        x = rng.normal(size=(350, 24))
    return x


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<double>").repartition(3)


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append(r["nbr"])
    return out


@pytest.mark.parametrize("kind,cell_rows", [("half equal", 16), ("skewed", 2048), ("skewed", 16), ("grid", 2048), ("line", 16), ("one place", 16),
                                            ("many dimensions", 32)])
def test_self_neighbours(spark, kind, cell_rows):
    x = spread(kind, np.random.default_rng(11))
    ids = [f"p{(i * 7919) % len(x):04d}" for i in range(len(x))]
    assert lists(K.knn(frame(spark, ids, x), 9, block_rows=cell_rows).collect()) == brute(ids, x, ids, x, 9, True)


@pytest.mark.parametrize("kind", ["half equal", "skewed"])
def test_query_neighbours(spark, kind):
    rng = np.random.default_rng(5)
    x = spread(kind, rng)
    q = np.concatenate([x[::7], np.repeat(x[:1], 40, axis=0), rng.normal(size=(30, x.shape[1])) * 100])
    ids, qids = [f"b{i:04d}" for i in range(len(x))], [f"q{i:04d}" for i in range(len(q))]
    got = lists(K.knn_query(frame(spark, qids, q), frame(spark, ids, x), 6, block_rows=32).collect())
    assert got == brute(ids, x, qids, q, 6, False)


def test_pivot_bound_leaves_large_cells_in_parts(spark):
    x = np.random.default_rng(2).normal(size=(600, 2))
    ids = [f"{i:04d}" for i in range(600)]
    base = K.distinct_points(frame(spark, ids, x), 4)
    found, cells, summary = K.search_plan(None, base, 4, cell_rows=20, max_pivots=5)
    assert len(summary.pivots.vecs) == 5 and summary.n.max() < 60 and len(summary.number) > 25
    near = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, 4).alias("near")
    got = {r["id"]: [n["nbr"] for n in r["near"]] for r in K._candidates(found, cells, summary, 4).groupBy("id").agg(near).collect()}
    assert got == brute(ids, x, ids, x, 4, False)


def test_measures_far_fewer_than_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(6000, 6)) + rng.integers(0, 12, (6000, 1)) * 8)
    base = K.distinct_points(frame(spark, [f"{i:05d}" for i in range(6000)], x), 11)
    found, cells, summary = K.search_plan(None, base, 11)
    met = found.join(cells.select("cell", F.size("points").alias("c")), "cell").agg(F.sum(F.col("n") * F.col("c"))).first()[0]
    assert met < 0.25 * 6000 ** 2 / 2


def test_no_points_and_odd_rows(spark):
    schema = "id string, vec array<double>"
    assert K.knn(spark.createDataFrame([], schema), 3).count() == 0
    assert K.knn(spark.createDataFrame([("a", [1.0])], schema), 3).count() == 0
    odd = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", None), (None, [0.0]), ("d", [float("nan")]), ("e", [None]), ("f", [-0.0])], schema)
    assert lists(K.knn(odd, 1, n=3).collect()) == {"a": ["f"], "f": ["a"], "b": ["a"]}
    assert K.knn_query(odd, spark.createDataFrame([], schema), 2).count() == 0


def test_comparison_key_keeps_the_order(spark):
    d = np.sort(np.concatenate([10.0 ** np.random.default_rng(1).uniform(-12, 14, 4000), [99.9, 100.1, 9999.9, 10000.1, 0.0]]))
    key = K.rank_key(d)
    assert (np.diff(key) >= 0).all() and np.allclose(key, d, rtol=1e-6, atol=1e-9)
    got = spark.createDataFrame([(float(v),) for v in d], "d double").select("d", K.rank_key_col(F.col("d")).alias("k"), K.rank_key_col(-F.col("d")).alias("m"))
    assert [r.k for r in got.orderBy("d").collect()] == key.tolist()
    negative = [r.m for r in got.orderBy(F.col("d").desc()).collect()]
    assert (np.diff(negative) >= 0).all()


def test_vectors_are_sent_in_few_bytes(spark):
    """Vectors of single precision take four bytes a value on their way, others eight; nothing is rounded."""
    x = np.random.default_rng(3).normal(size=(900, 16))
    single = x.astype(np.float32).astype(np.float64)
    mixed = np.where(np.arange(900)[:, None] % 2, single, x)
    for v, size in ((single, 4), (x, 8), (mixed, 8)):
        assert len(K._packed(v)) == size * v.size and (K._unpacked(K._packed(v), *v.shape) == v).all()
    ids = [f"{i:04d}" for i in range(900)]
    found, cells, _ = K.search_plan(None, K.distinct_points(frame(spark, ids, single), 5), 5, cell_rows=64)
    sent = found.where("ids is not null").agg(F.sum(F.length("vecs")), F.sum(F.size("ids"))).first()
    assert sent[0] == 4 * 16 * sent[1]
    assert K._packed_cells(cells).agg(F.sum(F.length("vecs"))).first()[0] == 4 * 900 * 16
    far = np.array([[1e300, -0.0], [np.pi, 1.0]])
    assert (K._unpacked(K._packed(far), 2, 2) == far).all()
