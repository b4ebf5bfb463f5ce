"""M7–M10 goldens on the four-point example and kNN invariants."""
import numpy as np
from pyspark.sql import functions as F

from vigil.operators import lof as L
from vigil.operators.knn import knn, knn_query, to_vectors


def _points(spark, xs):
    return spark.createDataFrame([(str(i), [float(x)]) for i, x in enumerate(xs)], "id string, vec array<double>")


def test_lof_golden(spark):
    pts = _points(spark, [0, 1, 2, 10])
    nb = knn(pts, 2, n=4)
    got = {r.id: sorted(x.nbr for x in nb.where(F.col("id") == r.id).collect()) for r in pts.collect()}
    assert got == {"0": ["1", "2"], "1": ["0", "2"], "2": ["0", "1"], "3": ["1", "2"]}
    sc = {r.id: (r.lrd, r.lof) for r in L.lof_from_neighbours(nb, 2).collect()}
    assert np.allclose([sc[i][0] for i in "0123"], [0.666667, 0.5, 0.666667, 0.117647], atol=1e-6)
    assert np.allclose([sc[i][1] for i in "0123"], [0.875, 1.333333, 0.875, 4.958333], atol=1e-6)


def test_contamination_label_golden(spark):
    pts = _points(spark, [0, 1, 2, 10])
    sc = L.lof_from_neighbours(knn(pts, 2, n=4), 2)
    thr = sc.agg(F.percentile(-F.col("lof"), F.lit(0.25))).first()[0]
    assert abs(thr - (-2.239583)) < 1e-6
    flagged = [r.id for r in L.label_outliers(sc, 0.25).where("is_outlier").collect()]
    assert flagged == ["3"]


def test_adaptive_defaults():
    assert L.adaptive_defaults(100) == (10, 0.05)
    assert L.adaptive_defaults(10000) == (50, 0.005)


def test_knn_matches_brute_force_across_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5))
    pts = spark.createDataFrame([(f"{i:04d}", x[i].tolist()) for i in range(300)], "id string, vec array<double>")
    nb = knn(pts, 7, block_rows=64, n=300)   # 5 hash blocks → 15 block pairs
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {f"{i:04d}": sorted(f"{j:04d}" for j in np.argsort(d[i], kind="stable")[:7]) for i in range(300)}
    got = {}
    for r in nb.collect():
        got.setdefault(r.id, []).append(r.nbr)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_knn_query_includes_exact_matches(spark):
    pts = _points(spark, [0, 1, 2, 10])
    nb = knn_query(pts, pts, 1, block_rows=2, n_base=4, n_queries=4)
    assert {(r.id, r.nbr, r.dist) for r in nb.collect()} == {("0", "0", 0.0), ("1", "1", 0.0),
                                                            ("2", "2", 0.0), ("3", "3", 0.0)}


def test_planted_outlier_ranks_first(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)).tolist() + [[15.0, 15.0, 15.0]]
    pts = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(x)], "id string, vec array<double>")
    sc = L.lof_from_neighbours(knn(pts, 10, n=201), 10)
    assert sc.orderBy(F.col("lof").desc()).first().id == "p200"
