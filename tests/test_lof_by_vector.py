"""LOF from the lists of distinct vectors against the same steps on the rows of all points, and rows that a search sends."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import knn as K
from vigil.operators import lof as L


def _frame(spark, x):
    return spark.createDataFrame([(f"p{(i * 7919) % len(x):05d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>").repartition(3)


def _cases(kind, rng):
    if kind == "copies":
        x = rng.normal(size=(300, 3))
        return np.concatenate([x, x[:90], x[:40], np.repeat(x[:1], 30, axis=0)])
    if kind == "within a tie":                  # vectors nearer than a tie's width share the places of a list
        x = np.repeat(rng.normal(size=(40, 2)), 8, axis=0)
        return x + rng.integers(0, 2, x.shape) * 1e-10
    return rng.normal(size=(200, 12))


@pytest.mark.parametrize("kind", ["copies", "within a tie", "spread"])
def test_equals_the_rows_of_all_points(spark, kind):
    points = _frame(spark, _cases(kind, np.random.default_rng(4)))
    n = points.count()
    found = K.neighbour_lists(points, 10, block_rows=32)
    for k in (3, 9):
        want = {r.id: (r.lrd, r.lof) for r in L.lof_from_neighbours(K.knn(points, 9, n=n), k).collect()}
        got = {r.id: (r.lrd, r.lof) for r in L.lof_by_vector(found, k).collect()}
        assert got.keys() == want.keys() and len(got) == n
        assert np.allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(got)], rtol=1e-9)


def test_a_vector_is_sent_once_to_a_block(spark):
    """Where bounds rule nothing out every query looks into every cell: vectors sent grow with the blocks."""
    x = np.random.default_rng(6).normal(size=(4000, 48))
    base = K.distinct_points(_frame(spark, x), 6)
    found, cells, summary = K.search_plan(None, base, 6, cell_rows=100)
    looks, sent = found.agg(F.sum("n"), F.sum(F.size("ids"))).first()
    blocks = len(np.unique(summary.block))
    assert looks > 20 * 4000 and blocks < 4 and sent <= blocks * 4000
