"""Exact percentiles against numpy: ties, nulls, spread over many magnitudes, small brackets."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.quantiles import percentile, percentiles

SHARES = [0.0, 0.001, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]


@pytest.mark.parametrize("max_inside,accuracy", [(10_000, 10_000), (50, 100), (1, 20)])
def test_equals_linear_percentiles(spark, max_inside, accuracy):
    rng = np.random.default_rng(5)
    n = 4001
    cols = {"normal": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "half": np.where(rng.random(n) < 0.5, 0.0, 1.0),
            "one": np.full(n, 7.0), "spread": 10.0 ** rng.uniform(-300, 300, n), "neg": -np.exp(rng.normal(size=n) * 5)}
    rows = [tuple(None if (i + j) % 11 == 0 and j < 5 else float(c[i]) for j, c in enumerate(cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4).persist()
    got = percentiles(df, {c: F.col(c) for c in cols}, SHARES, accuracy, max_inside)
    for j, c in enumerate(cols):
        want = np.percentile([r[j] for r in rows if r[j] is not None], [100 * s for s in SHARES])
        assert np.allclose(got[c], want, rtol=1e-12, atol=0), c
    df.unpersist()


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (2.0, None)], "a double, b double")
    got = percentiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.0, 0.5, 1.0])
    assert got["a"][:2] == [1.0, 2.0] and math.isnan(got["a"][2]) and got["b"] == [None, None, None]
    assert percentile(df.limit(0), F.col("a"), 0.5) is None
    assert percentile(spark.createDataFrame([(3,)], "x int"), F.col("x"), 0.3) == 3.0


def test_ranks_of_a_column_share_its_sketch(spark, monkeypatch):
    """Many shares of a column cost one sketch, and a value meets the brackets once; NaN stays the largest value."""
    from vigil.functions import quantiles as Q
    rng = np.random.default_rng(2)
    x = np.where(rng.random(3000) < 0.3, np.nan, rng.normal(size=3000).round(2))
    df = spark.createDataFrame([(float(v), float(w)) for v, w in zip(x, rng.normal(size=3000))], "a double, b double").persist()
    sketches, approx = [], F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: sketches.append(1) or approx(*a))
    shares = [0.05, 0.1, 0.11, 0.2, 0.5, 0.65, 0.69, 0.9, 0.95]
    got = Q.percentiles(df, {"a": F.col("a"), "b": F.col("b")}, shares, 1000, 100)
    assert len(sketches) <= 2 * 2                             # there were two for every share of every column
    for c in ("a", "b"):
        v = np.sort([r[c] for r in df.collect()])
        want = [(1 - (s * 2999) % 1) * v[math.floor(s * 2999)] + ((s * 2999) % 1) * v[math.ceil(s * 2999)] for s in shares]
        assert np.allclose(got[c], want, rtol=1e-9, equal_nan=True)
    df.unpersist()
