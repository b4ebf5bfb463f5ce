"""Stage switches, the stratified split, and invariants of the randomised models."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluate as E
from vigil.operators import features as FEAT
from vigil.operators import forest as M
from vigil.operators import lof as L
from vigil.operators import tiers as T
from vigil.plans import runs as R

FEATS = ["file_rate", "device_rate", "logon_rate"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        odd = i >= 280
        x = rng.normal(size=3) + (25 if odd else 0)
        rows.append((f"u{i % 30}" if not odd else f"bad{i % 4}", f"s{i:03d}", *[float(v) for v in x]))
    m = spark.createDataFrame(rows, "user_id string, session_id string, file_rate double, device_rate double, logon_rate double").persist()
    scores = L.dblof_scores(m, contamination=0.1, k=25).persist()
    insiders = spark.createDataFrame([(f"bad{i}",) for i in range(4)], "user_id string")
    return m, scores, insiders


@pytest.mark.parametrize("ensemble", [False, True])
@pytest.mark.parametrize("supervised", [False, True])
def test_every_switch_combination(data, ensemble, supervised):
    m, scores, insiders = data
    run = R.reduce_false_positives(scores, m, insiders, 80, ensemble, supervised)
    assert ("ensemble_outlier" in run.rows.columns) == ensemble and ("supervised_outlier" in run.rows.columns) == supervised
    final = "supervised_outlier" if supervised else "ensemble_outlier" if ensemble else "context_filtered_outlier"
    stages = {r.stage: r for r in run.metrics.collect()}
    assert stages["final"].flag_column == final and stages["original"].flag_column == "is_outlier"
    assert run.rows.count() == 300 and (run.importances is not None) == supervised
    for r in run.improvement.collect():
        assert r.improvement_pp == pytest.approx((stages["final"][r.metric] - stages["original"][r.metric]) * 100)
    if ensemble:
        bad = run.rows.where("ensemble_outlier AND NOT (context_filtered_outlier AND iso_outlier)").count()
        assert bad == 0
    if supervised:
        t = run.test_metrics.first()
        assert t.tp + t.fn == 6 and t.tn + t.fp == 84             # 30 % of 20 insider rows and of 280 others
        assert {r.feature for r in run.importances.collect()} == {*FEATS, "anomaly_score"}
        assert run.importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_threshold_option(data):
    m, scores, insiders = data
    kept = [R.reduce_false_positives(scores, m, insiders, p, False, False).rows.where("high_confidence_outlier").count() for p in (0, 50, 80, 100)]
    assert kept[0] == scores.where("is_outlier").count() and kept == sorted(kept, reverse=True) and kept[-1] >= 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_holds_within_each_label(spark, partitions):
    rows = [(f"u{i % 11}", f"s{i}", 1 if i < 53 else 0 if i < 1000 else 2) for i in range(1001)] + [("x", "y", None)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, y int").repartition(partitions)
    out = M.stratified_split(df, "y", [0, 1, 2, 3], ["user_id", "session_id"], 0.7, 42)
    got = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("t")).collect()}
    for y, n in ((0, 947), (1, 53), (2, 1)):
        assert got[y][0] == n and abs(got[y][1] - 0.7 * n) <= 1
    assert got[None] == (1, 0)
    again = M.stratified_split(df.repartition(3), "y", [0, 1, 2], ["user_id", "session_id"], 0.7, 42)
    assert {r.session_id for r in out.where("train").collect()} == {r.session_id for r in again.where("train").collect()}


def test_isolation_forest_invariants(data):
    m, _, _ = data
    a, b = (M.isolation_forest_flags(m.repartition(p), FEATS, contamination=0.1).orderBy("session_id").collect() for p in (1, 5))
    assert [(r.session_id, round(r.if_score, 9)) for r in a] == [(r.session_id, round(r.if_score, 9)) for r in b]     # no matter the partitions
    assert all(0 < r.if_score < 1 for r in a) and sum(r.iso_outlier for r in a) == 30
    far = m.unionByName(m.limit(1).select(F.lit("far").alias("user_id"), F.lit("far").alias("session_id"), *[F.lit(v).alias(c) for c, v in zip(FEATS, (-90.0, 140.0, 300.0))]))
    scores = {r.session_id: r.if_score for r in M.isolation_forest_flags(far, FEATS, contamination=0.1).collect()}
    assert max(scores, key=scores.get) == "far"
    planted, others = ([v for s, v in scores.items() if s != "far" and (s >= "s280") == odd] for odd in (True, False))
    assert np.mean(planted) > np.quantile(others, 0.9)


def test_peer_groups_find_planted_groups(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0, 0], [50, 0, 0, 0], [0, 50, 0, 9]])
    rows = [(f"u{i:03d}", *map(float, centres[i % 3] + rng.normal(size=4))) for i in range(90)]
    users = spark.createDataFrame(rows, "user_id string, file_rate double, logon_rate double, device_rate double, http_rate double")
    for p in (1, 4):
        got = {r.user_id: r.peer_group for r in FEAT.kmeans_peer_groups(users.repartition(p), k=3, n_init=3).collect()}
        # Groups are numbered by their centroids: third, first and second planted one never mix.
        assert len(got) == 90 and all(got[f"u{i:03d}"] == got[f"u{i % 3:03d}"] for i in range(90)) and len(set(got.values())) == 3
        assert got["u001"] == 2


def test_alerts_of_every_switch(spark, data):
    _, scores, _ = data
    intent = scores.where("is_outlier").select("user_id", "session_id", F.lit(0.2).alias("intent_score"))
    graph = scores.select("user_id").distinct().limit(10).withColumn("overall_risk_score", F.lit(0.9))
    called = []
    make = lambda name, df: lambda: called.append(name) or df
    for cre in (False, True):
        for utcg in (False, True):
            called.clear()
            out = R.integrated(scores, make("intent", intent), make("graph", graph), cre, utcg).collect()
            assert called == ["intent"] * cre + ["graph"] * utcg and len(out) == 300
            users = {r.user_id for r in graph.collect()}
            flagged = {r.session_id for r in intent.collect()}
            for r in out:
                want = 0.5 * r.score_0_1 + 0.3 * (0.8 if cre and r.session_id in flagged else 0) + 0.2 * (0.9 if utcg and r.user_id in users else 0)
                assert r.composite_risk == pytest.approx(want)
                assert r.risk_tier == ("high" if want > 0.7 else "medium" if want > 0.4 else "low")
    flat = T.alerts(scores.withColumn("anomaly_score", F.lit(1.0))).first()
    assert flat.score_0_1 is None and flat.composite_risk == 0.0
