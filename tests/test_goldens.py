"""Hand-derived goldens for normalisation, context, graph, baselines,
feedback, scans, fairness, tiers and evaluation."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil.operators import baseline as BL, context as C, evaluate as EVAL, fairness as FAIR
from vigil.operators import feedback as FB, graph as G, scan as SCAN, tiers as TIER
from vigil.operators.normalize import etl_session_id, parse_timestamp, extract_dates


def test_etl_session_id(spark):
    df = spark.createDataFrame([("ACM2278", "PC-1648", "01/02/2010 08:28:06"),
                                ("CMP2946", "PC-2190", "01/03/2010 08:30:15")], "u string, p string, d string")
    got = [r[0] for r in df.select(etl_session_id(F.col("u"), F.col("p"), F.col("d"))).collect()]
    assert got == ["092a0dd0726b", "950596f3b7a3"]


def test_timestamp_formats(spark):
    df = spark.createDataFrame([("1/2/2010 8:28",), ("2010-01-02T08:28:06Z",), ("31-12-2010 08:28",), ("x",), ("",)],
                               "d string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("d"))).collect()]
    assert got == [datetime(2010, 1, 2, 8, 28), datetime(2010, 1, 2, 8, 28, 6), datetime(2010, 12, 31, 8, 28),
                   None, None]


def test_extract_dates_time_only_is_null(spark):
    df = spark.createDataFrame([("on 2024-01-02 03:04:05 and 10:11:12",)], "t string")
    got = df.select(extract_dates(F.col("t"))).first()[0]
    assert got[0] == 1704164645.0 and got[1] == 1704153600.0 and got[-1] is None


def _acts(spark, rows):
    return spark.createDataFrame(rows, "role string, project string, action string, timestamp timestamp_ntz")


def test_rule_scores(spark):
    tue = datetime(2024, 1, 2)
    rows = [("Engineer", "Gamma", "file_access", tue.replace(hour=18, minute=59)),
            ("Engineer", "Gamma", "file_access_bulk", tue.replace(hour=23, minute=30)),
            ("Engineer", "Alpha", "delete_user", datetime(2024, 1, 6, 10)),
            ("engineer", "Gamma", "email_send", tue.replace(hour=10)),
            ("unknown", "unknown", "code_commit", tue.replace(hour=10))]
    out = C.rule_scores(_acts(spark, rows), C.role_permissions_table(spark), C.temporal_rules_table(spark),
                        C.project_lifecycles_table(spark)).collect()
    by = {(r.role, r.action): r for r in out}
    assert [by[("Engineer", a)].role_score for a in ("file_access", "file_access_bulk", "delete_user")] == [1.0, 0.7, 0.2]
    assert by[("engineer", "email_send")].role_score == 0.5
    assert [by[("Engineer", a)].time_score for a in ("file_access", "file_access_bulk", "delete_user")] == [1.0, 0.5, 0.3]
    assert by[("unknown", "code_commit")].time_score == 0.8
    assert by[("Engineer", "file_access")].project_score == 0.4
    assert by[("engineer", "email_send")].project_score == 0.6
    assert by[("Engineer", "delete_user")].project_score == 0.6
    assert by[("unknown", "code_commit")].project_score == 0.7


def test_intent_of_unknown_context(spark):
    df = spark.createDataFrame([(0.5, 0.8, 0.7, "x", "r", "p", None)],
                               "role_score double, time_score double, project_score double, action string, "
                               "role string, project string, timestamp timestamp_ntz")
    df = df.withColumn("intent_score", C.intent_score())
    lab, risk = C.intent_label(F.col("intent_score"))
    r = df.select("intent_score", lab.alias("l"), risk.alias("k")).first()
    assert abs(r.intent_score - 0.65) < 1e-12 and r.l == "suspicious" and r.k == "medium"


def test_cross_domain_patterns(spark):
    ev = spark.createDataFrame([("a", "PC1"), ("a", "PC2"), ("a", "PC3"), ("b", "PC1"), ("b", "PC2"), ("b", "PC3")],
                               "user_id string, pc_id string")
    hr = spark.createDataFrame([("b", "Engineer", "IT", False, None, 10)],
                               "user_id string, role string, department string, manager_level boolean, "
                               "hire_date date, tenure_days int")
    users, assets, hrs = G.user_vertices(ev), G.asset_vertices(ev), G.hr_vertices(hr)
    edges = G.simple_edges(G.relations(ev, hr))
    p = {r.user_id: r for r in G.cross_domain_patterns(G.vertices(users, assets, hrs, edges), edges).collect()}
    assert (p["a"].pattern_count, p["a"].overall_risk_score) == (1, 0.15)
    assert (p["b"].pattern_count, p["b"].overall_risk_score) == (2, 0.3)
    assert "c" not in p


def test_decayed_mean_and_sigmoid(spark):
    w = spark.createDataFrame([("u", 1.0, 3), ("u", 2.0, 2), ("u", 3.0, 1)], "user_id string, x double, recency int")
    assert abs(BL.decayed_baseline(w, ["x"]).first().x - 2.034181) < 1e-6
    s = spark.createDataFrame([("u", "s0", 0.0), ("u", "s1", 1.0), ("u", "s3", 3.0)], "user_id string, session_id string, x double")
    base = spark.createDataFrame([("u", 0.0)], "user_id string, x double")
    stats = spark.createDataFrame([("x", 0.0, 1.0, 0.0, 0.0)], "feature string, mean double, std double, min double, max double")
    got = {r.session_id: r.baseline_anomaly_score for r in BL.anomaly_scores(s, base, stats, ["x"]).collect()}
    assert abs(got["s0"] - 0.119203) < 1e-6 and abs(got["s1"] - 0.268941) < 1e-6 and abs(got["s3"] - 0.731059) < 1e-6


@pytest.mark.parametrize("n_far,drift", [(3, False), (4, True)])
def test_threshold_drift(spark, n_far, drift):
    feats = [f"f{i}" for i in range(10)]
    latest = spark.createDataFrame([tuple(["u"] + [5.0 if i < n_far else 0.0 for i in range(10)])],
                                   "user_id string, " + ", ".join(f"{f} double" for f in feats))
    base = spark.createDataFrame([tuple(["u"] + [0.0] * 10)], "user_id string, " + ", ".join(f"{f} double" for f in feats))
    stats = spark.createDataFrame([(f, 0.0, 1.0, 0.0, 0.0) for f in feats], "feature string, mean double, std double, min double, max double")
    assert BL.drift_flags(latest, base, stats, feats).first().drift_detected is drift


def test_feedback_threshold(spark):
    fb = spark.createDataFrame([("d", 1, datetime(2024, 1, 1, 1), 0.75, "false_positive"),
                                ("d", 2, datetime(2024, 1, 2, 1), 0.2, "false_positive")],
                               "k string, o int, ts timestamp_ntz, prediction_score double, analyst_decision string")
    r1 = FB.adaptive_thresholds(fb.where("o = 1"), "k", ["ts", "o"], "ts").first()
    r2 = FB.adaptive_thresholds(fb, "k", ["ts", "o"], "ts").first()
    assert abs(r1.current_threshold - 0.5025) < 1e-12 and abs(r2.current_threshold - 0.5105) < 1e-12
    assert r2.total_feedback == 2 and r2.false_positives == 2


def test_feedback_clips_after_every_item(spark):
    rows = [("d", i, datetime(2024, 1, 1 + i // 50, 1, i % 50), 1.0, "true_positive") for i in range(60)]
    rows += [("d", 100, datetime(2024, 1, 3), 0.0, "false_positive")]
    fb = spark.createDataFrame(rows, "k string, o int, ts timestamp_ntz, prediction_score double, analyst_decision string")
    t = 0.5
    for _, _, _, s, d in sorted(rows, key=lambda r: (r[2], r[1])):
        t = min(max(t + (0.01 * (1 - s) if d == "false_positive" else -0.01 * s), 0.1), 0.9)
    assert abs(FB.adaptive_thresholds(fb, "k", ["ts", "o"], "ts").first().current_threshold - t) < 1e-12


def test_leak_scan(spark):
    df = spark.createDataFrame([(1, "SSN 987-65-4321"), (2, "credit card 4111-1111-1111-1111"), (3, "salary 78910")],
                               "id int, t string")
    got = {(r.id, r.pattern_matched): list(r.matches) for r in SCAN.detect_leakage(df, "t", ["id"]).collect()}
    assert got == {(1, "ssn"): ["987-65-4321"], (2, "credit_card"): ["4111-1111-1111-1111"]}


def test_fairness_disparity(spark):
    g1 = spark.createDataFrame([(0.1,), (0.31,)], "flag_rate double")
    g2 = spark.createDataFrame([(0.1,), (0.3,)], "flag_rate double")
    assert FAIR.disparity(g1).first().bias_detected is True
    assert FAIR.disparity(g2).first().bias_detected is False


def test_risk_tiers(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.41,), (0.4,)], "s double")
    assert [r[0] for r in df.select(TIER.risk_tier(F.col("s"))).collect()] == ["high", "medium", "medium", "low"]


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(False, 1), (False, 0)], "p boolean, true_label int")
    r = EVAL.confusion_metrics(df, "p").first()
    assert (r.precision, r.f1_score, r.tp, r.fn, r.tn) == (0.0, 0.0, 0, 1, 1)


def test_adwin_detects_a_level_shift():
    from vigil.operators.baseline import _adwin_flags
    flags = _adwin_flags([0.0] * 60 + [5.0] * 60)
    assert not any(flags[:60]) and any(flags[60:])
    assert not any(_adwin_flags([1.0] * 100))
