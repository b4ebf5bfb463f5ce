"""The session matrix at scale: one event shuffle, no join by peer group, and the forest's walk against a direct one."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import features as FEAT
from vigil.operators import forest as FOREST
from vigil.operators.sessions import sessionize
from vigil.session import release


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _events(spark):
    rng = np.random.default_rng(5)
    kinds = ["logon", "file", "http", None]
    rows = [(f"e{i:04d}", f"u{rng.integers(5)}", None if i % 50 == 0 else f"2024-01-{1 + rng.integers(4):02d} {rng.integers(24):02d}:00:00",
             kinds[rng.integers(4)], "text") for i in range(400)]
    return (spark.createDataFrame(rows, "event_id string, user_id string, t string, activity_type string, email_content string")
                 .withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t"))


def test_matrix_equals_its_steps_over_sessionized_events(spark):
    ev = _events(spark)
    got = {(r.user_id, r.session_id): r for r in FEAT.session_feature_matrix(ev, 120, peers=None).collect()}
    release()
    by_day, sessions = {}, {}
    for r in sorted(sessionize(ev, 120).collect(), key=lambda r: (r.user_id, r["_day"], r.timestamp is None, r.timestamp or 0, r.event_id)):
        by_day.setdefault((r.user_id, r["_day"]), []).append(r)
        sessions.setdefault((r.user_id, r.session_id), []).append(r)
    assert set(got) == set(sessions)
    for key, rows in sessions.items():
        files = [r.activity_type == "file" for r in rows]
        assert got[key].event_cnt == len(rows)
        assert got[key].file_burst == sum(all(files[i - 2:i + 1]) for i in range(2, len(files)))
        a = [r.activity_type for r in by_day[key[0], rows[0]["_day"]]] if rows[0].timestamp else []
        assert got[key]["2gram_diversity"] == len({p for p in zip(a, a[1:]) if p[1] is not None})
        assert got[key]["3gram_diversity"] == len({p for p in zip(a, a[1:], a[2:]) if p[2] is not None})


def test_no_join_by_peer_group_and_no_wide_events(spark):
    ev = _events(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        peers = ev.select("user_id").distinct().withColumn("peer_group", F.lit("one"))
        plan = _plan(FEAT.session_feature_matrix(ev, 120, peers=peers))
        release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # A join by shuffle holds all sessions of a peer group in one task.
    assert "SortMergeJoin [peer_group" not in plan
    # Neither are columns kept that no feature reads, nor rows expanded for distinct counts.
    assert "Expand" not in plan
    assert not any("InMemoryRelation" in line and "email_content" in line for line in plan.splitlines())


def test_forest_scores_equal_a_direct_walk(spark):
    x = np.random.default_rng(2).normal(size=(300, 3))
    pts = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    nodes = FOREST.fit_isolation_forest(pts, len(x), 7, 64).toPandas()
    got = {r.id: r.if_score for r in FOREST.score_isolation_forest(pts, spark.createDataFrame(nodes), 64).collect()}
    trees = [g.set_index("node") for _, g in nodes.groupby("tree")]
    for i in range(0, 300, 17):
        paths = []
        for t in trees:
            node, depth = t.loc[0], 0
            while node.left_child >= 0:
                node, depth = t.loc[node.left_child if x[i, int(node.feature)] <= node.threshold else node.right_child], depth + 1
            paths.append(depth + FOREST.average_path_length([node["size"]])[0])
        want = 2.0 ** (-np.mean(paths) / FOREST.average_path_length([64])[0])
        assert got[f"p{i}"] == pytest.approx(want, rel=1e-12)
