"""Running baselines, drift flags, retrained versions and as-of lookups against direct loops."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import baseline as BL

SCHEMA = "user_id string, session_id string, session_start timestamp_ntz, x double, y double"


def sessions(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for u, n in (("hot", 400), ("b", 30), ("c", 3), ("one", 1)):
        t = datetime(2024, 1, 1)
        for i in range(n):
            t += timedelta(minutes=int(rng.integers(0, 700)))
            rows.append((u, f"{u}{i:04d}", t, None if rng.random() < 0.1 else float(rng.normal() + (i > n / 2) * 6), float(rng.integers(0, 3))))
    rows += [("b", "b-null1", None, 1.0, 2.0), ("b", "b-null2", None, 3.0, None)]
    return rows


def replay(rows, window, decay):
    """(user, session) -> (position, baseline, previous)."""
    out = {}
    for u in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2] is not None, r[2] or datetime.min, r[1]))
        before = None
        for i, r in enumerate(mine):
            last = np.array([[v or 0.0 for v in s[3:]] for s in mine[max(0, i + 1 - window):i + 1]])
            w = decay ** np.arange(len(last) - 1, -1, -1.0)
            base = (last * w[:, None]).sum(axis=0) / w.sum()
            out[u, r[1]] = (i + 1, base, before)
            before = base
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(sessions(), SCHEMA).repartition(4).persist()


@pytest.mark.parametrize("window,decay,block", [(25, 0.95, 4096), (7, 0.95, 64), (1000, 0.5, 64), (10, 1.0, 32)])
def test_running_baselines_equal_loop(frame, window, decay, block):
    want = replay(sessions(), window, decay)
    got = BL.running_baselines(frame, ["x", "y"], window, decay, block=block).collect()
    assert len(got) == len(want)
    for r in got:
        position, base, before = want[r.user_id, r.session_id]
        assert (r.position, r.window_size) == (position, min(position, window))
        assert np.allclose(r.baseline, base, atol=1e-9)
        assert (r.previous is None) == (before is None)
        if before is not None:
            assert np.allclose(r.previous, before, atol=1e-9)


def test_last_running_baseline_is_the_decayed_one(frame):
    run = BL.running_baselines(frame, ["x", "y"], 25)
    last = {r.user_id: r.baseline for r in run.groupBy("user_id").agg(F.max_by("baseline", "position").alias("baseline")).collect()}
    for r in BL.decayed_baseline(BL.last_w(frame, 25), ["x", "y"]).collect():
        assert np.allclose(last[r.user_id], [r.x, r.y], atol=1e-9)


def test_drift_history_and_flags_since_retraining(frame):
    stats = BL.global_stats(frame, ["x", "y"])
    std = {r.feature: r["std"] for r in stats.collect()}
    run = BL.running_baselines(frame, ["x", "y"], 25)
    hist = BL.drift_history(run, ["x", "y"], stats, z=1.2, share=0.3).collect()
    want = replay(sessions(), 25, 0.95)
    values = {(r[0], r[1]): r[3:] for r in sessions()}
    drifted = {}
    for r in hist:
        position, base, before = want[r.user_id, r.session_id]
        v = values[r.user_id, r.session_id]
        there = [i for i in range(2) if v[i] is not None]
        hits = sum(abs(v[i] - base[i]) / std["xy"[i]] > 1.2 for i in there)
        flag = position > 1 and bool(there) and hits / len(there) > 0.3
        assert r.drift_detected == flag
        drifted[r.user_id, r.session_id] = flag
        if position == 1 or not there:
            assert r.baseline_anomaly_score == 0.5
        else:
            z = [abs(v[i] - before[i]) / std["xy"[i]] for i in there]
            assert np.isclose(r.baseline_anomaly_score, np.mean([1 / (1 + np.exp(2 - s)) for s in z]), atol=1e-9)
    assert any(drifted.values())
    at, end = datetime(2024, 2, 1), datetime(2024, 3, 1)
    state = BL.user_drift_state(BL.drift_history(run, ["x", "y"], stats, z=1.2), [at, datetime(2025, 1, 1)], end)
    rows = [r for r in sessions() if r[2] is None or r[2] <= end]
    for r in state.collect():
        mine = [s for s in rows if s[0] == r.user_id]
        assert r.activity_count == len(mine) and r.last_updated == max(s[2] for s in mine if s[2])
        assert r.drift_detected == any(drifted[s[0], s[1]] for s in mine if s[2] and s[2] > at)
    s = BL.statistics(state, [at, datetime(2025, 1, 1)], end).first()
    assert s.total_users == 4 and s.retraining_count == 1 and s.drift_detected_users == state.where("drift_detected").count()
    assert s.avg_window_size == np.mean([min(25, len([x for x in rows if x[0] == u])) for u in ("hot", "b", "c", "one")])


def test_versions_and_baseline_at(spark, frame):
    cuts = [datetime(2024, 1, 3), datetime(2024, 2, 1)]
    profiles, stats, history = BL.profile_versions(frame, ["x", "y"], cuts, 25)
    by_version = {}
    for r in profiles.collect():
        mine = [s for s in sessions() if s[0] == r.user_id and (s[2] is None or s[2] <= cuts[r.version - 1])]
        mine = sorted(mine, key=lambda s: (s[2] is not None, s[2] or datetime.min, s[1]))[-25:]
        assert r.activity_count == len(mine) and r.valid_from == cuts[r.version - 1]
        means = [np.mean([s[i] for s in mine if s[i] is not None]) for i in (3, 4)]
        assert np.allclose([r.x, r.y], means)
        by_version[r.user_id, r.version] = means
    assert stats.count() == 4 and {r.users_affected for r in history.collect()} <= {3, 4}
    run = BL.running_baselines(frame, ["x", "y"], 25)
    want = replay(sessions(), 25, 0.95)
    at = [(u, datetime(2023, 12, 1) + timedelta(hours=9 * i)) for u in ("hot", "b", "c", "one", "nobody") for i in range(300)] + [("hot", None)]
    at += [(u, c) for u in ("hot", "b") for c in cuts]
    asked = spark.createDataFrame(at, "user_id string, at timestamp_ntz").distinct()
    got = BL.baseline_at(asked, run, profiles, ["x", "y"]).collect()
    assert len(got) == len(set(at))
    for r in got:
        events = [(s[2], 0, want[s[0], s[1]][0], want[s[0], s[1]][1], None) for s in sessions() if s[0] == r.user_id and s[2]]
        events += [(cuts[v - 1], 1, 0, m, v) for (u, v), m in by_version.items() if u == r.user_id]
        events = [e for e in events if r.at is not None and e[0] <= r.at]
        if not events:
            assert r.baseline is None and r.version is None
            continue
        t, _, _, base, version = max(events, key=lambda e: e[:3])
        assert (r.valid_from, r.version) == (t, version) and np.allclose(r.baseline, base, atol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    run = BL.running_baselines(none, ["x", "y"], 25)
    assert run.count() == 0 and BL.user_drift_state(BL.drift_history(run, ["x", "y"], BL.global_stats(none, ["x", "y"])), [], datetime(2024, 1, 1)).count() == 0
