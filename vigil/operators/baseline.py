"""Per-user behavioural baselines, decayed window means, drift
flags, session anomaly scores and statistics — batch forms.  The streaming
online update (L13) is in ``vigil.streaming.baselines``.

Skew: the last-W window per user never sorts a user's whole history in one
task.  Per-(user, day) counts pick the days that hold the last W sessions
(a window over one row per active day), and ranking then happens inside
(user, day) partitions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.expr import col
from vigil.session import cut_lineage

DEFAULT_WINDOW = 1000
DECAY = 0.95
DRIFT_Z, DRIFT_SHARE, POPULATION_DRIFT = 3.0, 0.3, 0.2


def feature_columns(df: DataFrame, exclude=("user_id", "session_id", "timestamp", "session_start",
                                             "session_end")) -> list[str]:
    from vigil.functions.expr import numeric_columns
    return numeric_columns(df, exclude=tuple(exclude))


def global_stats(df: DataFrame, feats: list[str]) -> DataFrame:
    """L1: mean / sample std / min / max per feature, one aggregate, long form."""
    aggs = []
    for i, c in enumerate(feats):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"n{i}"), F.max(x).alias(f"x{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean"),
                                        F.col(f"s{i}").alias("std"), F.col(f"n{i}").alias("min"),
                                        F.col(f"x{i}").alias("max")) for i, c in enumerate(feats)]))
    return wide.select(rows.alias("r")).select("r.*")


def user_profiles(df: DataFrame, feats: list[str]) -> DataFrame:
    """Per-user unweighted means over all history and activity count."""
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("activity_count"),
                                     *[F.avg(col(c).cast("double")).alias(c) for c in feats])


def last_w(df: DataFrame, w: int = DEFAULT_WINDOW, ts_col: str = "session_start",
           id_col: str = "session_id") -> DataFrame:
    """L3: each user's last ``w`` sessions by (time, id), with ``recency``
    1 = newest (null times count as oldest)."""
    day = F.coalesce(F.to_date(F.col(ts_col)), F.lit("0001-01-01").cast("date"))
    d = df.withColumn("_day", day)
    per_day = d.groupBy("user_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("user_id").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = (per_day.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
                   .where(F.col("_after") < w).select("user_id", "_day", "_after"))
    in_day = Window.partitionBy("user_id", "_day").orderBy(F.col(ts_col).desc_nulls_last(), F.col(id_col).desc())
    return (d.join(days, ["user_id", "_day"])
             .withColumn("recency", F.col("_after") + F.row_number().over(in_day))
             .where(F.col("recency") <= w).drop("_day", "_after"))


def decayed_baseline(window: DataFrame, feats: list[str], decay: float = DECAY) -> DataFrame:
    """Σ x·dʳ⁻¹ / Σ dʳ⁻¹ over the window (r = recency, newest weight 1);
    a missing value counts as 0, as in the reference."""
    wgt = F.pow(F.lit(decay), F.col("recency") - 1)
    return window.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("window_size"),
        *[(F.sum(F.coalesce(col(c).cast("double"), F.lit(0.0)) * wgt) / F.sum(wgt)).alias(c) for c in feats])


def _stats_row(stats: DataFrame, feats: list[str]) -> dict[str, Column]:
    """Global std per feature as literals: one row a feature comes to the driver."""
    std = {r["feature"]: r["std"] for r in stats.select("feature", "std").collect()}
    return {c: F.lit(std.get(c)).cast("double") for c in feats}


# ------------------------------------------------------------ every session (L5, L6, L8 as they run)
#: Sessions of a user whose decayed sums are formed in one window partition.
BLOCK = 4096


def positions(sessions: DataFrame, ts_col: str = "session_start", id_col: str = "session_id") -> DataFrame:
    """``sessions`` with ``position``: 1 for a user's first session by (time, id), null times first.

    Ranked inside (user, day); earlier days add their counts."""
    d = sessions.withColumn("_day", F.coalesce(F.to_date(F.col(ts_col)), F.lit("0001-01-01").cast("date")))
    earlier = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = (d.groupBy("user_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    in_day = Window.partitionBy("user_id", "_day").orderBy(F.col(ts_col).asc_nulls_first(), id_col)
    return (d.join(before, ["user_id", "_day"]).withColumn("position", F.col("_before") + F.row_number().over(in_day))
             .drop("_day", "_before"))


def _weight(n: Column, decay: float) -> Column:
    """1 + d + … + d^(n−1)."""
    return n.cast("double") if decay == 1.0 else (F.lit(1.0) - F.pow(F.lit(decay), n)) / F.lit(1.0 - decay)


def running_baselines(sessions: DataFrame, feats: list[str], window: int = DEFAULT_WINDOW, decay: float = DECAY,
                      ts_col: str = "session_start", id_col: str = "session_id", block: int = BLOCK) -> DataFrame:
    """L5 for every session: the decayed mean of the user's last ``window`` sessions up to it (``baseline``)
    and up to the one before (``previous``, null for the first) → (user_id, session id, time, position,
    window_size, values, baseline, previous), arrays in the order of ``feats``; a missing value counts as 0.

    Decayed sums D compose: a block of sessions is one map D ↦ D·dⁿ + sum.  They are prefix sums inside
    (user, block of positions), the sums of earlier blocks come as one row a block, and the window is
    Dᵢ − d^W·Dᵢ₋W by an equi-join on (user, position), so no task holds a user's history.
    """
    import math
    k = len(feats)
    x = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in feats]
    d = F.lit(decay)
    p = (positions(sessions, ts_col, id_col)
         .select("user_id", id_col, ts_col, "position", F.array(*[col(c).cast("double") for c in feats]).alias("values"),
                 *[v.alias(f"_x{i}") for i, v in enumerate(x)])
         .withColumn("_blk", F.floor((F.col("position") - 1) / block)).withColumn("_e", (F.col("position") - 1) % block))
    upto = Window.partitionBy("user_id", "_blk").orderBy("_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Blocks further back weigh less than 1e-60 of the newest session.
    back = math.ceil(60 * math.log(10) / (-math.log(decay) * block)) if decay < 1.0 else None
    prior = Window.partitionBy("user_id").orderBy("_blk").rowsBetween(-back if back else Window.unboundedPreceding, -1)
    totals = p.groupBy("user_id", "_blk").agg(F.array(*[F.sum(F.col(f"_x{i}") * F.pow(d, block - 1 - F.col("_e"))) for i in range(k)]).alias("_t"))
    fold = lambda i: F.aggregate("_earlier", F.lit(0.0), lambda acc, t: acc * F.pow(d, F.lit(block)) + t[i])
    carried = (totals.withColumn("_earlier", F.collect_list("_t").over(prior)).where(F.size("_earlier") > 0)
                     .select("user_id", "_blk", F.array(*[fold(i) for i in range(k)]).alias("_c")))
    own = F.array(*[F.sum(F.col(f"_x{i}") * F.pow(d, -F.col("_e"))).over(upto) * F.pow(d, F.col("_e")) for i in range(k)])
    rows = (p.withColumn("_own", own).join(carried, ["user_id", "_blk"], "left")
             .select("user_id", id_col, ts_col, "position", "values", F.array(*[f"_x{i}" for i in range(k)]).alias("_x"),
                     F.when(F.col("_c").isNull(), F.col("_own"))
                      .otherwise(F.zip_with("_own", "_c", lambda a, b: a + b * F.pow(d, F.col("_e") + 1))).alias("_d")))
    rows = cut_lineage(rows)
    zeros = F.array(*[F.lit(0.0)] * k)
    left = rows.select("user_id", (F.col("position") + window).alias("position"), F.col("_d").alias("_far"), F.col("_x").alias("_far_x"))
    rows = (rows.join(left, ["user_id", "position"], "left")
                .withColumn("_far", F.coalesce("_far", zeros)).withColumn("_far_x", F.coalesce("_far_x", zeros)))
    size = F.least("position", F.lit(window))
    leaving = F.pow(d, F.lit(window))
    ago = F.least(F.col("position") - 1, F.lit(window))
    one_back = lambda total, now: F.zip_with(total, now, lambda a, b: (a - b) / d)
    return (rows.withColumn("_before", one_back("_d", "_x")).withColumn("_far_before", one_back("_far", "_far_x"))
                .select("user_id", id_col, ts_col, "position", size.cast("int").alias("window_size"), "values",
                        F.zip_with("_d", "_far", lambda a, b: (a - leaving * b) / _weight(size, decay)).alias("baseline"),
                        F.when(ago > 0, F.zip_with("_before", "_far_before", lambda a, b: (a - leaving * b) / _weight(ago, decay)))
                         .alias("previous")))


def drift_history(running: DataFrame, feats: list[str], stats: DataFrame, z: float = DRIFT_Z, share: float = DRIFT_SHARE) -> DataFrame:
    """L6 and L8 for every session of ``running_baselines``: the drift test against the baseline that includes the
    session, and the anomaly score against the one before it.  A user's first session is not tested and scores 0.5 (L4)."""
    std = list(_stats_row(stats, feats).values())
    value, base, past = F.col("values"), F.col("baseline"), F.col("previous")
    hits, present, parts, used = [], [], [], []
    for i, s in enumerate(std):
        there = value[i].isNotNull()
        present.append(F.when(there, 1).otherwise(0))
        hits.append(F.when(there & (s > 0) & (F.abs(value[i] - base[i]) / s > z), 1).otherwise(0))
        parts.append(F.when(there & (s > 0), F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(2.0) - F.abs(value[i] - past[i]) / s))).otherwise(0.0))
        used.append(F.when(there & (s > 0), 1).otherwise(0))
    tested = F.col("position") > 1
    total, n = sum(present), sum(used)
    rows = running.withColumn("significant_deviations", F.when(tested, sum(hits)).otherwise(0)).withColumn("total_features", F.when(tested, total).otherwise(0))
    ratio = F.try_divide(F.col("significant_deviations"), F.col("total_features")).cast("double")
    return (rows.withColumn("drift_ratio", ratio).withColumn("drift_detected", F.coalesce(F.col("drift_ratio") > share, F.lit(False)))
                .withColumn("baseline_anomaly_score", F.when(tested & (n > 0), sum(parts) / n).otherwise(F.lit(0.5))))


def _time(t, df: DataFrame, name: str) -> Column:
    """``t`` as a literal of the type of a time column, whatever the session's time zone."""
    return F.lit(str(t)).cast(df.schema[name].dataType)


def user_drift_state(history: DataFrame, retrained: list, as_of, ts_col: str = "session_start") -> DataFrame:
    """Profiles as they stand at ``as_of``: sessions so far, last update, and the flag, which a drifted session raises
    and a retraining (L10; times in ``retrained``) lowers → (user_id, activity_count, window_size, last_updated, drift_detected)."""
    last = max((t for t in retrained if t <= as_of), default=None)
    h = history.where(F.col(ts_col).isNull() | (F.col(ts_col) <= _time(as_of, history, ts_col)))
    since = F.lit(True) if last is None else F.col(ts_col) > _time(last, history, ts_col)
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("activity_count"), F.max("window_size").alias("window_size"),
                                    F.max(ts_col).alias("last_updated"),
                                    F.max(F.coalesce(F.col("drift_detected") & since, F.lit(False))).alias("drift_detected"))


def statistics(state: DataFrame, retrained: list, as_of, threshold: float = POPULATION_DRIFT) -> DataFrame:
    """L9 + L11 over ``user_drift_state``: users, drifted users, retrainings so far, mean window, oldest profile in days."""
    age = F.floor(F.timestamp_diff("SECOND", F.col("last_updated"), _time(as_of, state, "last_updated")) / 86400)
    return state.agg(F.count(F.lit(1)).alias("total_users"), F.count_if("drift_detected").alias("drift_detected_users"),
                     F.lit(sum(t <= as_of for t in retrained)).cast("long").alias("retraining_count"),
                     F.coalesce(F.avg("window_size"), F.lit(0.0)).alias("avg_window_size"),
                     F.coalesce(F.max(age), F.lit(0)).cast("long").alias("oldest_profile_age")) \
        .withColumn("retrain_recommended", F.coalesce(F.try_divide("drift_detected_users", "total_users") > threshold, F.lit(False)))


def profile_versions(sessions: DataFrame, feats: list[str], retrained: list, window: int = DEFAULT_WINDOW,
                     ts_col: str = "session_start") -> tuple[DataFrame, DataFrame, DataFrame]:
    """L10 for each time in ``retrained`` (a short list): refit on every user's window as it stood then.

    → profiles (version, valid_from, user_id, activity_count, means), global statistics (version, feature, ...) and the
    history (version, retrained_at, samples_used, users_affected).
    """
    profiles, stats, history = [], [], []
    for v, t in enumerate(sorted(retrained), 1):
        at_t = _time(t, sessions, ts_col)
        w = cut_lineage(last_w(sessions.where(F.col(ts_col).isNull() | (F.col(ts_col) <= at_t)), window, ts_col))
        s, p, h = retrain(w, feats)
        mark = lambda df, at: df.select(F.lit(v).alias("version"), at_t.alias(at), "*")  # noqa: B023, E731
        profiles.append(mark(p, "valid_from"))
        stats.append(mark(s, "valid_from"))
        history.append(mark(h, "retrained_at"))
    return tuple(reduce(DataFrame.unionByName, x) for x in (profiles, stats, history))


def latest_before(lookups: DataFrame, rows: DataFrame, ts_col: str, at_col: str = "at", order: tuple[str, ...] = ()) -> DataFrame:
    """As-of join: each lookup (user_id, ``at_col``) with the user's last row at or before it, as struct ``latest`` (null without one).

    The rows of a user are met by day: the last active day up to the lookup and the one before it hold the answer.
    """
    r = rows.withColumn("_day", F.to_date(ts_col))
    days = r.where(F.col("_day").isNotNull()).select("user_id", "_day").distinct().groupBy("user_id").agg(F.collect_list("_day").alias("_days"))
    asked = lookups.select("user_id", at_col).distinct().join(days, "user_id", "left")
    upto = F.sort_array(F.filter("_days", lambda d: d <= F.to_date(at_col)), asc=False)
    asked = asked.select("user_id", at_col, F.explode_outer(F.slice(upto, 1, 2)).alias("_day"))
    names = [c for c in rows.columns if c != "user_id"]
    whole = F.struct(F.col(ts_col).alias("_ts"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*names).alias("row"))
    met = asked.join(r.select("user_id", "_day", whole.alias("_whole")), ["user_id", "_day"], "left")
    best = met.groupBy("user_id", at_col).agg(F.max(F.when(F.col("_whole._ts") <= F.col(at_col), F.col("_whole"))).alias("_best"))
    return lookups.join(best.select("user_id", at_col, F.col("_best.row").alias("latest")), ["user_id", at_col], "left")


def baseline_at(lookups: DataFrame, running: DataFrame, versions: DataFrame, feats: list[str], at_col: str = "at",
                ts_col: str = "session_start", id_col: str = "session_id") -> DataFrame:
    """The baseline valid at a time.  A session sets it to the running baseline, a retraining to that version's means;
    the later of the two holds (the retraining on a tie).  Unknown users get null → (user_id, at, version, valid_from, baseline)."""
    sessions = latest_before(lookups, running.select("user_id", ts_col, "position", "baseline"), ts_col, at_col, ("position",))
    means = F.array(*[col(c).cast("double") for c in feats])
    refits = versions.select("user_id", "valid_from", "version", means.alias("baseline"))
    both = latest_before(sessions.withColumnRenamed("latest", "session"), refits, "valid_from", at_col)
    refit = F.col("latest").isNotNull() & (F.col("session").isNull() | (F.col("latest.valid_from") >= F.col(f"session.{ts_col}")))
    return both.select("user_id", at_col, F.when(refit, F.col("latest.version")).alias("version"),
                       F.when(refit, F.col("latest.valid_from")).otherwise(F.col(f"session.{ts_col}")).alias("valid_from"),
                       F.when(refit, F.col("latest.baseline")).otherwise(F.col("session.baseline")).alias("baseline"))


def drift_flags(latest: DataFrame, baseline: DataFrame, stats: DataFrame, feats: list[str],
                z: float = DRIFT_Z, share: float = DRIFT_SHARE) -> DataFrame:
    """Per user, share of features whose |x − baseline| / global std
    exceeds z; features with std ≤ 0 count in the total but are not tested;
    drift when the share is strictly above ``share``."""
    std = _stats_row(stats, feats)
    b = baseline.select("user_id", *[col(c).alias(f"_b_{c}") for c in feats])
    j = latest.join(b, "user_id")
    present = [F.when(col(c).isNotNull() & F.col(f"_b_{c}").isNotNull(), 1).otherwise(0) for c in feats]
    hits = [F.when(col(c).isNotNull() & F.col(f"_b_{c}").isNotNull() & (std[c] > 0) &
                   (F.abs(col(c) - F.col(f"_b_{c}")) / std[c] > z), 1).otherwise(0) for c in feats]
    total, sig = sum(present), sum(hits)
    return j.select("user_id", sig.alias("significant_deviations"), total.alias("total_features"),
                    F.try_divide(sig, total).cast("double").alias("drift_ratio"),
                    F.coalesce(F.try_divide(sig, total) > share, F.lit(False)).alias("drift_detected"))


def anomaly_scores(sessions: DataFrame, baseline: DataFrame, stats: DataFrame, feats: list[str]) -> DataFrame:
    """Mean over usable features of 1/(1 + e^(2 − z)), z = |x − baseline| / std;
    0.5 for an unknown user or when no feature is usable."""
    std = _stats_row(stats, feats)
    b = baseline.select("user_id", F.lit(True).alias("_known"), *[col(c).alias(f"_b_{c}") for c in feats])
    j = sessions.join(b, "user_id", "left")
    parts, used = [], []
    for c in feats:
        ok = col(c).isNotNull() & F.col(f"_b_{c}").isNotNull() & (std[c] > 0)
        zc = F.abs(col(c) - F.col(f"_b_{c}")) / std[c]
        parts.append(F.when(ok, F.lit(1.0) / (F.lit(1.0) + F.exp(-zc + F.lit(2.0)))).otherwise(0.0))
        used.append(F.when(ok, 1).otherwise(0))
    n = sum(used)
    score = F.when(F.col("_known").isNull() | (n == 0), F.lit(0.5)).otherwise(sum(parts) / n)
    return j.select("user_id", "session_id", score.alias("baseline_anomaly_score"))


def population_drift(flags: DataFrame, threshold: float = POPULATION_DRIFT) -> DataFrame:
    """L9 + L11: users, drifted users, drift ratio, retrain recommended."""
    return flags.agg(F.count(F.lit(1)).alias("total_users"),
                     F.count_if(F.col("drift_detected")).alias("drift_detected_users")) \
        .withColumn("drift_ratio", F.col("drift_detected_users") / F.greatest(F.col("total_users"), F.lit(1))) \
        .withColumn("retrain_recommended", F.col("drift_ratio") > threshold)


def retrain(window: DataFrame, feats: list[str]):
    """Refit L1 + L2 on the windows only; history row (samples, users)."""
    history = window.agg(F.count(F.lit(1)).alias("samples_used"),
                         F.count_distinct("user_id").alias("users_affected"))
    return global_stats(window, feats), user_profiles(window, feats), history


def profile_age(profiles: DataFrame, as_of: Column, last_col: str = "last_updated") -> DataFrame:
    """Age of each profile at ``as_of`` (days), instead of 'now'."""
    return profiles.withColumn("profile_age_days",
                               F.floor(F.timestamp_diff("SECOND", F.col(last_col), as_of) / 86400).cast("long"))


# ------------------------------------------------------------ L7 adaptive-window drift
ADWIN_DELTA = 0.002


def _adwin_flags(values: list[float], delta: float = ADWIN_DELTA) -> list[bool]:
    """Adaptive windowing (Bifet & Gavaldà, SDM 2007), exact-cut form: after
    each value, drop the oldest part while some split of the window has
    sub-window means further apart than ε_cut = sqrt(ln(4n/δ) / (2m)),
    m = 1 / (1/n0 + 1/n1); report drift when a cut happened."""
    import numpy as np
    win: list[float] = []
    flags = []
    for v in values:
        win.append(float(v))
        drift = False
        while len(win) >= 2:
            arr = np.asarray(win)
            n = len(arr)
            csum = np.cumsum(arr)
            n0 = np.arange(1, n)
            n1 = n - n0
            mean0 = csum[:-1] / n0
            mean1 = (csum[-1] - csum[:-1]) / n1
            m = 1.0 / (1.0 / n0 + 1.0 / n1)
            eps = np.sqrt(np.log(4.0 * n / delta) / (2.0 * m))
            cut = np.nonzero(np.abs(mean0 - mean1) > eps)[0]
            if len(cut) == 0:
                break
            win = win[int(cut[0]) + 1:]
            drift = True
        flags.append(drift)
    return flags


def adaptive_drift(window: DataFrame, baseline: DataFrame, stats: DataFrame, feats: list[str],
                   ts_col: str = "session_start", delta: float = ADWIN_DELTA) -> DataFrame:
    """L7 (batch form, one detector per user — D16): each session's mean
    deviation |x − baseline| / std over usable features, fed in time order
    through an adaptive window.  Input is the last-W window per user (L3), so
    one group holds at most W sessions → (user_id, session_id, deviation,
    adwin_drift)."""
    import pandas as pd
    std = _stats_row(stats, feats)
    b = baseline.select("user_id", *[col(c).alias(f"_b_{c}") for c in feats])
    j = window.join(b, "user_id", "left")
    devs, used = [], []
    for c in feats:
        ok = col(c).isNotNull() & F.col(f"_b_{c}").isNotNull() & (std[c] > 0)
        devs.append(F.when(ok, F.abs(col(c) - F.col(f"_b_{c}")) / std[c]).otherwise(0.0))
        used.append(F.when(ok, 1).otherwise(0))
    n = sum(used)
    dev = F.when(n > 0, sum(devs) / n)
    seq = j.select("user_id", "session_id", ts_col, dev.alias("deviation")).where(F.col("deviation").isNotNull())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts_col, "session_id"], kind="stable")
        return pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "session_id": pdf["session_id"].to_numpy(),
                             "deviation": pdf["deviation"].to_numpy(),
                             "adwin_drift": _adwin_flags(pdf["deviation"].tolist(), delta)})

    return seq.groupBy("user_id").applyInPandas(
        run, "user_id string, session_id string, deviation double, adwin_drift boolean")
