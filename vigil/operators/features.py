"""Context, rare-hour and burst flags, transitions, n-grams,
peer groups, peer z-scores and the session feature matrix.

Small lookup tables joined here have a bound that does not grow with the
data: 24 hours, (#activity types)² transitions, ≤ 15 peer groups.  Those are
broadcast; everything keyed by user or session is a shuffle join on keys the
data is already partitioned by.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import keep
from vigil.functions.expr import col
from vigil.operators.sessions import DAY, day_sessions, day_window, number_sessions, session_aggregates
from vigil.schema import PEER_COLUMNS

#: Users that one task of a k-means step reads.
USERS_PER_TASK = 20_000

MATRIX_COLUMNS = [
    "user_id", "session_id", "session_start", "session_end", "session_duration_s",
    "event_cnt", "file_rate", "logon_rate", "device_rate", "http_rate",
    "interarrival_mean_s", "interarrival_std_s", "rare_logon_hour", "file_burst",
    "2gram_diversity", "3gram_diversity", "unusual_transitions",
]


def add_user_context(events: DataFrame, user_dim: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """left join the user dimension; when it has ``hire_date``, tenure_days
    = whole days from hire date to the latest event timestamp (scalar
    subquery, one aggregate over the events)."""
    dim = user_dim
    if "hire_date" in dim.columns:
        last_ts = events.agg(F.max(ts_col)).scalar()
        secs = F.timestamp_diff("SECOND", F.col("hire_date").cast("timestamp_ntz"), last_ts)
        dim = dim.withColumn("tenure_days", F.floor(secs / F.lit(86400)).cast("int"))
    return events.join(dim, "user_id", "left")


def rare_logon_hours(events: DataFrame, threshold: float = 0.01) -> DataFrame:
    """F7 lookup: hours whose share of all logons is below ``threshold`` (≤ 24 rows)."""
    logons = events.where((F.col("activity_type") == "logon") & F.col("hour").isNotNull())
    counts = logons.groupBy("hour").agg(F.count(F.lit(1)).alias("_n"))
    # The total is summed from the ≤ 24 hour counts; the subquery and the main
    # plan share the counts' exchange, so events are aggregated once.
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") / total < F.lit(threshold)).select("hour", F.lit(1).alias("_rare"))


def day_steps(sess: DataFrame, user_col: str = "user_id", ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """``sess`` with the activities before and after each event on its user's day, and whether it is the day's first or
    last event: all from one sort of (user, day)."""
    w = day_window(user_col, ts_col, id_col)
    a = F.col("activity_type")
    return sess.select("*", F.lag(a).over(w).alias("_a_prev"), F.lead(a, 1).over(w).alias("_a1"), F.lead(a, 2).over(w).alias("_a2"),
                       F.lag(DAY).over(w).isNull().alias("_first"), F.lead(DAY).over(w).isNull().alias("_last"))


def _with_steps(sess: DataFrame, user_col: str, ts_col: str, id_col: str) -> DataFrame:
    return sess if "_a1" in sess.columns else day_steps(sess, user_col, ts_col, id_col)


def file_bursts(sess: DataFrame, window: int = 3, threshold: int = 3, user_col: str = "user_id",
                ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """F8: ``file_burst`` is 1 where ``threshold`` of the last ``window`` events of the session (``_local_no``) are file events.
    A session's events stand together in their day, so the day's order serves."""
    w = day_window(user_col, ts_col, id_col)
    file = F.coalesce(F.col("activity_type") == "file", F.lit(False)).cast("int")
    files = file
    for back in range(1, window):
        same = F.lag("_local_no", back).over(w) == F.col("_local_no")
        files = files + F.when(same, F.lag(file, back).over(w)).otherwise(0)
    return sess.withColumn("file_burst", (files >= threshold).cast("long"))


def transition_probabilities(sess: DataFrame, user_col: str = "user_id",
                             ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """adjacent activity pairs per user across sessions and days; share of all pairs.

    Within a day the pair comes from the (user, day) window (``day_steps``);
    the pair that crosses from one active day to the next comes from the
    day's first and last events, so no window is keyed by user alone
    over raw events.
    """
    sess = _with_steps(sess, user_col, ts_col, id_col)
    within = (sess.select(F.col("_a_prev").alias("prev_activity"), F.col("activity_type").alias("activity"))
                  .where(F.col("prev_activity").isNotNull()))
    days = (sess.groupBy(user_col, DAY)
                .agg(F.max(F.when(F.col("_first"), F.col("activity_type"))).alias("_first"),
                     F.max(F.when(F.col("_last"), F.col("activity_type"))).alias("_last")))
    w_user = Window.partitionBy(user_col).orderBy(DAY)
    across = (days.select(F.lag("_last").over(w_user).alias("prev_activity"),
                          F.col("_first").alias("activity"))
                  .where(F.col("prev_activity").isNotNull()))
    pairs = within.unionByName(across)
    counts = pairs.groupBy("prev_activity", "activity").agg(F.count(F.lit(1)).alias("transition_count"))
    # One row a pair of types: the total is taken over them, so that pairs are counted once.
    total = F.sum("transition_count").over(Window.partitionBy())
    return counts.withColumn("probability", F.col("transition_count") / total)


def sequence_features(sess: DataFrame, transitions: DataFrame, unusual_threshold: float = 0.01,
                      user_col: str = "user_id", ts_col: str = "timestamp",
                      id_col: str = "event_id") -> DataFrame:
    """F10 per (user, date): seq_len, unusual_transitions (pairs whose global
    probability is below the threshold; unknown pairs count as 0), and the
    number of distinct 2-grams and 3-grams.  Null-timestamp events have no date
    and get no row."""
    ev = (_with_steps(sess, user_col, ts_col, id_col).where(F.col(ts_col).isNotNull())
          .select(user_col, DAY, F.col("activity_type").alias("a0"), F.col("_a1").alias("a1"), F.col("_a2").alias("a2")))
    # (#activity types)² rows at most: broadcast.
    probs = F.broadcast(transitions.select(F.col("prev_activity").alias("a0"),
                                           F.col("activity").alias("a1"), "probability"))
    ev = ev.join(probs, ["a0", "a1"], "left")
    unusual = F.when(F.col("a1").isNotNull() &
                     (F.coalesce(F.col("probability"), F.lit(0.0)) < F.lit(unusual_threshold)), 1)
    # Distinct 2-grams are the groups of (a0, a1), distinct 3-grams those of (a0, a1, a2): all inside (user, day).
    trigrams = ev.groupBy(user_col, DAY, "a0", "a1", "a2").agg(F.count(F.lit(1)).alias("_n"), F.count(unusual).alias("_u"))
    bigrams = trigrams.groupBy(user_col, DAY, "a0", "a1").agg(F.sum("_n").alias("_n"), F.sum("_u").alias("_u"), F.count("a2").alias("_3"))
    return bigrams.groupBy(user_col, DAY).agg(
        F.sum("_n").alias("seq_len"),
        F.sum("_u").cast("double").alias("unusual_transitions"),
        F.count("a1").cast("double").alias("2gram_diversity"),
        F.sum("_3").cast("double").alias("3gram_diversity"))


def user_behaviour(sessions: DataFrame, user_col: str = "user_id") -> DataFrame:
    """F11 input: per-user mean over event rows of the four rates (sessions
    weighted by event count, null rates skipped, all-null → 0)."""
    out = []
    for c in ["file_rate", "logon_rate", "device_rate", "http_rate"]:
        w = F.when(F.col(c).isNotNull(), F.col("event_cnt"))
        out.append(F.coalesce(F.sum(F.col(c) * w) / F.sum(w), F.lit(0.0)).alias(c))
    return sessions.groupBy(user_col).agg(*out)


def kmeans_peer_groups(behaviour: DataFrame, k: int | None = None, n_init: int = 10,
                       seed: int = 42, user_col: str = "user_id") -> DataFrame:
    """k-means peer groups on unscaled behaviour, best of ``n_init`` seeds.

    k defaults to max(4, min(15, users // 25)).  Cluster ids are relabelled
    by sorted centroid so they do not depend on the seed's labelling.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    feats = ["file_rate", "logon_rate", "device_rate", "http_rate"]
    # Every step of every fit reads the users: their sessions are made once, and a step has as many tasks as the
    # users fill, not as many as the shuffle before it left.
    behaviour = keep(behaviour)
    users = behaviour.count()
    behaviour = behaviour.repartition(max(1, math.ceil(users / USERS_PER_TASK)), user_col)
    vec = keep(VectorAssembler(inputCols=feats, outputCol="_features").transform(behaviour))
    if k is None:
        k = max(4, min(15, users // 25))
    best = None
    for i in range(n_init):
        model = KMeans(k=k, seed=seed + i, featuresCol="_features", predictionCol="_cluster",
                       maxIter=300, tol=1e-4).fit(vec)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    model = best[1]
    centers = [tuple(float(x) for x in c) for c in model.clusterCenters()]
    order = sorted(range(len(centers)), key=lambda j: centers[j])
    relabel = [0] * len(centers)
    for new_id, old_id in enumerate(order):
        relabel[old_id] = new_id
    mapping = F.array(*[F.lit(x) for x in relabel])
    return (model.transform(vec)
                 .select(user_col, F.element_at(mapping, F.col("_cluster") + 1).alias("peer_group")))


def peer_zscores(sessions: DataFrame, peers: DataFrame | None, columns=PEER_COLUMNS,
                 user_col: str = "user_id") -> DataFrame:
    """(x − group mean) / group sample std over event rows (sessions
    weighted by event_cnt); std 0 → 1.  Two passes (mean, then squared
    deviations) for numerical stability; group tables are tiny.
    Without ``peers`` the sessions hold their ``peer_group`` already."""
    s = sessions if peers is None else sessions.join(peers, user_col, "left")
    mean_aggs = []
    for c in columns:
        w = F.when(col(c).isNotNull(), F.col("event_cnt"))
        mean_aggs += [(F.sum(col(c) * w) / F.sum(w)).alias(f"_m_{c}"), F.sum(w).alias(f"_n_{c}")]
    means = s.where(F.col("peer_group").isNotNull()).groupBy("peer_group").agg(*mean_aggs)
    # One row a peer group: a join by shuffle would put all sessions into as many tasks as there are groups.
    s2 = s.join(F.broadcast(means), "peer_group", "left")
    var_aggs = []
    for c in columns:
        w = F.when(col(c).isNotNull(), F.col("event_cnt"))
        var_aggs.append((F.sum(w * F.pow(col(c) - F.col(f"_m_{c}"), 2))
                         / (F.first(f"_n_{c}") - 1)).alias(f"_v_{c}"))
    stds = (s2.where(F.col("peer_group").isNotNull()).groupBy("peer_group").agg(*var_aggs))
    out = s2.join(F.broadcast(stds), "peer_group", "left")
    for c in columns:
        sd = F.sqrt(F.col(f"_v_{c}"))
        sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out = out.withColumn(f"{c}_z_peer", (col(c) - F.col(f"_m_{c}")) / sd)
    drop = [f"_{p}_{c}" for c in columns for p in ("m", "n", "v")]
    return out.drop(*drop)


def session_feature_matrix(events: DataFrame, gap_minutes: float = 10,
                           rare_hour_threshold: float = 0.01, unusual_threshold: float = 0.01,
                           burst_window: int = 3, burst_threshold: int = 3,
                           peers: DataFrame | str | None = "kmeans", kmeans_k: int | None = None,
                           seed: int = 42, persist: bool = True) -> DataFrame:
    """F1–F13 → one row per (user_id, session_id).

    ``peers``: a (user_id, peer_group) frame, ``"kmeans"`` for F11, or None
    to leave out the ``_z_peer`` columns.  With ``persist`` the sessionised
    events and the sessions are kept until ``session.release``.
    """
    sess = day_sessions(events.select("user_id", "timestamp", "event_id", "activity_type"), gap_minutes)
    sess = file_bursts(day_steps(sess), burst_window, burst_threshold).withColumn("hour", F.hour("timestamp"))
    if persist:
        # Five branches read the day's sessions and steps (rare hours, session
        # aggregates, their numbers, transitions, n-grams); keep one copy (spills
        # to disk, recomputed from lineage if an executor is lost).  Made before
        # the branches are planned, so that they know it lies by (user, day).
        sess = keep(sess)
        sess.count()
    rare = F.broadcast(rare_logon_hours(sess, rare_hour_threshold))   # ≤ 24 rows
    agg = (sess.join(rare, "hour", "left")
               .withColumn("rare_logon_hour",
                           F.when((F.col("activity_type") == "logon") & F.col("_rare").isNotNull(), 1)
                            .otherwise(0)))
    agg = session_aggregates(agg, extra_aggs=[F.max("rare_logon_hour").cast("long").alias("rare_logon_hour"),
                                              F.sum("file_burst").alias("file_burst")], session_col="_local_no")
    agg = number_sessions(agg, sess)
    trans = transition_probabilities(sess)
    seq = sequence_features(sess, trans, unusual_threshold)
    m = agg.join(seq, ["user_id", DAY], "left")
    cols = [F.col(c) if not c[0].isdigit() else col(c) for c in MATRIX_COLUMNS]
    m = m.select(*cols, "_day")
    given = peers is not None and not isinstance(peers, str)
    if given:
        m = m.join(peers, "user_id", "left")      # before it is kept: the peer statistics then need no shuffle
    if persist and peers is not None:
        # Session grain (far smaller than events); read by the peer statistics
        # and the z-score projection.
        # Materialised before use: the broadcast sides below are built by
        # concurrent jobs that would each recompute the whole chain.
        m = keep(m)
        m.count()
    if peers is not None:
        if not given:
            peers = kmeans_peer_groups(user_behaviour(m), k=kmeans_k, seed=seed)
        m = peer_zscores(m, None if given else peers)
        m = m.drop("peer_group")
    m = m.drop(DAY)
    fill = {c: 0 for c, t in m.dtypes if t in ("double", "bigint", "int", "float")}
    return m.na.fill(fill)
