"""Gap sessionisation and per-session temporal / frequency features.

Skew design: every window here is keyed by (user, calendar day), never by
user alone.  Sessions never cross a calendar day (the split rule includes a
date change), so the only per-user quantity that crosses days is the running
session counter; it comes from a per-(user, day) summary (one row per active
user-day, bounded by the number of days) and is joined back on (user, day).
A user holding a third of all events therefore spreads over as many tasks as
it has active days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.expr import micros_between

# Null timestamps get their own day bucket, ordered after every real day.
NULL_DAY = "9999-12-31"
DAY = "_day"


def day_key(ts_col: str = "timestamp"):
    return F.coalesce(F.to_date(F.col(ts_col)), F.lit(NULL_DAY).cast("date"))


def day_window(user_col: str = "user_id", ts_col: str = "timestamp", id_col: str = "event_id"):
    return Window.partitionBy(user_col, DAY).orderBy(F.col(ts_col).asc_nulls_last(), id_col)


def day_sessions(events: DataFrame, gap_minutes: float = 10, user_col: str = "user_id",
                 ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """F1 inside a day: adds the ``_day`` key, ``interarrival_s`` (0 on a session's first event) and ``_local_no``,
    the number of the event's session among those of its user and day, from 1."""
    w = day_window(user_col, ts_col, id_col)
    ts = F.col(ts_col)
    gap_limit = int(round(gap_minutes * 60 * 1_000_000))
    df = events.withColumn(DAY, day_key(ts_col)).withColumn("_prev_ts", F.lag(ts).over(w))
    gap_us = micros_between(F.col("_prev_ts"), ts)
    split = F.col("_prev_ts").isNull() | ts.isNull() | (gap_us > F.lit(gap_limit))
    return (df.withColumn("_split", split)
              .withColumn("interarrival_s",
                          F.when(F.col("_split"), F.lit(0.0))
                           .otherwise(gap_us.cast("double") / F.lit(1e6)))
              .withColumn("_local_no", F.sum(F.col("_split").cast("long"))
                          .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .drop("_prev_ts", "_split"))


def number_sessions(df: DataFrame, within: DataFrame, user_col: str = "user_id") -> DataFrame:
    """``df`` with ``session_no`` and ``session_id`` for its ``_local_no``; ``within`` holds every session of ``day_sessions``."""
    # One row per active (user, day): sessions that start on that day.
    per_day = within.groupBy(user_col, DAY).agg(F.max("_local_no").alias("_n"))
    w_user = Window.partitionBy(user_col).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select(user_col, DAY,
                             F.coalesce(F.sum("_n").over(w_user), F.lit(0)).alias("_off"))
    session_no = (F.col("_off") + F.col("_local_no")).cast("long")
    return (df.join(offsets, [user_col, DAY], "inner")
              .withColumn("session_no", session_no)
              .withColumn("session_id", F.substring(
                  F.md5(F.concat_ws("_", F.col(user_col), session_no.cast("string"))), 1, 16))
              .drop("_local_no", "_off"))


def sessionize(events: DataFrame, gap_minutes: float = 10, user_col: str = "user_id",
               ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """F1.  Adds ``session_id`` (md5(user_counter)[:16]), ``session_no``,
    ``interarrival_s`` (0 on a session's first event) and the ``_day`` key.

    A new session starts on a user's first event of a day, after a gap
    strictly longer than ``gap_minutes``, and for every null timestamp.
    """
    df = day_sessions(events, gap_minutes, user_col, ts_col, id_col)
    return number_sessions(df, df, user_col)


def time_bin(hour_col):
    """F3 time of day: night [0,6), morning [6,12), afternoon [12,18), evening [18,24)."""
    return (F.when(hour_col < 6, "night").when(hour_col < 12, "morning")
             .when(hour_col < 18, "afternoon").when(hour_col < 24, "evening"))


def add_temporal_columns(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """hour, day_of_week (Monday = 0) and time_bin per event."""
    ts = F.col(ts_col)
    return (df.withColumn("hour", F.hour(ts))
              .withColumn("day_of_week", F.weekday(ts))
              .withColumn("time_bin", time_bin(F.hour(ts))))


def session_aggregates(sess: DataFrame, activity_types=("logon", "file", "device", "http", "email"),
                       user_col: str = "user_id", ts_col: str = "timestamp",
                       extra_aggs=(), session_col: str = "session_id") -> DataFrame:
    """F2, F4, F5 at session grain: start, end, duration, event_cnt,
    per-type counts and rates (count / max(duration, 1)), inter-arrival
    mean / sample std / max.

    Grouping keys include the (user, day) key, so the aggregation reuses the
    sessionisation's hash partitioning and adds no shuffle.
    """
    ts = F.col(ts_col)
    aggs = [F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
            F.count(F.lit(1)).alias("event_cnt"),
            F.avg("interarrival_s").alias("interarrival_mean_s"),
            F.stddev_samp("interarrival_s").alias("interarrival_std_s"),
            F.max("interarrival_s").alias("interarrival_max_s"), *extra_aggs]
    for a in activity_types:
        aggs.append(F.count(F.when(F.col("activity_type") == a, 1)).alias(f"{a}_cnt"))
    g = sess.groupBy(user_col, DAY, session_col).agg(*aggs)
    dur = micros_between(F.col("session_start"), F.col("session_end")).cast("double") / F.lit(1e6)
    g = g.withColumn("session_duration_s", dur)
    denom = F.when(F.col("session_duration_s").isNull(), F.lit(None).cast("double")) \
             .otherwise(F.greatest(F.col("session_duration_s"), F.lit(1.0)))
    for a in activity_types:
        g = g.withColumn(f"{a}_rate", F.col(f"{a}_cnt") / denom)
    return g
