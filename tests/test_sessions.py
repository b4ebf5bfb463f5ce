"""F1–F5 goldens (hand-derived from the formulas) and invariants."""
from datetime import datetime

from pyspark.sql import functions as F

from vigil.functions.expr import align_to_unified
from vigil.operators.sessions import sessionize, add_temporal_columns


def _events(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp_ntz, user_id string, activity_type string")
    return df


def test_session_ids_match_md5_of_user_counter(spark):
    rows = [("1", datetime(2010, 1, 2, 8, 28, 6), "ACM2278", "logon"),
            ("2", datetime(2010, 1, 2, 9, 15, 22), "ACM2278", "logon"),
            ("4", datetime(2010, 1, 3, 8, 30, 15), "CMP2946", "logon")]
    s = sessionize(_events(spark, rows), 10).orderBy("event_id").collect()
    assert [r.session_id for r in s] == ["1b5d33e70923ff7e", "e902bb8a33b7ee33", "84c1bc2c40f1ff74"]


def test_gap_of_exactly_ten_minutes_stays_in_session(spark):
    rows = [("1", datetime(2024, 1, 1, 10, 0, 0), "u", "file"),
            ("2", datetime(2024, 1, 1, 10, 10, 0), "u", "file")]
    s = sessionize(_events(spark, rows), 10).collect()
    assert len({r.session_id for r in s}) == 1


def test_date_change_splits_even_within_gap(spark):
    rows = [("1", datetime(2024, 1, 1, 23, 58, 0), "u", "file"),
            ("2", datetime(2024, 1, 2, 0, 1, 0), "u", "file")]
    s = sessionize(_events(spark, rows), 10).orderBy("event_id").collect()
    assert s[0].session_id != s[1].session_id
    assert [r.session_no for r in s] == [1, 2]


def test_null_timestamps_are_own_sessions_after_real_ones(spark):
    rows = [("1", datetime(2024, 1, 1, 10, 0, 0), "u", "file"),
            ("2", None, "u", "file"), ("3", None, "u", "http")]
    s = {r.event_id: r.session_no for r in sessionize(_events(spark, rows), 10).collect()}
    assert s == {"1": 1, "2": 2, "3": 3}


def test_acm_rows_of_part_b_give_six_sessions(spark):
    ts = ["01/02/2010 08:28:06", "01/02/2010 09:15:22", "01/02/2010 17:45:30", "01/02/2010 10:30:00",
          "01/02/2010 14:15:30", "01/02/2010 13:22:10"]
    rows = [(str(i), datetime.strptime(t, "%m/%d/%Y %H:%M:%S"), "ACM2278", "logon") for i, t in enumerate(ts)]
    s = sessionize(_events(spark, rows), 10)
    assert s.select("session_id").distinct().count() == 6


def test_time_bins_and_weekday(spark):
    rows = [(str(i), datetime(2024, 1, 1, h, m), "u", "file") for i, (h, m) in
            enumerate([(5, 59), (6, 0), (12, 0), (18, 0)])]
    out = add_temporal_columns(_events(spark, rows)).orderBy("event_id").collect()
    assert [r.time_bin for r in out] == ["night", "morning", "afternoon", "evening"]
    assert {r.day_of_week for r in out} == {0}


def test_align_fills_defaults(spark):
    df = spark.createDataFrame([("1",)], "event_id string")
    r = align_to_unified(df).first()
    assert r.email_size == 0 and r.url == "" and r.is_valid is True and r.timestamp is None
    assert len(r) == 24
