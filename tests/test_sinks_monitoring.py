"""Ordered and publishing sinks, dataset description, monitoring rows and alerts."""
import json
import os
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.operators import quality as Q
from vigil.plans import etl as ETL
from vigil.sources import io as IO
from vigil.streaming import processor as P

EVENTS = "event_id string, timestamp timestamp_ntz, user_id string, activity_type string, data_quality_score double, is_valid boolean"


def folder(kind):
    return tempfile.mkdtemp(prefix=f"vigil-{kind}-", dir="/tmp")


def events(spark, n=500):
    t = datetime(2024, 1, 1)
    rows = [(f"e{i:04d}", None if i % 13 == 0 else t if i % 3 == 0 else t + timedelta(minutes=(i * 7919) % 5000), f"u{i % 5}",
             None if i == 7 else ["logon", "file", "odd"][i % 3], 0.5, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, EVENTS).repartition(5)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_ordered_files_read_by_name(spark, fmt):
    out = folder("ordered") + "/x"
    df = events(spark)
    IO.write_ordered(df, out, fmt=fmt, files=4)
    names = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    assert len(names) > 1
    got = []
    for f in names:
        r = spark.read.schema(df.schema)
        one = {"parquet": r.parquet, "csv": r.option("header", True).csv, "json": r.json}[fmt](f"{out}/{f}")
        got += [(x.timestamp, x.event_id) for x in one.coalesce(1).collect()]
    want = sorted(((x.timestamp, x.event_id) for x in df.collect()), key=lambda r: (r[0] is None, r[0] or datetime.min, r[1]))
    assert got == want


def test_saved_dataset_has_its_description(spark):
    base = folder("saved") + "/events"
    IO.save_processed(events(spark), base)
    assert spark.read.parquet(base + ".parquet").count() == spark.read.option("header", True).csv(base + ".csv").count() == 500
    text = "".join(open(f"{base}.json/{f}").read() for f in os.listdir(base + ".json") if f.endswith(".json"))
    d = json.loads(text)
    assert d["total_records"] == 500 and d["columns"] == [f.split()[0] for f in EVENTS.split(", ")]
    assert d["data_types"]["timestamp"] == "timestamp_ntz" and d["date_range"]["start"].startswith("2024-01-01T00:00:00")
    assert d["quality_metrics"]["avg_quality_score"] == 0.5 and d["quality_metrics"]["valid_records_percentage"] == 50.0
    assert d["quality_metrics"]["records_by_activity_type"] == {"logon": 167, "file": 166, "odd": 166}
    assert Q.dataset_schema(events(spark)).where("column = 'is_valid'").first().data_type == "boolean"
    empty = Q.describe_dataset(events(spark).limit(0)).first()
    assert empty.total_records == 0 and not empty.quality_metrics.records_by_activity_type


def test_published_epochs_stand_once(spark):
    out, ledger = folder("publish"), folder("ledger")
    write = IO.publish_writer(ledger, "cert-processed", "user_id", folder=out)
    first, second = events(spark, 10), events(spark, 4)
    for batch, epoch in ((first, 0), (first, 0), (second, 1), (first, 1)):     # replays of finished epochs
        write(batch, epoch)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 14 and {r.topic for r in rows} == {"cert-processed"} and {r.key for r in rows} == {f"u{i}" for i in range(5)}
    assert json.loads(rows[0].value)["event_id"].startswith("e")
    broken = IO.publish_writer(folder("ledger2"), "t", folder=out)
    broken(first, 5)
    IO.publish_writer(folder("ledger3"), "t", folder=out)(first, 5)            # broke off before the ledger: overwritten, not doubled
    assert spark.read.parquet(out).where("epoch_id = 5").count() == 10
    for bad in ({}, {"folder": out, "kafka": {}}):
        with pytest.raises(ValueError):
            IO.publish_writer(ledger, "t", **bad)


def test_publishing_stream(spark):
    src, out, ck = folder("src"), folder("out"), folder("ck")
    events(spark, 30).write.mode("overwrite").parquet(src + "/a")
    stream = spark.readStream.schema(spark.read.parquet(src + "/a").schema).parquet(src + "/*")
    for _ in range(2):
        IO.publish(stream, ck, "t", folder=out, available_now=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 30 and os.listdir(ck + "/published")


def envelopes(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))


def test_monitor_makes_rows_and_raises_both_alerts(spark):
    src, out, ck = folder("mon"), folder("monout"), folder("monck")
    good = {"id": "1", "date": "2010-01-02 08:28:06", "user": "A", "pc": "P", "activity": "Logon"}
    old = "2020-01-01 00:00:00"
    envelopes(src + "/a.json", [{"file_type": "logon", "timestamp": old, "data": json.dumps(good)}, {"file_type": "logon", "timestamp": old, "data": "broken"}])
    seen = []
    monitor = P.IngestionMonitor(on_alert=seen.append)
    spark.streams.addListener(monitor)
    try:
        stream = IO.watched_directory_stream(spark, src, P.ENVELOPE_SCHEMA, pattern="*.json")
        P.start_ingestion(stream, out, ck, available_now=True).awaitTermination(120)
        end = time.time() + 30
        while not seen and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(monitor)
    row = next(r for r in monitor.rows if r["events_processed"])
    assert (row["events_processed"], row["events_failed"], row["quality_score"]) == (2, 1, 0.5) and row["lag_seconds"] > 300
    assert seen[0]["quality_alert"] and seen[0]["lag_alert"]


def test_alert_thresholds():
    row = lambda events, failed, newest: P.metrics_row({
        "timestamp": "2024-01-01T00:10:00.000Z", "observedMetrics": {"ingest": {"events": events, "events_failed": failed, "newest_ms": newest}}})
    base = datetime.fromisoformat("2024-01-01T00:00:00+00:00").timestamp() * 1000
    for r, want in ((row(10, 2, base + 300_000), (False, False)), (row(10, 3, base + 299_000), (True, True)), (row(0, 0, None), (False, False))):
        got = P.alerts(r["quality_score"], r["lag_seconds"])
        assert (got["quality_alert"], got["lag_alert"]) == want
    assert P.metrics_row({})["quality_score"] is None


def test_one_scan_report_equals_direct_counts(spark):
    rows = [("1", "2010-01-02 08:28:06", "A", "P", "Logon"), ("1", "2010-01-02 08:28:06", "A", "P", "Logon"), ("2", "nope", None, "P", None),
            ("2", "nope", "P", None, None), (None, None, None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "id string, date string, user string, pc string, activity string").repartition(3)
    r = Q.quality_report(raw, "logon").first()
    assert (r.total_records, r.duplicate_count, r.valid_timestamps) == (7, 3, 2)
    assert r.max_missing_pct == 5 * 100.0 / 7 and not r.missing_pass and not r.duplicates_pass and not r.timestamp_pass
    plan = ETL.process_type(raw, "logon")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
    empty = Q.quality_report(raw.limit(0), "logon").first()
    assert empty.total_records == 0 and empty.overall_quality_score == 0.0


def test_forward_fill_equals_one_window(spark):
    import random
    from pyspark.sql import Window
    r = random.Random(4)
    t = datetime(2024, 1, 1)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), f"{r.randrange(10**6):06d}-{i}", None if r.random() < 0.1 else t + timedelta(minutes=r.randrange(6000)),
             r.choice([None, None, "x", "y"]), r.choice([None, None, None, "p", "q"])) for i in range(900)]
    df = spark.createDataFrame(rows, "user_id string, event_id string, timestamp timestamp_ntz, pc_id string, subtype string").repartition(4)
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").asc_nulls_last(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("user_id", "event_id", "timestamp", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("pc_id", "subtype")])
    got = Q.forward_fill(df, ["pc_id", "subtype"], "user_id")
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
