"""S1 CSV edge rows, Kafka encoding, streaming routing and batch = stream replay."""
import json
import os
import tempfile
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from vigil.operators import baseline as BL
from vigil.sources import io as IO
from vigil.streaming import processor as P
from vigil.streaming.baselines import online_baselines


def test_raw_csv_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="vigil-s1-", dir="/tmp")
    path = os.path.join(d, "device.csv")
    with open(path, "w") as f:
        f.write('id,date,user,pc,activity\n1,d,u,p,a\n2,d\n3,d,u,p,a,EXTRA\n4,d,u,p,\n5,d,u,p,a,\n'
                '6,d,u,p,a,,x\n7,"a,b",u,p,a\n8,"multi\nline",u,p,a\n')
    got = {r.id: r for r in IO.load_raw_log(spark, path, "device").collect()}
    assert sorted(got) == ["1", "2", "4", "7", "8"]
    assert got["2"].user is None and got["7"].date == "a,b" and got["8"].date == "multi\nline"


def test_kafka_encoding_and_options(spark):
    df = spark.createDataFrame([("u1", 3)], "user_id string, n int")
    r = IO.encode_for_kafka(df, "cert-logon", "user_id").first()
    assert r.topic == "cert-logon" and r.key == "u1" and json.loads(r.value) == {"user_id": "u1", "n": 3}
    o = IO.kafka_source_options("h:9092", group_id="g", auto_offset_reset="earliest", max_poll_records=500)
    assert o["kafka.group.id"] == "g" and o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "500"


def test_stream_routes_and_normalises_all_types(spark):
    src = tempfile.mkdtemp(prefix="vigil-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="vigil-out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="vigil-ck-", dir="/tmp")
    env = [
        {"file_type": "logon", "data": json.dumps({"id": "1", "date": "01/02/2010 08:28:06", "user": "A", "pc": "P", "activity": "Logon"})},
        {"topic": "cert-http", "value": json.dumps({"id": "2", "date": "2010-01-02 09:00:00", "user": "A", "pc": "P", "url": "http://x", "content": "q"})},
        {"topic": "device", "value": json.dumps({"id": "3", "date": "2010-01-02", "user": "B", "pc": "Q", "activity": "connect"})},
        {"file_type": "unknown", "data": "{}"},
    ]
    with open(os.path.join(src, "batch1.json"), "w") as f:
        f.write("\n".join(json.dumps(e) for e in env))
    stream = IO.watched_directory_stream(spark, src, P.ENVELOPE_SCHEMA, pattern="*.json")
    q = P.start_ingestion(stream, out + "/events", ck, available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/events")
    assert sorted(r.activity_type for r in got.collect()) == ["device", "http", "logon"]
    assert P.metrics(q)["events_processed"] == 4


def test_online_baselines_equal_batch_replay(spark):
    rng = np.random.default_rng(1)
    rows = []
    for u in ("a", "b"):
        for i in range(12):
            rows.append((u, f"{u}{i:02d}", datetime(2024, 1, 1 + i, 9), float(rng.normal()), float(rng.normal())))
    schema = "user_id string, session_id string, session_start timestamp_ntz, x double, y double"
    hist = spark.createDataFrame(rows, schema)
    src = tempfile.mkdtemp(prefix="vigil-sess-", dir="/tmp")
    hist.coalesce(1).write.mode("overwrite").parquet(src + "/s")
    stream = spark.readStream.schema(hist.schema).parquet(src + "/s")
    res = online_baselines(stream, ["x", "y"], [0.0, 0.0], [1.0, 1.0], window=5)
    q = res.writeStream.outputMode("append").format("memory").queryName("online_bl").start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.sql("SELECT * FROM online_bl")
    assert streamed.count() == 24
    last = {r.user_id: r for r in streamed.where("activity_count = 12").collect()}
    batch = {r.user_id: r for r in BL.decayed_baseline(BL.last_w(hist, 5), ["x", "y"]).collect()}
    for u in ("a", "b"):
        assert last[u].window_size == 5
        assert np.allclose(last[u].baseline, [batch[u].x, batch[u].y], atol=1e-12)
    first = streamed.where("activity_count = 1").collect()
    assert all(r.baseline == [0.0, 0.0] and r.drift_detected is False for r in first)


def test_malformed_payloads_are_rejected_and_counted(spark):
    src, out, ck = (tempfile.mkdtemp(prefix="vigil-bad-", dir="/tmp") for _ in range(3))
    good = {"id": "1", "date": "2010-01-02 08:28:06", "user": "A", "pc": "P", "activity": "Logon"}
    data = [json.dumps(good), json.dumps(good | {"id": "2"}), "not json", '{"id": "3", "user"']
    with open(os.path.join(src, "batch1.json"), "w") as f:
        f.write("\n".join(json.dumps({"file_type": "logon", "data": x}) for x in data))
    stream = IO.watched_directory_stream(spark, src, P.ENVELOPE_SCHEMA, pattern="*.json")
    q = P.start_ingestion(stream, out + "/events", ck, available_now=True, reject_path=out + "/rejects")
    q.awaitTermination(120)
    assert spark.read.parquet(out + "/events").count() == 2       # near-duplicates of one batch both stay
    assert sorted(r.payload for r in spark.read.parquet(out + "/rejects").collect()) == sorted(data[2:])
    assert P.metrics(q)["events_failed"] == 2


def test_replayed_batch_leaves_one_copy(spark):
    out = tempfile.mkdtemp(prefix="vigil-replay-", dir="/tmp")
    row = {"file_type": "device", "data": json.dumps({"id": "3", "date": "2010-01-02", "user": "B", "pc": "Q", "activity": "connect"})}
    batch = spark.createDataFrame([row], P.ENVELOPE_SCHEMA)
    write = P.micro_batch_writer(out + "/events")
    for epoch in (0, 0, 1):
        write(batch, epoch)
    assert spark.read.parquet(out + "/events").count() == 2
