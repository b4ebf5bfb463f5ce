"""Writers, readers and stores: S2, S5, S6, S9, S10, S11, splitting raw logs, graph attributes, report order, shipping."""
import os
import sys
import tempfile
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from vigil import session
from vigil.operators import context as C
from vigil.operators import evaluate as E
from vigil.operators import graph as G
from vigil.plans import etl as ETL
from vigil.sources import io as IO

RAW = "id string, date string, user string, pc string, activity string"


def folder(kind):
    return tempfile.mkdtemp(prefix=f"vigil-{kind}-", dir="/tmp")


def unified(spark):
    rows = [(str(i), f"2010-01-0{1 + i % 3} 08:00:{i:02d}", f"u{i % 2}", "P", "Logon") for i in range(9)]
    return ETL.process_type(spark.createDataFrame(rows, RAW), "logon")


def test_processed_events_round_trip(spark):
    df = unified(spark)
    for fmt in ("parquet", "csv"):
        out = folder(fmt) + "/x"
        IO.write_table(df, out, fmt)
        back = IO.read_unified(spark, out, fmt)
        assert back.schema.simpleString() == IO.UNIFIED_SCHEMA.simpleString() and back.count() == 9
        assert {(r.event_id, r.timestamp) for r in back.collect()} == {(r.event_id, r.timestamp) for r in df.collect()}
    out = folder("json") + "/x"
    IO.write_table(df, out, "json")
    assert spark.read.json(out).count() == 9


def test_events_by_day_are_pruned(spark):
    out = folder("day") + "/x"
    IO.write_events_by_day(unified(spark), out)
    assert sorted(d for d in os.listdir(out) if d.startswith("event_date=")) == [f"event_date=2010-01-0{i}" for i in (1, 2, 3)]
    read = spark.read.parquet(out).where("event_date = DATE'2010-01-02'")
    assert read.count() == 3 and "PartitionFilters: [isnotnull(event_date" in read._jdf.queryExecution().executedPlan().toString()


def test_destinations(spark):
    out = folder("dest") + "/x"
    write = IO.destination_writer({"path": out})
    write(unified(spark), 0)
    write(unified(spark), 1)
    assert spark.read.parquet(out).count() == 18


def test_knowledge_base_round_trip(spark):
    out = folder("kb")
    kb = spark.createDataFrame([("a1", "benign", [0.1, 0.2])], "id string, outcome string, vec array<double>")
    tables = (C.role_permissions_table(spark), C.project_lifecycles_table(spark), C.temporal_rules_table(spark))
    IO.save_knowledge_base(out, kb, *tables)
    back = IO.load_knowledge_base(spark, out)
    assert back["kb"].collect() == kb.collect()
    for name, df in zip(("role_permissions", "project_lifecycles", "temporal_rules"), tables):
        assert sorted(map(str, back[name].collect())) == sorted(map(str, df.collect()))


def test_profile_export(spark):
    out = folder("prof") + "/x"
    profiles = spark.createDataFrame([("a", 3, 1.5), ("b", 1, 2.5)], "user_id string, activity_count long, file_rate double")
    flags = spark.createDataFrame([("a", True)], "user_id string, drift_detected boolean")
    IO.export_profiles(profiles, out, F.lit(datetime(2024, 1, 1)), flags)
    rows = {r.user_id: r for r in spark.read.option("header", True).csv(out).collect()}
    assert rows["a"].drift_detected == "true" and rows["b"].drift_detected is None and rows["a"].file_rate == "1.5"
    assert rows["a"].last_updated.startswith("2024-01-01")


def test_raw_logs_split_without_line_breaks(spark):
    path = folder("raw") + "/logon.csv"
    with open(path, "w") as f:
        f.write("id,date,user,pc,activity\n" + "\n".join(f'{i},2010-01-01 08:00:00,"u,{i}",p,Logon' for i in range(3000)) + "\n1,2,3\n1,2,3,4,5,6\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        split, whole = (IO.load_raw_log(spark, path, "logon", multi_line=m) for m in (False, True))
        assert split.rdd.getNumPartitions() > 2 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 3001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_graph_attributes_and_unknown_users(spark):
    ev = spark.createDataFrame([("a", "x", 0.1), ("a", "x", 0.9), ("b", "a", 0.0)], "user_id string, pc_id string, anomaly_score double")
    hr = spark.createDataFrame([("a", "Eng", "IT", True, None, None, 4, 0.5), ("c", None, None, None, None, 7, None, None)],
                               "user_id string, role string, department string, manager_level boolean, hire_date date, tenure_days int, conflicts int, termination_risk double")
    users, assets, hrs = G.user_vertices(ev), G.asset_vertices(ev), G.hr_vertices(hr)
    got = {r.entity_id: r for r in hrs.collect()}
    assert (got["hr_a"].role, got["hr_a"].is_manager, got["hr_a"].tenure_days, got["hr_c"].role, got["hr_c"].tenure_days) == ("Eng", True, 0, "", 7)
    edges = G.simple_edges(G.relations(ev, hr))
    verts = G.vertices(users, assets, hrs, edges)
    assert {r.entity_id: r.entity_type for r in verts.collect()} == {
        "a": "asset", "b": "user", "x": "asset", "hr_a": "hr_record", "hr_c": "hr_record", "c": "unknown"}     # "a" is added again as a machine
    feats = {r.entity_id: r.features for r in G.entity_features(verts, users, edges, hrs).collect()}
    assert feats["hr_a"] == [0.4, 0.5, 0.0, 0.0] and feats["hr_c"] == [0.0] * 4
    assert {r.dst: r.anomaly_score for r in edges.where("src = 'a'").collect()}["x"] == 0.9
    asked = spark.createDataFrame([("a",), ("nobody",)], "user_id string")
    p = {r.user_id: r for r in G.patterns_of(asked, G.cross_domain_patterns(verts, edges)).collect()}
    assert (p["nobody"].pattern_count, p["nobody"].overall_risk_score, p["nobody"].connected) == (0, 0.0, [])
    assert [(x.entity_id, x.entity_type) for x in p["a"].connected] == [("hr_a", "hr_record"), ("x", "asset")]


def test_user_risk_order(spark):
    s = spark.createDataFrame([("a", 0.5, 1.0, 0.1), ("b", 0.9, 0.5, 0.2), ("c", 0.5, 1.0, 0.3), ("d", 0.1, 1.0, 0.9)],
                              "user_id string, avg_anomaly_score double, outlier_rate double, max_anomaly_score double")
    assert [r.user_id for r in E.ordered_user_risk(s).collect()] == ["b", "a", "c", "d"]
    dense = s.withColumn("avg_local_density", F.lit(1.0))
    assert [r.user_id for r in E.ordered_user_risk(dense).collect()] == ["d", "c", "a", "b"]


def test_grid_report_digits(spark):
    grid = spark.createDataFrame([(0.1, 1, 0.33333333, 1.00005), (0.1, 2, 0.33333333, 2.0)], "contamination double, num_outliers long, outlier_rate double, mean_outlier_score double")
    assert tuple(E.grid_report(grid, 4).first()) == (0.1, 1.5, 0.3333, 1.5)
    assert E.grid_report(grid).first().outlier_rate == 0.33333333


def test_kept_frames_are_released(spark):
    df = session.keep(spark.range(10))
    assert df.is_cached
    session.release()
    assert not df.storageLevel.useMemory


def test_package_can_be_shipped(spark):
    archive = session.ship(spark)
    assert "vigil/operators/knn.py" in zipfile.ZipFile(archive).namelist()

    def where(batches):
        import vigil.session
        for b in batches:
            yield b
    assert spark.range(4).mapInArrow(where, "id long").count() == 4 and archive.endswith(".zip") and sys.modules["vigil"]
