"""Readers for the parquet tables and adapters that map them onto the
reference's inputs (activity events, user dimension, insider labels).

Every adapter is a lazy projection over a parquet scan, so Catalyst prunes
columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.expr import align_to_unified

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# How the generic event types stand in for the five log types.
EVENT_TYPE_TO_ACTIVITY = {
    "signup": "logon",
    "click": "file",
    "view": "http",
    "purchase": "email",
    "error": "device",
}
# Subtype per activity type for the stand-in events.
ACTIVITY_SUBTYPE = {
    "logon": "Logon",
    "file": "access",
    "email": "send",
    "device": "connect",
    "http": "request",
}


def _map_literal(mapping: dict[str, str], key: Column) -> Column:
    """A CASE over a small fixed dictionary (stays JVM-side, codegen'd)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as unified activity events (24 columns, see ``schema``)."""
    ev = read_table(spark, sf_dir, "events")
    act = _map_literal(EVENT_TYPE_TO_ACTIVITY, F.col("event_type"))
    pc_k = F.get_json_object(F.col("props"), "$.k")
    df = ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("PC-"), pc_k).alias("pc_id"),
        act.alias("activity_type"),
        F.col("value"),
        pc_k.alias("_k"),
    )
    sub = _map_literal(ACTIVITY_SUBTYPE, F.col("activity_type"))
    df = df.select(
        "event_id", "timestamp", "user_id", "pc_id", "activity_type",
        sub.alias("activity_subtype"),
        F.concat(F.col("activity_type"), F.lit(".csv")).alias("source_file"),
        F.when(F.col("activity_type") == "logon", sub).alias("logon_activity"),
        F.when(F.col("activity_type") == "device", sub).alias("device_activity"),
        F.when(F.col("activity_type") == "email",
               F.floor("value").cast("bigint")).alias("email_size"),
        F.when(F.col("activity_type") == "http",
               F.concat(F.lit("http://site"), F.col("_k"), F.lit(".example.com/"))).alias("url"),
    )
    return align_to_unified(df)


# Stand-in roles by market segment, project names by user id.
SEGMENT_ROLE = {
    "AUTOMOBILE": "Engineer",
    "BUILDING": "Manager",
    "FURNITURE": "Admin",
    "HOUSEHOLD": "Analyst",
    "MACHINERY": "Contractor",
}
PROJECTS = ["Alpha", "Beta", "Gamma", "Delta", "Epsilon"]


def user_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ min(orders.o_orderdate) as the user dimension.

    nation is 25 rows (fixed by TPC-H), so it is broadcast.  The order-date
    minimum is a partial aggregate per customer before the join.
    """
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    first_order = (read_table(spark, sf_dir, "orders")
                   .groupBy("o_custkey")
                   .agg(F.min("o_orderdate").alias("_first_order")))
    proj = F.element_at(F.array(*[F.lit(p) for p in PROJECTS] + [F.lit(None).cast("string")]),
                        (F.pmod(F.col("c_custkey"), F.lit(6)) + 1).cast("int"))
    return (
        cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
        .join(first_order, cust.c_custkey == first_order.o_custkey, "left")
        .select(
            F.col("c_custkey").cast("string").alias("user_id"),
            _map_literal(SEGMENT_ROLE, F.col("c_mktsegment")).alias("role"),
            F.col("n_name").alias("department"),
            (F.col("c_acctbal") > 5000).alias("manager_level"),
            F.to_date("_first_order").alias("hire_date"),
            F.lit(None).cast("int").alias("tenure_days"),
            proj.alias("project"),
        )
    )


def insider_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-insider label set: one ``user_id`` column (users with id % 10 = 0)."""
    return (read_table(spark, sf_dir, "customer")
            .where(F.pmod(F.col("c_custkey"), F.lit(10)) == 0)
            .select(F.col("c_custkey").cast("string").alias("user_id")))


# Layouts used to render event times as raw log text.  One in
# eight rows gets an unparseable value so the quality checks have work.
RAW_DATE_LAYOUTS = [
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "dd-MM-yyyy HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd",
]


def raw_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five raw log tables (all string columns, reference layouts)
    rendered from ``events`` — the stand-in for the CSV extracts."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    layout = F.pmod(F.col("event_id"), F.lit(len(RAW_DATE_LAYOUTS) + 1))
    date = None
    for i, fmt in enumerate(RAW_DATE_LAYOUTS):
        v = F.date_format("ts", fmt)
        date = F.when(layout == i, v) if date is None else date.when(layout == i, v)
    date = date.otherwise(F.lit("n/a"))
    act = _map_literal(EVENT_TYPE_TO_ACTIVITY, F.col("event_type"))
    base = ev.select(F.col("event_id").cast("string").alias("id"), date.alias("date"),
                     F.col("user_id").cast("string").alias("user"), F.concat(F.lit("PC-"), k).alias("pc"),
                     act.alias("_act"), F.col("value"), k.alias("_k"))
    hi = F.col("value") >= 25
    out = {
        "logon": base.where(F.col("_act") == "logon").select(
            "id", "date", "user", "pc", F.when(hi, "Logoff").otherwise("Logon").alias("activity")),
        "file": base.where(F.col("_act") == "file").select(
            "id", "date", "user", "pc", F.concat(F.lit("file_"), F.col("_k"), F.lit(".txt")).alias("filename"),
            F.concat(F.lit("C:\\Users\\"), F.col("user"), F.lit("\\Documents\\")).alias("content")),
        "email": base.where(F.col("_act") == "email").select(
            "id", "date", "user", "pc", F.concat(F.lit("u"), F.col("_k"), F.lit("@company.com")).alias("to"),
            F.lit(None).cast("string").alias("cc"), F.lit(None).cast("string").alias("bcc"),
            F.concat(F.col("user"), F.lit("@company.com")).alias("from"),
            F.floor(F.col("value") * 100).cast("string").alias("size"),
            F.pmod(F.col("_k").cast("int"), F.lit(3)).cast("string").alias("attachments"),
            F.concat(F.lit("value "), F.floor(F.col("value") * 100).cast("string")).alias("content")),
        "device": base.where(F.col("_act") == "device").select(
            "id", "date", "user", "pc", F.when(hi, "disconnect").otherwise("connect").alias("activity")),
        "http": base.where(F.col("_act") == "http").select(
            "id", "date", "user", "pc", F.concat(F.lit("http://site"), F.col("_k"), F.lit(".example.com")).alias("url"),
            F.lit("request").alias("content")),
    }
    return out
