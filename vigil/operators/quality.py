"""Q1–Q12: data-quality report, row flags, de-duplication, filling and the
ETL summaries.  Every check is one aggregate pass (``count_if`` /
``avg`` over all columns at once); nothing loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.normalize import parse_timestamp
from vigil.schema import ACTIVITY_TYPES

# Quality thresholds (percent).
MISSING_MAX_PCT = 10.0
DUPLICATE_MAX_PCT = 5.0
TIMESTAMP_MIN_PCT = 95.0


def missing_by_column(raw: DataFrame, file_type: str) -> DataFrame:
    """Q1 detail: (file_type, column, missing_count, missing_pct), one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in raw.columns]
    row = raw.agg(*aggs)
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_count"))
                                  for c in raw.columns]))
    return (row.select("_n", entries.alias("e"))
               .select(F.lit(file_type).alias("file_type"), "e.column", "e.missing_count",
                       F.try_divide(F.col("e.missing_count") * 100.0, F.col("_n")).alias("missing_pct")))


def quality_report(raw: DataFrame, file_type: str, date_col: str | None = "date",
                   checks=("missing", "duplicates", "timestamp")) -> DataFrame:
    """Q1–Q4 as one row: missing (all columns < 10 %), exact duplicates
    (copies beyond the first, < 5 %), parseable timestamps (≥ 95 %), and the
    overall score = passed / run × 100.

    One scan: rows become a 128-bit hash with a mask of their nulls, equal
    rows are counted together (before the shuffle too), and all checks are
    sums over those counts.
    """
    cols = raw.columns
    names = [F.col(f"`{c}`") for c in cols]
    # Nulls take part in the hash by their mask; the copies of a row share all four fields.
    mask = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in names]).alias("_mask")
    valid = parse_timestamp(F.col(date_col)).isNotNull() if date_col and "timestamp" in checks else F.lit(False)
    rows = raw.select(F.xxhash64(*names).alias("_h1"), F.xxhash64(F.lit(1), *names).alias("_h2"), mask, valid.alias("_valid"))
    copies = rows.groupBy("_h1", "_h2", "_mask", "_valid").agg(F.count(F.lit(1)).alias("_n"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    aggs = [total("_n").alias("total_records")]
    aggs += [total(F.when(F.substring("_mask", i + 1, 1) == "1", F.col("_n"))).alias(f"_m_{i}") for i in range(len(cols))]
    if date_col and "timestamp" in checks:
        aggs.append(total(F.when(F.col("_valid"), F.col("_n"))).alias("valid_timestamps"))
    r = copies.agg(*aggs, total(F.col("_n") - 1).alias("duplicate_count"))
    def pct(c):
        return F.try_divide(c * 100.0, F.col("total_records"))
    max_missing = F.greatest(*[pct(F.col(f"_m_{i}")) for i in range(len(cols))]) \
        if len(cols) > 1 else pct(F.col("_m_0"))
    r = r.withColumn("max_missing_pct", max_missing)
    passes = []
    if "missing" in checks:
        r = r.withColumn("missing_pass", F.coalesce(F.col("max_missing_pct") < MISSING_MAX_PCT, F.lit(False)))
        passes.append("missing_pass")
    if "duplicates" in checks:
        r = (r.withColumn("duplicate_pct", pct(F.col("duplicate_count")))
              .withColumn("duplicates_pass", F.coalesce(F.col("duplicate_pct") < DUPLICATE_MAX_PCT, F.lit(False))))
        passes.append("duplicates_pass")
    if date_col and "timestamp" in checks:
        r = (r.withColumn("timestamp_validity_pct", pct(F.col("valid_timestamps")))
              .withColumn("timestamp_pass", F.coalesce(F.col("timestamp_validity_pct") >= TIMESTAMP_MIN_PCT, F.lit(False))))
        passes.append("timestamp_pass")
    score = (sum(F.col(p).cast("int") for p in passes) * 100.0 / len(passes)) if passes else F.lit(0.0)
    r = r.withColumn("overall_quality_score", score.cast("double")).withColumn("file_type", F.lit(file_type))
    return r.drop(*[f"_m_{i}" for i in range(len(cols))])


def add_quality_flags(df: DataFrame, quality_score: Column) -> DataFrame:
    """Q5 + Q6: data_quality_score = file score / 100; is_valid = five key
    fields present; validation_errors joined by '|'."""
    keys = ["event_id", "timestamp", "user_id", "pc_id", "activity_type"]
    valid = F.lit(True)
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    errs = F.concat_ws("|",
                       F.when(F.col("timestamp").isNull(), F.lit("invalid_timestamp")),
                       F.when(F.col("user_id").isNull() | (F.col("user_id") == ""), F.lit("missing_user_id")),
                       F.when(F.col("pc_id").isNull() | (F.col("pc_id") == ""), F.lit("missing_pc_id")))
    return (df.withColumn("data_quality_score", (quality_score / 100.0).cast("double"))
              .withColumn("is_valid", valid)
              .withColumn("validation_errors", errs))


def drop_duplicates(df: DataFrame, keys=("user_id", "pc_id", "timestamp", "activity_type"),
                    order_col: str = "event_id") -> DataFrame:
    """Q7: the first row per key (nulls equal; exact duplicates share their key), first = smallest
    ``order_col``, then a hash of the row.  Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def forward_fill(df: DataFrame, columns: list[str], key: str, ts_col: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """Q8: every null of ``columns`` takes the last value before it in its key's rows by (time, id), null times last.

    A segment scan: rows are filled inside (key, hour), the last value of each hour is one row, and those are
    carried over the hours; no window holds all rows of a key.  Rows without a time go by the start of their id.
    """
    hour = F.date_trunc("hour", F.col(ts_col)).cast("timestamp_ntz")
    part = F.struct(hour.isNull().alias("late"), F.coalesce(hour, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("hour"),
                    F.when(hour.isNull(), F.substring(F.col(id_col), 1, 3)).otherwise("").alias("head"))
    order = [F.col(ts_col).asc_nulls_last(), F.col(id_col)]
    upto = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_part", part)
    # The last value of a part: the greatest (time, id) among its rows with a value.
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts_col), F.col(id_col)))
    last = rows.groupBy(key, "_part").agg(*[F.max_by(F.col(c), at(c)).alias(f"_l_{c}") for c in columns])
    carried = last.select(F.col(key).alias("_key"), F.col("_part").alias("_p"),
                          *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in columns])
    out = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_c_{c}")))
    return out.select(*df.columns)


def fill_missing(df: DataFrame, ffill_key: str | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Q8: "Unknown" for three categoricals, 0 for two numerics, "" for four
    texts; forward fill of user/pc only within a caller-given key."""
    out = forward_fill(df, [c for c in ("user_id", "pc_id") if c != ffill_key], ffill_key, ts_col) if ffill_key else df
    fills = {"activity_type": "Unknown", "activity_subtype": "Unknown", "source_file": "Unknown",
             "email_size": 0, "email_attachments": 0,
             "email_content": "", "file_name": "", "url": "", "validation_errors": ""}
    return out.na.fill({k: v for k, v in fills.items() if k in out.columns})


def type_summary(df: DataFrame) -> DataFrame:
    """N10 summary per source type: records, valid records, mean quality."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("records_processed"),
                                         F.count_if(F.col("is_valid")).alias("valid_records"),
                                         F.avg("data_quality_score").alias("quality_score"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Q9: rows, valid, mean quality, timestamp coverage %, distinct users and
    pcs, date range."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.col("is_valid")).alias("valid_records"),
                  F.avg("data_quality_score").alias("avg_quality_score"),
                  (F.count("timestamp") * 100.0 / F.count(F.lit(1))).alias("timestamp_coverage_pct"),
                  F.count_distinct("user_id").alias("unique_users"),
                  F.count_distinct("pc_id").alias("unique_pcs"),
                  F.min("timestamp").alias("date_start"), F.max("timestamp").alias("date_end"))


def etl_session_stats(df: DataFrame) -> DataFrame:
    """Q10: per ETL session id: events, sorted distinct activity types, start, end."""
    return df.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"),
                                        F.array_join(F.sort_array(F.collect_set("activity_type")), ",")
                                        .alias("activity_types"),
                                        F.min("timestamp").alias("session_start"),
                                        F.max("timestamp").alias("session_end"))


def user_activity_pivot(df: DataFrame, types=ACTIVITY_TYPES) -> DataFrame:
    """Q11: user × activity type counts, 0-filled (pivot values fixed, so no
    extra job to discover them)."""
    return df.groupBy("user_id").pivot("activity_type", list(types)).count().na.fill(0)


def activity_distribution(df: DataFrame) -> DataFrame:
    """Q12: events per activity type."""
    return df.groupBy("activity_type").agg(F.count(F.lit(1)).alias("count"))


def dataset_schema(df: DataFrame) -> DataFrame:
    """One row per column of a processed dataset: place, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, data_type string")


def describe_dataset(df: DataFrame) -> DataFrame:
    """The description written next to a processed dataset, nested as its JSON: records, columns, types, dates,
    and quality with the records of every activity type."""
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("activity_type", "n"))))
    per_type = df.where(F.col("activity_type").isNotNull()).groupBy("activity_type").agg(F.count(F.lit(1)).alias("n")).agg(kinds.alias("k"))
    n = F.count(F.lit(1))
    columns = [f.name for f in df.schema.fields]
    types = [x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]
    return df.agg(
        n.alias("total_records"), F.array(*[F.lit(c) for c in columns]).alias("columns"), F.create_map(*types).alias("data_types"),
        F.struct(F.min("timestamp").alias("start"), F.max("timestamp").alias("end")).alias("date_range"),
        F.avg("data_quality_score").alias("_q"), F.try_divide(F.count_if("is_valid") * 100.0, n).alias("_v")).select(
        "total_records", "columns", "data_types", "date_range",
        F.struct(F.col("_q").alias("avg_quality_score"), F.col("_v").alias("valid_records_percentage"),
                 per_type.scalar().alias("records_by_activity_type")).alias("quality_metrics"))


def dataset_description(df: DataFrame, types=ACTIVITY_TYPES) -> DataFrame:
    """S7 as one flat row: counts of the fixed activity types."""
    aggs = [F.count(F.lit(1)).alias("total_records"), F.lit(len(df.columns)).alias("n_columns"),
            F.min("timestamp").alias("date_start"), F.max("timestamp").alias("date_end"),
            F.avg("data_quality_score").alias("avg_quality_score"),
            (F.count_if(F.col("is_valid")) * 100.0 / F.count(F.lit(1))).alias("valid_records_pct")]
    aggs += [F.count_if(F.col("activity_type") == t).alias(f"{t}_records") for t in types]
    return df.agg(*aggs)
