"""Raw logs → unified events (projection, multi-format timestamp
parsing, ETL session id, schema alignment, union) and date extraction.

All of it is built-in expressions (``try_to_timestamp``, ``md5``,
``regexp_extract_all``): no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.expr import align_to_unified

# Accepted timestamp layouts, tried in this order (first match wins).
TIMESTAMP_FORMATS = [
    "M/d/yyyy H:m:s",
    "yyyy-M-d H:m:s",
    "M/d/yyyy H:m",
    "d-M-yyyy H:m",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d",
]
# The older validation twin lacks the day-first layout.
TIMESTAMP_FORMATS_V1 = [f for f in TIMESTAMP_FORMATS if f != "d-M-yyyy H:m"]


def parse_timestamp(text: Column, formats=TIMESTAMP_FORMATS) -> Column:
    """First format that parses wins; empty or unparseable → null.
    Parsed wall-clock values are kept as TIMESTAMP_NTZ."""
    t = F.trim(text.cast("string"))
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.when((t.isNull()) | (t == ""), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(*tries))


def etl_session_id(user: Column, pc: Column, date_text: Column) -> Column:
    """First 12 hex of md5('user_pc_' + first 10 chars of the raw date)."""
    key = F.concat_ws("_", F.coalesce(user.cast("string"), F.lit("")),
                      F.coalesce(pc.cast("string"), F.lit("")),
                      F.substring(F.coalesce(date_text.cast("string"), F.lit("")), 1, 10))
    return F.substring(F.md5(key), 1, 12)


def _common(raw: DataFrame, activity_type: str, source_file: str) -> list[Column]:
    return [F.col("id").cast("string").alias("event_id"),
            parse_timestamp(F.col("date")).alias("timestamp"),
            F.col("user").cast("string").alias("user_id"),
            F.col("pc").cast("string").alias("pc_id"),
            F.lit(activity_type).alias("activity_type"),
            F.lit(source_file).alias("source_file"),
            etl_session_id(F.col("user"), F.col("pc"), F.col("date")).alias("session_id")]


def normalize_logon(raw: DataFrame) -> DataFrame:
    """subtype = logon_activity = activity."""
    return raw.select(*_common(raw, "logon", "logon.csv"),
                      F.col("activity").alias("activity_subtype"), F.col("activity").alias("logon_activity"))


def normalize_file(raw: DataFrame) -> DataFrame:
    """Subtype 'access'; file_name = filename, file_tree = content."""
    return raw.select(*_common(raw, "file", "file.csv"), F.lit("access").alias("activity_subtype"),
                      F.col("filename").alias("file_name"), F.col("content").alias("file_tree"))


def normalize_email(raw: DataFrame) -> DataFrame:
    """Subtype 'send'; size and attachments coerced to numbers (try_cast)."""
    return raw.select(*_common(raw, "email", "email.csv"), F.lit("send").alias("activity_subtype"),
                      F.col("to").alias("email_to"), F.col("cc").alias("email_cc"),
                      F.col("bcc").alias("email_bcc"), F.col("from").alias("email_from"),
                      F.col("size").try_cast("double").try_cast("bigint").alias("email_size"),
                      F.col("attachments").try_cast("double").try_cast("bigint").alias("email_attachments"),
                      F.col("content").alias("email_content"))


def normalize_device(raw: DataFrame) -> DataFrame:
    """subtype = device_activity = activity."""
    return raw.select(*_common(raw, "device", "device.csv"),
                      F.col("activity").alias("activity_subtype"), F.col("activity").alias("device_activity"))


def normalize_http(raw: DataFrame) -> DataFrame:
    """Subtype 'request'; url, http_content = content."""
    return raw.select(*_common(raw, "http", "http.csv"), F.lit("request").alias("activity_subtype"),
                      F.col("url").alias("url"), F.col("content").alias("http_content"))


NORMALIZERS = {"logon": normalize_logon, "file": normalize_file, "email": normalize_email,
               "device": normalize_device, "http": normalize_http}


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By-name union of per-type frames (ordering happens only at a sink)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


# ------------------------------------------------------------ N11
# Date patterns searched in text, in this order.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}:\d{2}:\d{2}",
]


def extract_dates(text: Column) -> Column:
    """Every match of the three patterns, concatenated in pattern order,
    as epoch seconds (array<double>).  Time-only matches have no date → null."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in DATE_PATTERNS])
    return F.transform(found, lambda s: epoch_seconds_ntz(F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))))


def epoch_seconds_ntz(ts: Column) -> Column:
    """Seconds since 1970-01-01 for a TIMESTAMP_NTZ wall-clock value (UTC reading)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1e6)
