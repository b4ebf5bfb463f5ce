"""DuckDB oracle SQL for the ETL queries (raw logs rendered from events)."""

from vigil.plans.sql_fragments import r6
from vigil.schema import RAW_COLUMNS, UNIFIED_FIELDS

_LAYOUTS = ["%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d-%m-%Y %H:%M",
            "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d"]

_date = "CASE event_id % 8 " + " ".join(
    f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(_LAYOUTS)) + " ELSE 'n/a' END"

RAW = f"""
rbase AS (
  SELECT CAST(event_id AS VARCHAR) AS id, {_date} AS date, CAST(user_id AS VARCHAR) AS "user",
         'PC-' || json_extract_string(props, '$.k') AS pc, json_extract_string(props, '$.k') AS k, value,
         CASE event_type WHEN 'signup' THEN 'logon' WHEN 'click' THEN 'file' WHEN 'view' THEN 'http'
              WHEN 'purchase' THEN 'email' WHEN 'error' THEN 'device' END AS act
  FROM events),
raw_logon AS (SELECT id, date, "user", pc, CASE WHEN value >= 25 THEN 'Logoff' ELSE 'Logon' END AS activity
              FROM rbase WHERE act = 'logon'),
raw_file AS (SELECT id, date, "user", pc, 'file_' || k || '.txt' AS filename,
                    'C:\\Users\\' || "user" || '\\Documents\\' AS content FROM rbase WHERE act = 'file'),
raw_email AS (SELECT id, date, "user", pc, 'u' || k || '@company.com' AS "to", CAST(NULL AS VARCHAR) AS cc,
                     CAST(NULL AS VARCHAR) AS bcc, "user" || '@company.com' AS "from",
                     CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS size,
                     CAST(CAST(k AS INTEGER) % 3 AS VARCHAR) AS attachments,
                     'value ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS content
              FROM rbase WHERE act = 'email'),
raw_device AS (SELECT id, date, "user", pc, CASE WHEN value >= 25 THEN 'disconnect' ELSE 'connect' END AS activity
               FROM rbase WHERE act = 'device'),
raw_http AS (SELECT id, date, "user", pc, 'http://site' || k || '.example.com' AS url, 'request' AS content
             FROM rbase WHERE act = 'http')"""


def parse_ts(x: str) -> str:
    tries = ", ".join(f"try_strptime({x}, '{f}')" for f in _LAYOUTS)
    return f"(CASE WHEN trim({x}) = '' OR {x} IS NULL THEN NULL ELSE coalesce({tries}) END)"


def _q(c: str) -> str:
    return f'"{c}"'


def quality_sql(t: str) -> str:
    cols = RAW_COLUMNS[t]
    miss = ", ".join(f"count(*) FILTER (WHERE {_q(c)} IS NULL) * 100.0 / count(*)" for c in cols)
    return f"""
q_{t} AS (
  SELECT '{t}' AS file_type, count(*) AS total_records, greatest({miss}) AS max_missing_pct,
         (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM raw_{t} GROUP BY ALL_COLS)) AS duplicate_count,
         count(*) FILTER (WHERE {parse_ts('date')} IS NOT NULL) AS valid_timestamps
  FROM raw_{t}),
qs_{t} AS (
  SELECT *, max_missing_pct < 10.0 AS missing_pass, duplicate_count * 100.0 / total_records AS duplicate_pct,
         duplicate_count * 100.0 / total_records < 5.0 AS duplicates_pass,
         valid_timestamps * 100.0 / total_records AS timestamp_validity_pct,
         valid_timestamps * 100.0 / total_records >= 95.0 AS timestamp_pass
  FROM q_{t}),
qf_{t} AS (
  SELECT *, (CAST(missing_pass AS INT) + CAST(duplicates_pass AS INT) + CAST(timestamp_pass AS INT)) * 100.0 / 3
            AS overall_quality_score FROM qs_{t})""".replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(_q(c) for c in cols))


_SPECIFIC = {
    "logon": "'logon' AS activity_type, activity AS activity_subtype, activity AS logon_activity",
    "file": "'file' AS activity_type, 'access' AS activity_subtype, filename AS file_name, content AS file_tree",
    "email": "'email' AS activity_type, 'send' AS activity_subtype, \"to\" AS email_to, cc AS email_cc, "
             "bcc AS email_bcc, \"from\" AS email_from, "
             "CAST(TRY_CAST(size AS DOUBLE) AS BIGINT) AS email_size, "
             "CAST(TRY_CAST(attachments AS DOUBLE) AS BIGINT) AS email_attachments, content AS email_content",
    "device": "'device' AS activity_type, activity AS activity_subtype, activity AS device_activity",
    "http": "'http' AS activity_type, 'request' AS activity_subtype, url AS url, content AS http_content",
}
_PRESENT = {
    "logon": {"logon_activity"}, "file": {"file_name", "file_tree"},
    "email": {"email_to", "email_cc", "email_bcc", "email_from", "email_size", "email_attachments", "email_content"},
    "device": {"device_activity"}, "http": {"url", "http_content"},
}
_FILL = {"activity_type": "'Unknown'", "activity_subtype": "'Unknown'", "source_file": "'Unknown'",
         "email_size": "0", "email_attachments": "0", "email_content": "''", "file_name": "''",
         "url": "''", "validation_errors": "''"}
_COMMON = {"event_id", "timestamp", "user_id", "pc_id", "activity_type", "activity_subtype", "source_file",
           "session_id", "data_quality_score", "is_valid", "validation_errors"}


def unified_sql(t: str) -> str:
    sel = []
    for name, dtype in UNIFIED_FIELDS:
        typ = dtype.simpleString()
        if name in _COMMON or name in _PRESENT[t]:
            expr = _q(name)
        elif typ == "string":
            expr = "''"
        elif typ == "bigint":
            expr = "0"
        else:
            expr = "NULL"
        if name in _FILL:
            expr = f"coalesce({expr}, {_FILL[name]})"
        duck_t = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT",
                  "double": "DOUBLE", "boolean": "BOOLEAN"}[typ]
        sel.append(f"CAST({expr} AS {duck_t}) AS {_q(name)}")
    return f"""
n_{t} AS (
  SELECT id AS event_id, {parse_ts('date')} AS "timestamp", "user" AS user_id, pc AS pc_id,
         '{t}.csv' AS source_file,
         substr(md5(coalesce("user", '') || '_' || coalesce(pc, '') || '_' || substr(coalesce(date, ''), 1, 10)), 1, 12) AS session_id,
         {_SPECIFIC[t]}
  FROM raw_{t}),
f_{t} AS (
  SELECT *, (SELECT overall_quality_score FROM qf_{t}) / 100.0 AS data_quality_score,
         (event_id IS NOT NULL AND "timestamp" IS NOT NULL AND user_id IS NOT NULL AND pc_id IS NOT NULL
          AND activity_type IS NOT NULL) AS is_valid,
         concat_ws('|', CASE WHEN "timestamp" IS NULL THEN 'invalid_timestamp' END,
                        CASE WHEN user_id IS NULL OR user_id = '' THEN 'missing_user_id' END,
                        CASE WHEN pc_id IS NULL OR pc_id = '' THEN 'missing_pc_id' END) AS validation_errors
  FROM n_{t}),
d_{t} AS (SELECT DISTINCT * FROM f_{t}),
k_{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pc_id, "timestamp", activity_type
                                                     ORDER BY event_id NULLS LAST) AS rn FROM d_{t}) WHERE rn = 1),
u_{t} AS (SELECT {', '.join(sel)} FROM k_{t})"""


TYPES = ["logon", "file", "email", "device", "http"]
ETL_CTE = "WITH " + RAW + "," + ",".join(quality_sql(t) for t in TYPES) + "," + \
          ",".join(unified_sql(t) for t in TYPES) + ",\nunified AS (" + \
          " UNION ALL ".join(f"SELECT * FROM u_{t}" for t in TYPES) + ")"

QUALITY_COLS = ("file_type, total_records, " + r6("max_missing_pct") + " AS max_missing_pct, "
                "duplicate_count, valid_timestamps, missing_pass, " + r6("duplicate_pct") + " AS duplicate_pct, "
                "duplicates_pass, " + r6("timestamp_validity_pct") + " AS timestamp_validity_pct, "
                "timestamp_pass, " + r6("overall_quality_score") + " AS overall_quality_score")
