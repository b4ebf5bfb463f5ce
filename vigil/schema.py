"""Unified event schema, raw log schemas and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _L, _D, _B = T.StringType(), T.TimestampNTZType(), T.LongType(), T.DoubleType(), T.BooleanType()

# Unified event columns in their order, with types.
UNIFIED_FIELDS = [
    ("event_id", _S), ("timestamp", _TS), ("user_id", _S), ("pc_id", _S),
    ("activity_type", _S), ("activity_subtype", _S), ("source_file", _S),
    ("session_id", _S), ("logon_activity", _S), ("file_tree", _S),
    ("file_name", _S), ("email_to", _S), ("email_cc", _S), ("email_bcc", _S),
    ("email_from", _S), ("email_size", _L), ("email_attachments", _L),
    ("email_content", _S), ("device_activity", _S), ("url", _S),
    ("http_content", _S), ("data_quality_score", _D), ("is_valid", _B),
    ("validation_errors", _S),
]

UNIFIED_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in UNIFIED_FIELDS])

# Default used when a column is absent from a normalised frame.
DEFAULTS = {_S: "", _L: 0, _D: 0.0, _B: True}

# Raw log columns per file type, and the file names.
RAW_COLUMNS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size",
              "attachments", "content"],
    "device": ["id", "date", "user", "pc", "activity"],
    "http": ["id", "date", "user", "pc", "url", "content"],
}
RAW_FILES = {t: f"{t}.csv" for t in RAW_COLUMNS}

ACTIVITY_TYPES = ["logon", "file", "email", "device", "http"]


def raw_schema(file_type: str) -> T.StructType:
    return T.StructType([T.StructField(c, _S, True) for c in RAW_COLUMNS[file_type]])


# Session feature columns fed to the outlier models (numeric only).
SESSION_FEATURES = [
    "session_duration_s", "event_cnt", "file_rate", "logon_rate", "device_rate",
    "http_rate", "interarrival_mean_s", "interarrival_std_s", "rare_logon_hour",
    "file_burst", "2gram_diversity", "3gram_diversity", "unusual_transitions",
]
PEER_COLUMNS = ["session_duration_s", "file_rate", "logon_rate", "device_rate", "http_rate"]
