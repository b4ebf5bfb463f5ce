"""D-1 / D-2: sensitive-pattern scans over text tables.

Patterns are a small literal map; each row is scanned with
``regexp_extract_all`` for every pattern in one projection, then exploded to
one alert per (row, pattern) with matches.  Java and RE2 treat ``\\d`` as
ASCII digits (Python's ``re`` would also accept other scripts' digits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shipped sensitive-data patterns.
DEFAULT_PATTERNS = {
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}
# A third pattern registered for the stand-in documents (e-mail addresses).
EMAIL_PATTERN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def detect_leakage(df: DataFrame, text_col: str, id_cols: list[str], patterns: dict | None = None,
                   risk_level: str = "high") -> DataFrame:
    """D-1: one alert per (row, pattern) that matches, with all matches."""
    patterns = patterns or DEFAULT_PATTERNS
    hits = F.array(*[F.struct(F.lit(name).alias("pattern_matched"),
                              F.regexp_extract_all(F.col(text_col), F.lit(p), 0).alias("matches"))
                     for name, p in patterns.items()])
    return (df.select(*id_cols, F.explode(hits).alias("h"))
              .where(F.size("h.matches") > 0)
              .select(*id_cols, "h.pattern_matched", "h.matches", F.lit(risk_level).alias("risk_level")))


def scan_text(df: DataFrame, text_col: str, id_cols: list[str], patterns: dict | None = None,
              risk_level: str = "medium") -> DataFrame:
    """D-2: boolean match per (row, pattern) over extracted text."""
    patterns = patterns or DEFAULT_PATTERNS
    hits = F.array(*[F.struct(F.lit(name).alias("pattern_matched"), F.col(text_col).rlike(p).alias("hit"))
                     for name, p in patterns.items()])
    return (df.select(*id_cols, F.explode(hits).alias("h")).where(F.col("h.hit"))
              .select(*id_cols, "h.pattern_matched", F.lit(risk_level).alias("risk_level")))
