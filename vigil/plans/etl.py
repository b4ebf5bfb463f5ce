"""Batch ETL plan (N9, N10): per log type quality report → normalise →
row flags → align → de-duplicate → fill; then one by-name union.

Five lazy plans feed one union; the per-type quality score enters each
plan as a scalar subquery, so nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigil.functions.expr import align_to_unified
from vigil.operators import quality as Q
from vigil.operators.normalize import NORMALIZERS, union_all


def process_type(raw: DataFrame, file_type: str, dedup: bool = True, fill: bool = True,
                 ffill_key: str | None = None) -> DataFrame:
    """N9 for one log type."""
    report = Q.quality_report(raw, file_type)
    score = report.select("overall_quality_score").scalar()
    norm = NORMALIZERS[file_type](raw)
    flagged = Q.add_quality_flags(norm, score)
    out = align_to_unified(flagged)
    if dedup:
        out = Q.drop_duplicates(out)
    if fill:
        out = Q.fill_missing(out, ffill_key=ffill_key)
    return out


def batch_process(raw_by_type: dict[str, DataFrame], **kw) -> DataFrame:
    """All types; a type with no source is skipped (checked before planning)."""
    frames = [process_type(raw, t, **kw) for t, raw in raw_by_type.items() if raw is not None]
    return union_all(frames)


def quality_reports(raw_by_type: dict[str, DataFrame]) -> DataFrame:
    return union_all([Q.quality_report(raw, t) for t, raw in raw_by_type.items()])
