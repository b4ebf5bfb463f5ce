"""Runs composed from stage switches: E9 (false-positive reduction) and R-2 (the module switchboard).

The outlier scores and the session matrix come in, already cut from their
lineage, so that no switch computes them again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from vigil.operators import evaluate as EVAL
from vigil.operators import forest as FOREST
from vigil.operators import tiers as TIER
from vigil.operators.lof import select_numeric
from vigil.session import cut_lineage


class Reduction(NamedTuple):
    """Rows with all stage flags, metrics before and after and of every stage, the difference in points, and (supervised stage)
    held-out metrics and importances."""

    rows: DataFrame
    metrics: DataFrame
    improvement: DataFrame
    test_metrics: DataFrame | None
    importances: DataFrame | None
    stages: DataFrame


def reduce_false_positives(scores: DataFrame, matrix: DataFrame, insiders: DataFrame, score_percentile: float = 80,
                           use_ensemble: bool = True, use_supervised: bool = True, contamination: float = 0.10) -> Reduction:
    """Labels → score threshold → context filter → [isolation-forest agreement] → [supervised re-scoring] → metrics."""
    rows = EVAL.with_labels(scores, matrix, insiders)
    rows = EVAL.context_filter(EVAL.score_threshold(rows, score_percentile))
    if use_ensemble:
        rows = FOREST.ensemble_agreement(rows, FOREST.isolation_forest_flags(matrix, contamination=contamination))
    test_metrics = importances = None
    if use_supervised:
        rows, test_metrics, importances = FOREST.supervised_rescoring(rows, select_numeric(matrix))
    rows = cut_lineage(rows)
    metrics = EVAL.before_after(rows)
    return Reduction(rows, metrics, EVAL.improvement(metrics), test_metrics, importances, EVAL.before_after(rows, every_stage=True))


def integrated(scores: DataFrame, intent=None, graph=None, cre_enabled: bool = False, utcg_enabled: bool = False) -> DataFrame:
    """R-2: outlier scores → [contextual reasoning] → [graph patterns] → composite risk and tier of every session.

    ``intent`` and ``graph`` are functions that make the stage's frame: a stage that is off is not planned."""
    return TIER.alerts(scores, intent() if cre_enabled else None, graph() if utcg_enabled else None)
