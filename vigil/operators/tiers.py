"""R-1 / R-2: risk tiers and the composite risk of the module switchboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_ABOVE, MEDIUM_ABOVE = 0.7, 0.4
# Ours (the reference calls an undefined function): weights of the composite.
COMPOSITE_WEIGHTS = {"score": 0.5, "intent": 0.3, "graph": 0.2}


def risk_tier(score: Column) -> Column:
    """R-1: > .7 high, > .4 medium, else low."""
    return F.when(score > HIGH_ABOVE, "high").when(score > MEDIUM_ABOVE, "medium").otherwise("low")


def composite_risk(score_0_1: Column, intent_score: Column, graph_risk: Column) -> Column:
    """R-2 (documented as ours): weighted mean of the normalised outlier score,
    1 − intent score and the graph risk; missing parts count as 0."""
    w = COMPOSITE_WEIGHTS
    return (F.coalesce(score_0_1, F.lit(0.0)) * w["score"] +
            (F.lit(1.0) - F.coalesce(intent_score, F.lit(1.0))) * w["intent"] +
            F.coalesce(graph_risk, F.lit(0.0)) * w["graph"])


def alerts(scores: DataFrame, intent: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """R-1 + R-2: every scored session with its composite risk and tier.

    ``scores``: (user_id, session_id, anomaly_score); ``intent``: (user_id, session_id, intent_score, ...) where the
    context stage is on; ``graph``: (user_id, overall_risk_score, ...) where the graph stage is on.  A stage that is
    off, or has nothing for a session, adds nothing to the composite.  → (user_id, session_id, score_0_1, intent_score,
    graph_risk_score, composite_risk, risk_tier)."""
    ends = scores.agg(F.max("anomaly_score"), F.min("anomaly_score")).first()
    high, low = (F.lit(x).cast("double") for x in ends)
    out = scores.select("user_id", "session_id", F.try_divide(F.col("anomaly_score") - low, high - low).alias("score_0_1"))
    if intent is not None:
        out = out.join(intent.select("user_id", "session_id", "intent_score"), ["user_id", "session_id"], "left")
    else:
        out = out.withColumn("intent_score", F.lit(None).cast("double"))
    if graph is not None:
        out = out.join(graph.select("user_id", F.col("overall_risk_score").alias("graph_risk_score")), "user_id", "left")
    else:
        out = out.withColumn("graph_risk_score", F.lit(None).cast("double"))
    risk = composite_risk(F.col("score_0_1"), F.col("intent_score"), F.col("graph_risk_score"))
    return (out.withColumn("composite_risk", risk).withColumn("risk_tier", risk_tier(F.col("composite_risk")))
               .select("user_id", "session_id", "score_0_1", "intent_score", "graph_risk_score", "composite_risk", "risk_tier"))
