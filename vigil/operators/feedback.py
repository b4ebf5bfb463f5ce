"""A-1 / A-2: threshold adaptation from ordered analyst feedback.

Each feedback item maps the threshold t to clip(t + c, .1, .9) with
c = +r(1 − s) for a false positive, −r·s for a true positive, 0 otherwise.
Maps of the form t ↦ clip(t + c, lo, hi) are closed under composition:
  (c₁, lo₁, hi₁) then (c₂, lo₂, hi₂) = (c₁ + c₂, clip(lo₁ + c₂, lo₂, hi₂), clip(hi₁ + c₂, lo₂, hi₂)).
So the order-dependent fold is computed as ordered folds inside (key, day)
chunks, then one ordered composition of the per-day maps per key — no task
ever holds a key's whole feedback history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, RATE, LO, HI = 0.5, 0.01, 0.1, 0.9


def _step(decision: Column, score: Column, rate: float) -> Column:
    return (F.when(decision == "false_positive", F.lit(rate) * (F.lit(1.0) - score))
             .when(decision == "true_positive", -F.lit(rate) * score)
             .otherwise(F.lit(0.0)))


def _clip(x, lo, hi):
    return F.least(F.greatest(x, lo), hi)


def _compose(acc, x):
    """acc then x, both structs (c, lo, hi)."""
    return F.struct((acc["c"] + x["c"]).alias("c"),
                    _clip(acc["lo"] + x["c"], x["lo"], x["hi"]).alias("lo"),
                    _clip(acc["hi"] + x["c"], x["lo"], x["hi"]).alias("hi"))


def adaptive_thresholds(feedback: DataFrame, key: str, order_cols: list[str], ts_col: str,
                        score_col: str = "prediction_score", decision_col: str = "analyst_decision",
                        start: float = START, rate: float = RATE) -> DataFrame:
    """A-1 + A-2 per key: total feedback, true / false positives and the final threshold."""
    identity = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                    F.struct(_step(F.col(decision_col), F.col(score_col).cast("double"), rate).alias("c"),
                             F.lit(LO).alias("lo"), F.lit(HI).alias("hi")).alias("f"))
    day = F.coalesce(F.to_date(F.col(ts_col)), F.lit("9999-12-31").cast("date"))
    hour = F.coalesce(F.hour(F.col(ts_col)), F.lit(0))
    per_day = (feedback.withColumn("_day", F.struct(day.alias("day"), hour.alias("hour"))).groupBy(key, "_day").agg(
        F.sort_array(F.collect_list(item)).alias("_items"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(decision_col) == "true_positive").alias("_tp"),
        F.count_if(F.col(decision_col) == "false_positive").alias("_fp"))
        .select(key, "_day", "_n", "_tp", "_fp",
                F.aggregate(F.transform("_items", lambda x: x["f"]), identity, _compose).alias("_f")))
    per_key = per_day.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_day", "_f"))).alias("_days"),
        F.sum("_n").alias("total_feedback"), F.sum("_tp").alias("true_positives"),
        F.sum("_fp").alias("false_positives"))
    fn = F.aggregate(F.transform("_days", lambda x: x["_f"]), identity, _compose)
    return per_key.select(key, "total_feedback", "true_positives", "false_positives",
                          _clip(F.lit(start) + fn["c"], fn["lo"], fn["hi"]).alias("current_threshold"))
