"""B-1 – B-3: overall and per-group detection metrics and flag-rate disparity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISPARITY_LIMIT = 0.2


def _metrics(pred, truth):
    tp = F.count_if((pred == 1) & (truth == 1))
    fp = F.count_if((pred == 1) & (truth == 0))
    fn = F.count_if((pred == 0) & (truth == 1))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).cast("double")
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).cast("double")
    return prec, rec


def overall(df: DataFrame, pred: str = "prediction", truth: str = "truth") -> DataFrame:
    """B-1: accuracy, precision, recall."""
    p, t = F.col(pred), F.col(truth)
    prec, rec = _metrics(p, t)
    return df.agg(F.avg((p == t).cast("double")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))


def group_metrics(df: DataFrame, attributes: list[str], pred: str = "prediction",
                  truth: str = "truth") -> DataFrame:
    """B-2: per (attribute, value): precision, recall, flag rate.  Attributes
    are stacked to long form so one aggregate covers all of them; null values
    form their own group."""
    long = df.select(F.col(pred).alias("_p"), F.col(truth).alias("_t"),
                     F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"),
                                                  F.col(a).cast("string").alias("value")) for a in attributes]))
                     .alias("g"))
    prec, rec = _metrics(F.col("_p"), F.col("_t"))
    return long.groupBy("g.attribute", "g.value").agg(
        prec.alias("precision"), rec.alias("recall"), F.avg(F.col("_p").cast("double")).alias("flag_rate"))


def disparity(groups: DataFrame, limit: float = DISPARITY_LIMIT) -> DataFrame:
    """B-3: max − min flag rate pooled over all attributes; biased if above the limit."""
    d = groups.agg((F.max("flag_rate") - F.min("flag_rate")).alias("demographic_parity"))
    return d.withColumn("bias_detected", F.round(F.col("demographic_parity"), 9) > limit)
