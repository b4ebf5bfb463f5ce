"""X-1 / X-2: rank feature contributions per row and phrase them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 3


def explain(df: DataFrame, features: list[str], label: Column, importances: dict | None = None) -> DataFrame:
    """X-1: importance = model importance when given, else |value|; top 3 by
    importance then name.  X-2: 'Prediction: L. Key factors: f (v) contributed p%; …'."""
    items = []
    for f in features:
        imp = F.lit(float(importances[f])) if importances else F.abs(F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
        items.append(F.struct(imp.alias("importance"), F.lit(f).alias("feature"),
                              F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value")))
    ranked = F.array_sort(F.array(*items), lambda a, b: F.when(a["importance"] > b["importance"], -1)
                          .when(a["importance"] < b["importance"], 1)
                          .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(ranked, 1, TOP)
    phrase = F.transform(top, lambda x: F.format_string(
        "%s (%.2f) contributed %.1f%%", F.regexp_replace(x["feature"], "_", " "), x["value"], x["importance"] * 100))
    text = F.concat(F.lit("Prediction: "), label, F.lit(". Key factors: "), F.array_join(phrase, "; "), F.lit("."))
    return df.withColumn("top_features", F.transform(top, lambda x: x["feature"])) \
             .withColumn("natural_language_summary", text)
