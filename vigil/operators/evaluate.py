"""M13–M17 reports and grid search; E1–E11 false-positive reduction and
evaluation.  All aggregates are single passes with partial aggregation; the
per-user baselines are groupBy + join (AQE splits a hot user's partition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.quantiles import percentile as exact_percentile, percentiles
from vigil.operators.knn import CELL_ROWS, neighbour_lists, rank_key_col, to_vectors
from vigil.operators.lof import below, lof_by_vectors, standardize, select_numeric, LRD_EPS
from vigil.session import cut_lineage

# Grid of the contamination search and its utility.
BASE_CONTAMINATIONS = [0.08, 0.10, 0.12, 0.14, 0.15, 0.16]
GRID_NEIGHBOURS = [20, 30, 40]
COVERAGE_TARGET = 2500


# ------------------------------------------------------------ reports
def top_anomalies(scores: DataFrame, n: int = 20, outliers_only: bool = True) -> DataFrame:
    """The n highest anomaly scores (variant B: outliers only).
    Ties resolve on (user_id, session_id); plans as TakeOrderedAndProject."""
    s = scores.where(F.col("is_outlier")) if outliers_only else scores
    return s.orderBy(rank_key_col(F.col("anomaly_score")).desc(), "user_id", "session_id").limit(n)


def user_risk_summary(scores: DataFrame, with_density: bool = True) -> DataFrame:
    """Per user total/outlier sessions, mean/max score (B: + mean local
    density), outlier rate."""
    aggs = [F.count("session_id").alias("total_sessions"),
            F.sum(F.col("is_outlier").cast("long")).alias("outlier_sessions"),
            F.avg("anomaly_score").alias("avg_anomaly_score"),
            F.max("anomaly_score").alias("max_anomaly_score")]
    if with_density:
        aggs.append(F.avg("local_density").alias("avg_local_density"))
    return (scores.groupBy("user_id").agg(*aggs)
                  .withColumn("outlier_rate", F.col("outlier_sessions") / F.col("total_sessions")))


def ordered_user_risk(summary: DataFrame) -> DataFrame:
    """M17's order: with density by outlier rate, then highest score; without it by mean score; then by user."""
    by = ["outlier_rate", "max_anomaly_score"] if "avg_local_density" in summary.columns else ["avg_anomaly_score"]
    return summary.orderBy(*[F.col(c).desc_nulls_last() for c in by], "user_id")


def contamination_grid_values(rate: float | None) -> list[float]:
    """M13 grid: base rates plus four around the insider rate, sorted, unique."""
    vals = list(BASE_CONTAMINATIONS)
    if rate:
        vals += [max(0.001, rate * 0.5), rate, rate * 1.1, rate * 1.2]
    return sorted(set(vals))


def contamination_grid(points: DataFrame, contaminations: list[float], n: int,
                       ks=GRID_NEIGHBOURS, block_rows: int = CELL_ROWS) -> DataFrame:
    """One kNN at max(k); LOF for every k from the neighbour-rank prefix, all in one pass;
    all thresholds by one selection.
    → (contamination, n_neighbors, num_outliers, outlier_rate,
       mean_outlier_score, combined_score)."""
    kmax = max(1, min(max(ks), n - 1))
    # One kNN at the largest k, cut once; every k reads its rank prefix.
    found = neighbour_lists(points, kmax + 1, block_rows)
    lofs = cut_lineage(lof_by_vectors(found, [max(1, min(k, n - 1)) for k in ks]).select(*[f"lof{i}" for i in range(len(ks))]))
    thresholds = percentiles(lofs, {i: -F.col(f"lof{i}") for i in range(len(ks))}, contaminations)
    grids = []
    for i, k in enumerate(ks):
        lof, thr = lofs.select(F.col(f"lof{i}").alias("lof")), thresholds[i]
        per_c = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).cast("double").alias("t"))
                                    for c, t in zip(contaminations, thr)]))
        g = (lof.select("lof", per_c.alias("ct"))
                .select(F.col("ct.c").alias("contamination"), "lof",
                        below(-F.col("lof"), F.col("ct.t")).alias("o"))
                .groupBy("contamination")
                .agg(F.sum(F.col("o").cast("long")).alias("num_outliers"),
                     F.count(F.lit(1)).alias("_n"),
                     F.avg(F.when(F.col("o"), F.col("lof"))).alias("_mean"))
                .select("contamination", F.lit(k).alias("n_neighbors"), "num_outliers",
                        (F.col("num_outliers") / F.col("_n")).alias("outlier_rate"),
                        F.coalesce("_mean", F.lit(0.0)).alias("mean_outlier_score")))
        grids.append(g)
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    cover = F.least(F.col("num_outliers"), F.lit(COVERAGE_TARGET)) / F.lit(float(COVERAGE_TARGET))
    return out.withColumn("combined_score", F.col("mean_outlier_score") * F.lit(1e-9) + cover * F.lit(1000.0))


def best_grid_params(grid: DataFrame) -> DataFrame:
    """M13 choice: highest combined score with at least one outlier; the
    first in grid order (contamination, then k) wins ties."""
    return (grid.where(F.col("num_outliers") > 0)
                .orderBy(F.col("combined_score").desc(), "contamination", "n_neighbors").limit(1))


def grid_report(grid: DataFrame, digits: int | None = None) -> DataFrame:
    """Means per contamination over the k values, rounded where ``digits`` are given (the printed report has 4)."""
    mean = lambda c: (F.avg(c) if digits is None else F.round(F.avg(c), digits)).alias(c)
    return grid.groupBy("contamination").agg(mean("num_outliers"), mean("outlier_rate"), mean("mean_outlier_score"))


# ------------------------------------------------------------ FP reduction
def with_labels(scores: DataFrame, features: DataFrame, insiders: DataFrame) -> DataFrame:
    """E1 + E2: scores ⟕ features on (user, session); true_label = user is a
    known insider; total_emails = 0 when absent."""
    feat_cols = [c for c in features.columns if c not in ("user_id", "session_id")]
    f = features.select("user_id", "session_id", *[F.col(f"`{c}`") for c in feat_cols
                                                     if c not in scores.columns])
    m = scores.join(f, ["user_id", "session_id"], "left")
    lab = insiders.select("user_id").distinct().withColumn("_ins", F.lit(1))
    m = m.join(lab, "user_id", "left").withColumn(
        "true_label", F.when(F.col("_ins").isNotNull(), 1).otherwise(0)).drop("_ins")
    if "total_emails" not in m.columns:
        m = m.withColumn("total_emails", F.lit(0))
    return m


def score_threshold(merged: DataFrame, percentile: float = 80) -> DataFrame:
    """Keep outliers scoring at least the p-th percentile of outlier scores."""
    merged = cut_lineage(merged)
    thr = F.lit(exact_percentile(merged.where(F.col("is_outlier")), F.col("anomaly_score"), percentile / 100.0)).cast("double")
    return merged.withColumn("high_confidence_outlier",
                             F.col("is_outlier") & ~below(F.col("anomaly_score"), thr))


def context_filter(merged: DataFrame) -> DataFrame:
    """Current flag AND (file_rate > 3× user mean, or device_rate > 2×,
    or after_hours_activity > 0 when present)."""
    base = merged.groupBy("user_id").agg(F.avg("file_rate").alias("_fb"), F.avg("device_rate").alias("_db"))
    m = merged.join(base, "user_id", "left")
    cond = (F.col("file_rate") > F.col("_fb") * 3) | (F.col("device_rate") > F.col("_db") * 2)
    if "after_hours_activity" in merged.columns:
        cond = cond | (F.col("after_hours_activity") > 0)
    cur = F.col("high_confidence_outlier") if "high_confidence_outlier" in merged.columns else F.col("is_outlier")
    return m.withColumn("context_filtered_outlier", cur & F.coalesce(cond, F.lit(False))).drop("_fb", "_db")


STAGES = ["supervised_outlier", "ensemble_outlier", "context_filtered_outlier",
          "high_confidence_outlier", "is_outlier"]
# Stages between the raw and the final flag, in their order; the last is what all of them together left.
BETWEEN = [("threshold", "high_confidence_outlier"), ("context", "context_filtered_outlier"),
           ("ensemble", "ensemble_outlier"), ("narrowed", "narrowed_outlier")]


def final_flag_column(df: DataFrame) -> str:
    """The most refined stage present."""
    for c in STAGES:
        if c in df.columns:
            return c
    return "is_outlier"


def confusion_metrics(df: DataFrame, pred_col: str, label_col: str = "true_label") -> DataFrame:
    """Tp, fp, fn, tn, accuracy, precision, recall, f1 (0 on zero division)."""
    p = F.col(pred_col).cast("boolean")
    y = F.col(label_col) == 1
    m = df.agg(F.count(F.when(p & y, 1)).alias("tp"), F.count(F.when(p & ~y, 1)).alias("fp"),
               F.count(F.when(~p & y, 1)).alias("fn"), F.count(F.when(~p & ~y, 1)).alias("tn"))
    return _rates(m)


def before_after(df: DataFrame, final_col: str | None = None, every_stage: bool = False) -> DataFrame:
    """E7 + E8: metrics of the raw flag and of the final stage in one pass,
    one row per stage (the difference of the two rows is the improvement);
    with ``every_stage`` a row for each stage between them too."""
    final_col = final_col or final_flag_column(df)
    between = [(name, c) for name, c in BETWEEN if c in df.columns] if every_stage else []
    stages = [("original", "is_outlier"), *between, ("final", final_col)]
    y = F.col("true_label") == 1
    aggs = []
    for i, (_, c) in enumerate(stages):
        p = F.col(c).cast("boolean")
        aggs += [F.count(F.when(p & y, 1)).alias(f"tp{i}"), F.count(F.when(p & ~y, 1)).alias(f"fp{i}"),
                 F.count(F.when(~p & y, 1)).alias(f"fn{i}"), F.count(F.when(~p & ~y, 1)).alias(f"tn{i}")]
    counts = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(c).alias("flag_column"),
                 F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                 F.col(f"fn{i}").alias("fn"), F.col(f"tn{i}").alias("tn"))
        for i, (name, c) in enumerate(stages)]))
    return _rates(counts.select(rows.alias("r")).select("r.*"))


def improvement(stages: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``before_after`` side by side with their difference in percentage points,
    one row per metric (metric, original, final, improvement_pp)."""
    names = ["precision", "recall", "f1_score"]
    at = lambda c, stage: F.max(F.when(F.col("stage") == stage, F.col(c)))
    wide = stages.agg(*[at(c, s).alias(f"{s}_{c}") for c in names for s in ("original", "final")])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"original_{c}").alias("original"),
                                        F.col(f"final_{c}").alias("final")) for c in names]))
    return wide.select(rows.alias("r")).select("r.*", ((F.col("r.final") - F.col("r.original")) * 100.0).alias("improvement_pp"))


def _rates(m: DataFrame) -> DataFrame:
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    acc = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"),
                                  F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0))
    keep = [c for c in m.columns if c not in ("tp", "fp", "fn", "tn")]
    return m.select(*keep, "tp", "fp", "fn", "tn", acc.cast("double").alias("accuracy"),
                    prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                    f1.cast("double").alias("f1_score"))


def top_detected_insiders(scores: DataFrame, insiders: DataFrame, n: int = 10) -> DataFrame:
    """insiders' sessions, detected sessions, max score, detection rate;
    highest detection rate, then detected count (then user id) first."""
    ins = scores.join(insiders.select("user_id").distinct(), "user_id", "left_semi")
    return (ins.groupBy("user_id").agg(
                F.count("session_id").alias("total_sessions"),
                F.sum(F.col("is_outlier").cast("long")).alias("detected_sessions"),
                F.max("anomaly_score").alias("max_anomaly_score"))
              .withColumn("detection_rate", F.col("detected_sessions") / F.col("total_sessions"))
              .orderBy(F.col("detection_rate").desc(), F.col("detected_sessions").desc(), "user_id")
              .limit(n))


def run_summary(scores: DataFrame, insiders: DataFrame) -> DataFrame:
    """Sessions, outliers, rate, insider sessions, detected, detection rate."""
    lab = insiders.select("user_id").distinct().withColumn("_ins", F.lit(True))
    s = scores.join(lab, "user_id", "left")
    ins = F.col("_ins").isNotNull()
    return s.agg(F.count(F.lit(1)).alias("total_sessions"),
                 F.count(F.when(F.col("is_outlier"), 1)).alias("total_outliers"),
                 F.count(F.when(ins, 1)).alias("insider_sessions"),
                 F.count(F.when(ins & F.col("is_outlier"), 1)).alias("detected_insider_sessions")) \
            .select("*", (F.col("total_outliers") / F.col("total_sessions")).alias("outlier_rate"),
                    F.try_divide(F.col("detected_insider_sessions"), F.col("insider_sessions"))
                    .cast("double").alias("insider_detection_rate"))
