"""M18 isolation forest (Liu, Ting & Zhou, ICDM 2008) and M19 random-forest
re-scoring, plus E5 (ensemble agreement) and E9 (full FP-reduction run).

Isolation forest on Spark:
  * each tree draws ≤ ``max_samples`` rows by a per-tree hash of the id
    (one expression per row, then a bounded per-tree ``row_number``), so only
    ~T·max_samples rows ever leave the scan;
  * trees are grown in ``applyInPandas`` grouped by tree id;
  * the forest (≤ T·(2·max_samples − 1) nodes, a size fixed by parameters,
    not by the data) is shipped to a vectorised ``mapInArrow`` scorer;
  * labels use the same percentile rule as LOF (strict, contamination share).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.quantiles import percentile, smallest
from vigil.operators.knn import to_vectors
from vigil.operators.lof import below, select_numeric, standardize
from vigil.session import cut_lineage

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, "
               "right_child int, size long")
EULER = 0.5772156649015329


def average_path_length(n):
    """c(n): expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feats, thrs, lefts, rights, sizes = [], [], [], [], []

    def new_node():
        feats.append(-1); thrs.append(0.0); lefts.append(-1); rights.append(-1); sizes.append(0)
        return len(feats) - 1

    stack = [(new_node(), np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        sizes[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= t
        ln, rn = new_node(), new_node()
        feats[node], thrs[node], lefts[node], rights[node] = f, t, ln, rn
        stack.append((ln, idx[go_left], depth + 1))
        stack.append((rn, idx[~go_left], depth + 1))
    return feats, thrs, lefts, rights, sizes


def _build_trees(max_samples: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(max_samples, 2))))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values("id", kind="stable")
        x = np.vstack(pdf["vec"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        f, t, l, r, s = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype=np.int32),
                             "feature": np.array(f, dtype=np.int32), "threshold": np.array(t),
                             "left_child": np.array(l, dtype=np.int32),
                             "right_child": np.array(r, dtype=np.int32), "size": np.array(s, dtype=np.int64)})
    return run


def fit_isolation_forest(points: DataFrame, n: int, n_trees: int = 100, max_samples: int = 256,
                         seed: int = 42) -> DataFrame:
    """Grow the forest from (id, vec) points → node table (bounded size)."""
    m = min(max_samples, n)
    p = min(1.0, 2.0 * m / max(n, 1))
    bucket = 1 << 62                            # fine enough for any number of rows
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(bucket))
                     < F.lit(int(p * bucket)))
    sampled = points.select("id", "vec", F.explode(trees).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("id", "tree", F.lit(seed)), "id")
    sampled = sampled.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m).drop("_r")
    return sampled.groupBy("tree").applyInPandas(_build_trees(m, seed), NODE_SCHEMA)


def score_isolation_forest(points: DataFrame, nodes: DataFrame, sample_size: int) -> DataFrame:
    """(id, vec) → (id, if_score) with if_score = 2^(−E[h(x)] / c(ψ)) (higher
    is more anomalous).  The node table is collected once (its size is fixed
    by n_trees and max_samples) and scored in Arrow batches."""
    nd = nodes.orderBy("tree", "node").toPandas()
    trees = []
    for _, g in nd.groupby("tree"):
        left, right, size = (g[c].to_numpy() for c in ("left_child", "right_child", "size"))
        depth = np.zeros(len(left))
        for i in np.flatnonzero(left >= 0):              # children come after their parent
            depth[left[i]] = depth[right[i]] = depth[i] + 1
        # A leaf is its own child, so that all rows take the same number of steps.
        here, leaf = np.arange(len(left)), left < 0
        children = np.stack([np.where(leaf, here, left), np.where(leaf, here, right)], axis=1).ravel()
        trees.append((np.where(leaf, 0, g["feature"].to_numpy()), g["threshold"].to_numpy(), children.astype(np.int64),
                      depth + average_path_length(size), int(depth.max())))
    c_psi = float(average_path_length([sample_size])[0]) or 1.0
    spark = points.sparkSession
    bc = spark.sparkContext.broadcast(trees)

    def run(batches):
        forest = bc.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            start, x = np.arange(n) * x.shape[1], x.ravel()
            total = np.zeros(n)
            for feat, thr, children, path, steps in forest:
                node = np.zeros(n, dtype=np.int64)
                for _ in range(steps):
                    right = ~(x.take(start + feat.take(node)) <= thr.take(node))
                    node = children.take(2 * node + right)
                total += path.take(node)
            mean_path = total / len(forest)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.power(2.0, -mean_path / c_psi))], names=["id", "if_score"])

    return points.select("id", "vec").mapInArrow(run, "id string, if_score double")


def isolation_forest_flags(df: DataFrame, feature_cols: list[str] | None = None,
                           id_cols=("user_id", "session_id"), contamination: float = 0.10,
                           n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """Standardise features, fit, score and flag the contamination share
    with the highest isolation scores → (*id_cols, if_score, iso_outlier)."""
    feats = feature_cols or select_numeric(df, exclude=id_cols)
    key = F.concat_ws("\u0001", *[F.col(c) for c in id_cols])
    base = df.select(*id_cols, *[F.col(f"`{c}`") for c in feats]).withColumn("_key", key)
    pts = to_vectors(standardize(base, feats), "_key", feats)
    n = base.count()
    nodes = fit_isolation_forest(pts, n, n_trees, max_samples, seed)
    scores = cut_lineage(score_isolation_forest(pts, nodes, min(max_samples, n)))
    thr = F.lit(percentile(scores, -F.col("if_score"), contamination)).cast("double")
    scores = scores.withColumn("iso_outlier", below(-F.col("if_score"), thr))
    return (base.select(*id_cols, F.col("_key").alias("id")).join(scores, "id").drop("id"))


def ensemble_agreement(merged: DataFrame, iso: DataFrame) -> DataFrame:
    """E5: current stage flag AND isolation-forest flag."""
    cur = next(c for c in ("context_filtered_outlier", "high_confidence_outlier", "is_outlier")
               if c in merged.columns)
    m = merged.join(iso.select("user_id", "session_id", "if_score", "iso_outlier"),
                    ["user_id", "session_id"], "left")
    return m.withColumn("ensemble_outlier", F.col(cur) & F.coalesce("iso_outlier", F.lit(False)))


def stratified_split(df: DataFrame, label_col: str, labels: list, id_cols: list[str], train_share: float, seed: int = 42,
                     name: str = "train") -> DataFrame:
    """``df`` with a boolean ``name`` that holds for ``train_share`` of each label (to the nearest row), whatever the partitions.

    Rows are ranked by a hash of their ids; the hash at each label's cut is found by a distributed selection, so no label is
    gathered in one task.  The hash keeps 52 bits: rows of one label that share it fall on one side together."""
    h = F.shiftrightunsigned(F.xxhash64(*id_cols, F.lit(seed)), 12).cast("double")
    cuts = smallest(df, {str(i): F.when(F.col(label_col) == label, h) for i, label in enumerate(labels)}, train_share)
    train = F.lit(False)
    for i, label in enumerate(labels):
        cut = cuts[str(i)][1]
        if cut is not None:
            train = train | ((F.col(label_col) == label) & (h <= F.lit(cut)))
    return df.withColumn(name, F.coalesce(train, F.lit(False)))


def supervised_rescoring(merged: DataFrame, feature_cols: list[str], test_share: float = 0.3,
                         n_trees: int = 100, max_depth: int = 10, prob_threshold: float = 0.3,
                         seed: int = 42):
    """Class-balanced random forest on features + anomaly_score; stratified
    split; probability ≥ threshold flags ``supervised_outlier`` on all rows, and
    ``narrowed_outlier`` on those that the stages before it left.
    Returns (scored frame, test metrics frame, feature importances frame)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from vigil.operators.evaluate import confusion_metrics, final_flag_column

    before = final_flag_column(merged)
    cols = list(feature_cols) + ["anomaly_score"]
    x = merged
    for c in cols:
        x = x.withColumn(c, F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)))
    x = cut_lineage(x)
    counts = {r["true_label"]: r["count"] for r in x.groupBy("true_label").count().collect()}    # two labels
    weight = F.lit(None).cast("double")
    for label, n in counts.items():
        weight = F.when(F.col("true_label") == label, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
    x = x.withColumn("_w", weight)
    x = stratified_split(x, "true_label", list(counts), ["user_id", "session_id"], 1 - test_share, seed, "_train")
    safe = {c: f"f{i}" for i, c in enumerate(cols)}
    xv = VectorAssembler(inputCols=[safe[c] for c in cols], outputCol="_fv").transform(
        x.select("*", *[F.col(f"`{c}`").alias(safe[c]) for c in cols]))
    rf = RandomForestClassifier(featuresCol="_fv", labelCol="true_label", weightCol="_w",
                                numTrees=n_trees, maxDepth=max_depth, seed=seed)
    model = rf.fit(xv.where(F.col("_train")).withColumn("true_label", F.col("true_label").cast("double")))
    scored = (model.transform(xv)
                   .withColumn("supervised_insider_prob", vector_to_array("probability")[1])
                   .withColumn("supervised_outlier", F.col("supervised_insider_prob") >= F.lit(prob_threshold))
                   .withColumn("narrowed_outlier", F.col(before) & F.col("supervised_outlier"))
                   .drop("_fv", "rawPrediction", "probability", "prediction", "_w", *safe.values()))
    test_metrics = confusion_metrics(scored.where(~F.col("_train")), "supervised_outlier")
    imp = model.featureImportances.toArray().tolist()
    spark = merged.sparkSession
    importances = spark.createDataFrame(
        sorted(zip(cols, [float(v) for v in imp]), key=lambda t: (-t[1], t[0])), "feature string, importance double")
    return scored.drop("_train"), test_metrics, importances
