"""The threat graph as vertex and edge DataFrames.

Vertices: users (activity count, stress, departments), assets (one per pc),
HR records ('hr_<user>').  Edges: uses_pc (one relation per event row) and
has_hr_record; the simple graph keeps one edge per (src, dst) with the last
relation's attributes and the relation count.  Degrees and the per-user
cross-domain pattern are aggregations — no graph library, nothing collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOUR_LIST = 10


def user_vertices(events: DataFrame, stress: DataFrame | None = None) -> DataFrame:
    """G1: one vertex per user: activity_count, stress_level (given, else 0),
    distinct departments when the events carry one."""
    aggs = [F.count(F.lit(1)).alias("activity_count")]
    if "department" in events.columns:
        aggs.append(F.array_sort(F.collect_set("department")).alias("departments"))
    else:
        aggs.append(F.array().cast("array<string>").alias("departments"))
    v = events.groupBy("user_id").agg(*aggs)
    if stress is not None:
        v = v.join(stress.select("user_id", F.col("stress_level").alias("_s")), "user_id", "left")
    else:
        v = v.withColumn("_s", F.lit(None).cast("double"))
    return v.select(F.col("user_id").alias("entity_id"), F.lit("user").alias("entity_type"),
                    F.lit(0.0).alias("risk_score"), "activity_count",
                    F.coalesce("_s", F.lit(0.0)).alias("stress_level"), "departments")


def asset_vertices(events: DataFrame) -> DataFrame:
    """One vertex per distinct pc."""
    return (events.select(F.col("pc_id").alias("entity_id")).distinct()
                  .select("entity_id", F.lit("asset").alias("entity_type"), F.lit(0.0).alias("risk_score"),
                          F.lit("PC").alias("asset_type")))


def hr_vertices(hr: DataFrame) -> DataFrame:
    """G3: 'hr_<user>' vertices with role, department, is_manager, hire date, tenure, and conflicts and
    termination risk where the records carry them (else 0)."""
    given = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in hr.columns else F.lit(0.0)
    return hr.select(F.concat(F.lit("hr_"), F.col("user_id")).alias("entity_id"),
                     F.lit("hr_record").alias("entity_type"), F.lit(0.0).alias("risk_score"),
                     F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("department", F.lit("")).alias("department"),
                     F.coalesce("manager_level", F.lit(False)).alias("is_manager"),
                     "hire_date", F.coalesce("tenure_days", F.lit(0)).alias("tenure_days"),
                     given("conflicts").alias("conflicts"), given("termination_risk").alias("termination_risk"))


def relations(events: DataFrame, hr: DataFrame | None = None) -> DataFrame:
    """Every relation (multi-edges kept): uses_pc per event, has_hr_record per HR row."""
    score = F.col("anomaly_score") if "anomaly_score" in events.columns else F.lit(0.0)
    order = F.col("timestamp") if "timestamp" in events.columns else F.lit(None).cast("timestamp_ntz")
    r = events.select(F.col("user_id").alias("src"), F.col("pc_id").alias("dst"),
                      F.lit("uses_pc").alias("relation_type"), F.lit(1.0).alias("weight"),
                      F.coalesce(score.cast("double"), F.lit(0.0)).alias("anomaly_score"),
                      order.alias("ts"), F.lit(0).alias("_phase"))
    if hr is not None:
        r = r.unionByName(hr.select(F.col("user_id").alias("src"),
                                    F.concat(F.lit("hr_"), F.col("user_id")).alias("dst"),
                                    F.lit("has_hr_record").alias("relation_type"), F.lit(1.0).alias("weight"),
                                    F.lit(0.0).alias("anomaly_score"),
                                    F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("_phase")))
    return r


def simple_edges(rel: DataFrame) -> DataFrame:
    """One edge per (src, dst); attributes of the last relation (HR after
    events, then by time, then the higher score), plus how many relations were merged."""
    order = F.struct(F.col("_phase"), F.col("ts"), F.col("anomaly_score"))
    return rel.groupBy("src", "dst").agg(
        F.max_by(F.struct("relation_type", "weight", "anomaly_score"), order).alias("_a"),
        F.count(F.lit(1)).alias("relation_count")) \
        .select("src", "dst", "_a.relation_type", "_a.weight", "_a.anomaly_score", "relation_count")


def vertices(users: DataFrame, assets: DataFrame, hrs: DataFrame | None, edges: DataFrame) -> DataFrame:
    """All vertices (common columns); endpoints that only appear on an edge
    get type 'unknown' and risk 0 (D24).  An id of several kinds is what was added last: HR record, asset, user."""
    kinds = [users, assets] + ([hrs] if hrs is not None else [])
    v = reduce(DataFrame.unionByName, [k.select("entity_id", F.struct(F.lit(i).alias("_added"), "risk_score", "entity_type").alias("_v"))
                                       for i, k in enumerate(kinds)])
    v = v.groupBy("entity_id").agg(F.max("_v").alias("_v")).select("entity_id", "_v.entity_type", "_v.risk_score")
    ends = edges.select(F.col("src").alias("entity_id")).unionByName(edges.select(F.col("dst").alias("entity_id"))).distinct()
    extra = ends.join(v, "entity_id", "left_anti").select(
        "entity_id", F.lit("unknown").alias("entity_type"), F.lit(0.0).alias("risk_score"))
    return v.unionByName(extra)


def entity_features(verts: DataFrame, users: DataFrame, edges: DataFrame, hrs: DataFrame | None = None) -> DataFrame:
    """4-d feature vector per vertex by type; HR records: conflicts / 10, termination risk, risk, 0."""
    outdeg = edges.groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("_out"))
    indeg = edges.groupBy(F.col("dst").alias("entity_id")).agg(F.count(F.lit(1)).alias("_in"))
    u = users.select("entity_id", "activity_count", "stress_level")
    v = verts.join(u, "entity_id", "left").join(outdeg, "entity_id", "left").join(indeg, "entity_id", "left")
    if hrs is not None:
        v = v.join(hrs.select("entity_id", "conflicts", "termination_risk"), "entity_id", "left")
    else:
        v = v.withColumns({"conflicts": F.lit(0.0), "termination_risk": F.lit(0.0)})
    out_d = F.coalesce("_out", F.lit(0)).cast("double")
    in_d = F.coalesce("_in", F.lit(0)).cast("double")
    t = F.col("entity_type")
    z = F.lit(0.0)
    feat = (F.when(t == "user", F.array(F.coalesce("activity_count", F.lit(0)) / 1000.0,
                                        F.coalesce("stress_level", z), F.col("risk_score"), out_d / 100.0))
             .when(t == "system", F.array(in_d / 100.0, z, z, z))
             .when(t == "asset", F.array(in_d / 50.0, F.lit(0.5), z, z))
             .when(t == "hr_record", F.array(F.coalesce("conflicts", z) / 10.0, F.coalesce("termination_risk", z), F.col("risk_score"), z))
             .otherwise(F.array(z, z, z, z)))
    return v.select("entity_id", "entity_type", feat.alias("features"))


def cross_domain_patterns(verts: DataFrame, edges: DataFrame) -> DataFrame:
    """G7 for every source vertex at once: distinct neighbour types, risk =
    mean neighbour risk + .05·neighbours (+.3 for ≥ 3 types, +.1 for 2),
    capped at 1 and rounded to 3 (half-even), first 10 neighbours by id: their ids, and with type and risk.
    Only the 10 listed neighbours are ever collected per user."""
    nb = (edges.select("src", "dst").distinct()
               .join(verts.select(F.col("entity_id").alias("dst"), "entity_type", "risk_score"), "dst", "left")
               .withColumn("entity_type", F.coalesce("entity_type", F.lit("unknown")))
               .withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0))))
    agg = nb.groupBy("src").agg(F.count(F.lit(1)).alias("_n"), F.avg("risk_score").alias("_mean"),
                                F.count_distinct("entity_type").alias("pattern_count"),
                                F.array_sort(F.collect_set("entity_type")).alias("entity_types"))
    w = Window.partitionBy("src").orderBy("dst")
    first = (nb.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= NEIGHBOUR_LIST)
               .groupBy("src").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("entity_id"), "entity_type", "risk_score")))
                                    .alias("connected")))
    bonus = F.when(F.col("pattern_count") >= 3, 0.3).when(F.col("pattern_count") == 2, 0.1).otherwise(0.0)
    risk = F.least(F.lit(1.0), F.bround(F.col("_mean") + F.lit(0.05) * F.col("_n") + bonus, 3))
    return (agg.join(first, "src").select(F.col("src").alias("user_id"), "pattern_count", "entity_types",
                                          F.transform("connected", lambda x: x["entity_id"]).alias("connected_entities"), "connected",
                                          risk.alias("overall_risk_score")))


def patterns_of(users: DataFrame, patterns: DataFrame) -> DataFrame:
    """G7 for given users (user_id): one that is not in the graph has no pattern and risk 0."""
    empty = {"pattern_count": F.lit(0).cast("long"), "overall_risk_score": F.lit(0.0)}
    out = users.select("user_id").join(patterns, "user_id", "left")
    return out.select("user_id", *[F.coalesce(F.col(c), empty.get(c, F.array().cast(patterns.schema[c].dataType))).alias(c)
                                   for c in patterns.columns if c != "user_id"])
