"""Registered queries: one Spark plan per operator family over the driver
tables, each paired (where SQL can say it) with a DuckDB oracle statement.

Every query reads whole tables; nothing is sampled or capped except where
the cap is the feature (top-N reports).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.expr import round_doubles
from vigil.operators.features import session_feature_matrix
from vigil.session import checkpoint_dir, cut_lineage, release
from vigil.plans import sql_fragments as S
from vigil.sources.tables import activity_events, user_dimension

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- features
ROLE_PEERS_SQL = "SELECT user_id, role AS peer_group FROM dim"


def _role_peers(spark, sf_dir):
    dim = user_dimension(spark, sf_dir)
    return dim.select("user_id", F.col("role").alias("peer_group"))


@register("session_matrix_gap480", S.matrix_sql(480, 0.04, 0.04, ROLE_PEERS_SQL))
def q_session_matrix_gap480(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    m = session_feature_matrix(ev, gap_minutes=480, rare_hour_threshold=0.04,
                               unusual_threshold=0.04, peers=_role_peers(spark, sf_dir))
    return round_doubles(m)


@register("session_matrix_gap10", S.matrix_sql(10, 0.01, 0.01, None))
def q_session_matrix_gap10(spark, sf_dir):
    ev = activity_events(spark, sf_dir)
    return round_doubles(session_feature_matrix(ev, gap_minutes=10, peers=None))


# ---------------------------------------------------------------- LOF
from vigil.functions.expr import round6  # noqa: E402
from vigil.operators import lof as L  # noqa: E402
from vigil.operators.knn import to_vectors  # noqa: E402
from vigil.sources.tables import read_table  # noqa: E402

EMB_K, EMB_C = 30, 0.10


@register("lof_embeddings", "WITH " + S.knn_lof_sql(S.EMB_PTS, EMB_K, EMB_C) + f"""
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, e.label,
       {S.r6('s.lof')} AS anomaly_score, {S.r6('s.lrd')} AS lrd, s.is_outlier,
       CASE WHEN s.is_outlier THEN -1 ELSE 1 END AS lof_factor,
       {S.r6('1.0 / (s.lof + 1e-10)')} AS local_density
FROM scored s JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = s.id""")
def q_lof_embeddings(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    pts = to_vectors(emb, "vec_id", vector_col="embedding")
    n = emb.count()
    sc = L.label_outliers(cut_lineage(L.lof(pts, EMB_K, n)), EMB_C)
    out = (emb.select(F.col("vec_id").cast("string").alias("id"), "vec_id", "label")
              .join(sc, "id")
              .select("vec_id", "label", F.col("lof").alias("anomaly_score"), "lrd", "is_outlier",
                      F.when(F.col("is_outlier"), -1).otherwise(1).alias("lof_factor"),
                      (F.lit(1.0) / (F.col("lof") + F.lit(L.LRD_EPS))).alias("local_density")))
    return round_doubles(out)


# Parameters of the outlier runs over the stand-in events.
GAP, RARE, UNUSUAL, DBLOF_K, DBLOF_C = 480, 0.04, 0.04, 30, 0.10


def session_matrix(spark, sf_dir):
    """Shared F1–F13 plan for every session-level query (unrounded)."""
    ev = activity_events(spark, sf_dir)
    return session_feature_matrix(ev, gap_minutes=GAP, rare_hour_threshold=RARE,
                                  unusual_threshold=UNUSUAL, peers=_role_peers(spark, sf_dir))


def _matrix_ckpt(spark, sf_dir):
    """The session matrix cut from its lineage; what its plan kept of the events is released."""
    m = cut_lineage(session_matrix(spark, sf_dir))
    if checkpoint_dir(spark):
        release()
    return m


def scored_sessions(spark, sf_dir):
    """(session matrix cut into the checkpoint folder, DBLOF scores over it)."""
    m = _matrix_ckpt(spark, sf_dir)
    return m, L.dblof_scores(m, contamination=DBLOF_C, k=DBLOF_K, checkpoint=False)


def dblof(spark, sf_dir):
    return scored_sessions(spark, sf_dir)[1]


DBLOF_CTE = S.dblof_sql(GAP, RARE, UNUSUAL, ROLE_PEERS_SQL, DBLOF_K, DBLOF_C)


@register("dblof_scores", f"""WITH {DBLOF_CTE}
SELECT user_id, session_id, lof_factor, is_outlier, {S.r6('anomaly_score')} AS anomaly_score,
       {S.r6('local_density')} AS local_density FROM dblof""")
def q_dblof_scores(spark, sf_dir):
    return round_doubles(dblof(spark, sf_dir))


# ---------------------------------------------------------------- reports & evaluation
from vigil.operators import evaluate as EVAL  # noqa: E402
from vigil.sources.tables import insider_users  # noqa: E402

r6 = S.r6
SCORE_COLS = f"user_id, session_id, lof_factor, is_outlier, {r6('anomaly_score')} AS anomaly_score, " \
             f"{r6('local_density')} AS local_density"


@register("top_anomalies", f"""WITH {DBLOF_CTE}
SELECT {SCORE_COLS} FROM dblof WHERE is_outlier
ORDER BY {S.rk('anomaly_score')} DESC, user_id, session_id LIMIT 20""")
def q_top_anomalies(spark, sf_dir):
    return round_doubles(EVAL.top_anomalies(dblof(spark, sf_dir), 20))


@register("user_risk_summary", f"""WITH {DBLOF_CTE}
SELECT user_id, count(session_id) AS total_sessions,
       CAST(sum(CAST(is_outlier AS INT)) AS BIGINT) AS outlier_sessions,
       {r6('avg(anomaly_score)')} AS avg_anomaly_score, {r6('max(anomaly_score)')} AS max_anomaly_score,
       {r6('avg(local_density)')} AS avg_local_density,
       {r6('sum(CAST(is_outlier AS INT)) / count(session_id)')} AS outlier_rate
FROM dblof GROUP BY user_id""")
def q_user_risk_summary(spark, sf_dir):
    return round_doubles(EVAL.user_risk_summary(dblof(spark, sf_dir)))


def _grid(spark, sf_dir):
    from vigil.operators.lof import standardize, insider_rate
    m = _matrix_ckpt(spark, sf_dir)
    feats = L.select_numeric(m)
    key = F.concat_ws("\u0001", "user_id", "session_id")
    pts = to_vectors(standardize(m.withColumn("_key", key), feats), "_key", feats)
    rate = m.join(insider_users(spark, sf_dir).withColumn("_i", F.lit(1.0)), "user_id", "left") \
            .agg(F.avg(F.coalesce("_i", F.lit(0.0)))).first()[0]
    return EVAL.contamination_grid(pts, EVAL.contamination_grid_values(rate), n=m.count())


GRID_CTE = S.grid_sql(GAP, RARE, UNUSUAL, ROLE_PEERS_SQL)


@register("contamination_grid", f"""WITH {GRID_CTE}
SELECT contamination, n_neighbors, num_outliers, {r6('outlier_rate')} AS outlier_rate,
       {r6('mean_outlier_score')} AS mean_outlier_score, {r6('combined_score')} AS combined_score
FROM grid2""")
def q_contamination_grid(spark, sf_dir):
    return round_doubles(_grid(spark, sf_dir).withColumn("n_neighbors", F.col("n_neighbors").cast("int")))


@register("contamination_report", f"""WITH {GRID_CTE}
SELECT contamination, {r6('avg(num_outliers)')} AS num_outliers, {r6('avg(outlier_rate)')} AS outlier_rate,
       {r6('avg(mean_outlier_score)')} AS mean_outlier_score
FROM grid2 GROUP BY contamination""")
def q_contamination_report(spark, sf_dir):
    return round_doubles(EVAL.grid_report(_grid(spark, sf_dir)))


@register("contamination_summary", f"""WITH {GRID_CTE}
SELECT contamination, round(avg(num_outliers), 4) AS num_outliers, round(avg(outlier_rate), 4) AS outlier_rate,
       round(avg(mean_outlier_score), 4) AS mean_outlier_score FROM grid2 GROUP BY contamination""")
def q_contamination_summary(spark, sf_dir):
    """M14 as it is printed, to four digits."""
    return EVAL.grid_report(_grid(spark, sf_dir), 4)


@register("contamination_best", f"""WITH {GRID_CTE}
SELECT contamination, n_neighbors, num_outliers, {r6('outlier_rate')} AS outlier_rate,
       {r6('mean_outlier_score')} AS mean_outlier_score, {r6('combined_score')} AS combined_score
FROM grid2 WHERE num_outliers > 0 ORDER BY combined_score DESC, contamination, n_neighbors LIMIT 1""")
def q_contamination_best(spark, sf_dir):
    return round_doubles(EVAL.best_grid_params(_grid(spark, sf_dir))
                         .withColumn("n_neighbors", F.col("n_neighbors").cast("int")))


@register("insider_rate", f"""WITH {S.EV},{S.INSIDERS},{S.DIM},
mat AS ({S.matrix_sql(GAP, RARE, UNUSUAL, ROLE_PEERS_SQL, rounded=False)})
SELECT {r6('avg(CASE WHEN i.user_id IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS insider_rate
FROM mat m LEFT JOIN insiders i ON i.user_id = m.user_id""")
def q_insider_rate(spark, sf_dir):
    rate = L.insider_rate(session_matrix(spark, sf_dir), insider_users(spark, sf_dir))
    return round_doubles(spark.range(1).select(rate.cast("double").alias("insider_rate")))


def fp_stages(spark, sf_dir):
    m, sc = scored_sessions(spark, sf_dir)
    merged = EVAL.with_labels(sc, m, insider_users(spark, sf_dir))
    return EVAL.context_filter(EVAL.score_threshold(merged, 80))


FP_CTE = f"""{DBLOF_CTE},{S.INSIDERS},
merged AS (
  SELECT d.*, m.file_rate, m.device_rate, CASE WHEN i.user_id IS NOT NULL THEN 1 ELSE 0 END AS true_label
  FROM dblof d LEFT JOIN mat m ON m.user_id = d.user_id AND m.session_id = d.session_id
  LEFT JOIN insiders i ON i.user_id = d.user_id),
thr AS (SELECT quantile_cont(anomaly_score, 0.8) AS t FROM merged WHERE is_outlier),
hc AS (SELECT *, is_outlier AND NOT ({S.rk('anomaly_score')} < {S.rk('(SELECT t FROM thr)')})
                 AS high_confidence_outlier FROM merged),
ubase AS (SELECT user_id, avg(file_rate) AS fb, avg(device_rate) AS db FROM hc GROUP BY user_id),
fp AS (
  SELECT hc.*, high_confidence_outlier AND coalesce(file_rate > fb * 3 OR device_rate > db * 2, false)
         AS context_filtered_outlier
  FROM hc JOIN ubase ON ubase.user_id = hc.user_id)"""


@register("fp_stages", f"""WITH {FP_CTE}
SELECT user_id, session_id, is_outlier, {r6('anomaly_score')} AS anomaly_score, true_label,
       high_confidence_outlier, context_filtered_outlier FROM fp""")
def q_fp_stages(spark, sf_dir):
    return round_doubles(fp_stages(spark, sf_dir).select(
        "user_id", "session_id", "is_outlier", "anomaly_score", "true_label",
        "high_confidence_outlier", "context_filtered_outlier"))


def _metrics_sql(stage: str, col: str) -> str:
    prec = "coalesce(tp / nullif(tp + fp, 0), 0.0)"
    rec = "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    return f"""SELECT '{stage}' AS stage, '{col}' AS flag_column, tp, fp, fn, tn,
       {r6('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0.0)')} AS accuracy,
       {r6(prec)} AS precision, {r6(rec)} AS recall,
       {r6(f'coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0.0)')} AS f1_score
FROM (SELECT count(*) FILTER (WHERE {col} AND true_label = 1) AS tp,
             count(*) FILTER (WHERE {col} AND true_label = 0) AS fp,
             count(*) FILTER (WHERE NOT {col} AND true_label = 1) AS fn,
             count(*) FILTER (WHERE NOT {col} AND true_label = 0) AS tn FROM fp)"""


@register("fp_metrics", f"""WITH {FP_CTE}
{_metrics_sql('original', 'is_outlier')}
UNION ALL
{_metrics_sql('final', 'context_filtered_outlier')}""")
def q_fp_metrics(spark, sf_dir):
    return round_doubles(EVAL.before_after(fp_stages(spark, sf_dir)))


@register("top_detected_insiders", f"""WITH {DBLOF_CTE},{S.INSIDERS}
SELECT d.user_id, count(session_id) AS total_sessions,
       CAST(sum(CAST(is_outlier AS INT)) AS BIGINT) AS detected_sessions,
       {r6('max(anomaly_score)')} AS max_anomaly_score,
       {r6('sum(CAST(is_outlier AS INT)) / count(session_id)')} AS detection_rate
FROM dblof d SEMI JOIN insiders i ON i.user_id = d.user_id
GROUP BY d.user_id
ORDER BY sum(CAST(is_outlier AS INT)) / count(session_id) DESC, sum(CAST(is_outlier AS INT)) DESC, d.user_id
LIMIT 10""")
def q_top_detected_insiders(spark, sf_dir):
    return round_doubles(EVAL.top_detected_insiders(dblof(spark, sf_dir), insider_users(spark, sf_dir), 10))


@register("run_summary", f"""WITH {DBLOF_CTE},{S.INSIDERS},
s AS (SELECT d.*, i.user_id IS NOT NULL AS ins FROM dblof d LEFT JOIN insiders i ON i.user_id = d.user_id)
SELECT count(*) AS total_sessions, count(*) FILTER (WHERE is_outlier) AS total_outliers,
       count(*) FILTER (WHERE ins) AS insider_sessions,
       count(*) FILTER (WHERE ins AND is_outlier) AS detected_insider_sessions,
       {r6('count(*) FILTER (WHERE is_outlier) / count(*)')} AS outlier_rate,
       {r6('(count(*) FILTER (WHERE ins AND is_outlier)) / nullif(count(*) FILTER (WHERE ins), 0)')}
         AS insider_detection_rate
FROM s""")
def q_run_summary(spark, sf_dir):
    return round_doubles(EVAL.run_summary(dblof(spark, sf_dir), insider_users(spark, sf_dir)))


# ---------------------------------------------------------------- forests (INV: no oracle)
from vigil.operators import forest as FOREST  # noqa: E402
from vigil.plans import runs as RUNS  # noqa: E402


@register("isolation_forest_flags")
def q_isolation_forest_flags(spark, sf_dir):
    m = _matrix_ckpt(spark, sf_dir)
    return round_doubles(FOREST.isolation_forest_flags(m, contamination=0.10))


def fp_run(spark, sf_dir, **switches):
    """E9 with its switches over one matrix and one set of scores."""
    m, sc = scored_sessions(spark, sf_dir)
    return RUNS.reduce_false_positives(cut_lineage(sc), m, insider_users(spark, sf_dir), **switches)


@register("fp_full_pipeline")
def q_fp_full_pipeline(spark, sf_dir):
    """E9 with all stages.  The final flag is the supervised one alone, as in the reference (D5); what each stage
    before it left, and what it left of that, is reported beside it, and how it does on held-out rows."""
    run = fp_run(spark, sf_dir)
    held_out = run.test_metrics.select(F.lit("held_out").alias("stage"), F.lit("supervised_outlier").alias("flag_column"), "*")
    return round_doubles(run.stages.unionByName(held_out))


@register("fp_improvement", f"""WITH {FP_CTE},
met AS ({_metrics_sql('original', 'is_outlier')} UNION ALL {_metrics_sql('final', 'context_filtered_outlier')}),
wide AS (SELECT a.precision AS p0, b.precision AS p1, a.recall AS r0, b.recall AS r1, a.f1_score AS f0, b.f1_score AS f1
         FROM met a, met b WHERE a.stage = 'original' AND b.stage = 'final')
SELECT 'precision' AS metric, p0 AS original, p1 AS final, {r6('(p1 - p0) * 100.0')} AS improvement_pp FROM wide
UNION ALL SELECT 'recall', r0, r1, {r6('(r1 - r0) * 100.0')} FROM wide
UNION ALL SELECT 'f1_score', f0, f1, {r6('(f1 - f0) * 100.0')} FROM wide""")
def q_fp_improvement(spark, sf_dir):
    """E8 + E9 without the two randomised stages: the difference in percentage points."""
    rows = round_doubles(fp_run(spark, sf_dir, use_ensemble=False, use_supervised=False).metrics)
    return round_doubles(EVAL.improvement(rows))


# ---------------------------------------------------------------- ETL
from vigil.operators import quality as QUAL  # noqa: E402
from vigil.operators.normalize import extract_dates, union_all  # noqa: E402
from vigil.plans import etl as ETL  # noqa: E402
from vigil.plans import sql_etl as SE  # noqa: E402
from vigil.schema import RAW_COLUMNS  # noqa: E402
from vigil.sources.tables import raw_logs  # noqa: E402


def unified_events(spark, sf_dir):
    return ETL.batch_process(raw_logs(spark, sf_dir))


@register("etl_quality_report", SE.ETL_CTE + "\n" + " UNION ALL ".join(
    f"SELECT {SE.QUALITY_COLS} FROM qf_{t}" for t in SE.TYPES))
def q_etl_quality_report(spark, sf_dir):
    return round_doubles(ETL.quality_reports(raw_logs(spark, sf_dir)))


@register("etl_missing_by_column", SE.ETL_CTE + "\n" + " UNION ALL ".join(
    f"SELECT '{t}' AS file_type, '{c}' AS \"column\", count(*) FILTER (WHERE \"{c}\" IS NULL) AS missing_count, "
    f"{S.r6(f'count(*) FILTER (WHERE \"{c}\" IS NULL) * 100.0 / count(*)')} AS missing_pct FROM raw_{t}"
    for t in SE.TYPES for c in RAW_COLUMNS[t]))
def q_etl_missing_by_column(spark, sf_dir):
    raws = raw_logs(spark, sf_dir)
    return round_doubles(union_all([QUAL.missing_by_column(r, t) for t, r in raws.items()]))


@register("etl_unified_events", SE.ETL_CTE + "\nSELECT * REPLACE (" + S.r6("data_quality_score") +
          " AS data_quality_score) FROM unified")
def q_etl_unified_events(spark, sf_dir):
    return round_doubles(unified_events(spark, sf_dir))


@register("etl_type_summary", SE.ETL_CTE + f"""
SELECT source_file, count(*) AS records_processed, count(*) FILTER (WHERE is_valid) AS valid_records,
       {S.r6('avg(data_quality_score)')} AS quality_score FROM unified GROUP BY source_file""")
def q_etl_type_summary(spark, sf_dir):
    return round_doubles(QUAL.type_summary(unified_events(spark, sf_dir)))


@register("etl_dataset_summary", SE.ETL_CTE + f"""
SELECT count(*) AS total_records, count(*) FILTER (WHERE is_valid) AS valid_records,
       {S.r6('avg(data_quality_score)')} AS avg_quality_score,
       {S.r6('count("timestamp") * 100.0 / count(*)')} AS timestamp_coverage_pct,
       count(DISTINCT user_id) AS unique_users, count(DISTINCT pc_id) AS unique_pcs,
       min("timestamp") AS date_start, max("timestamp") AS date_end FROM unified""")
def q_etl_dataset_summary(spark, sf_dir):
    return round_doubles(QUAL.dataset_summary(unified_events(spark, sf_dir)))


@register("etl_session_stats", SE.ETL_CTE + """
SELECT session_id, count(*) AS event_count,
       array_to_string(list_sort(list_distinct(list(activity_type))), ',') AS activity_types,
       min("timestamp") AS session_start, max("timestamp") AS session_end FROM unified GROUP BY session_id""")
def q_etl_session_stats(spark, sf_dir):
    return QUAL.etl_session_stats(unified_events(spark, sf_dir))


@register("user_activity_pivot", SE.ETL_CTE + "\nSELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE activity_type = '{t}') AS {t}" for t in ["logon", "file", "email", "device", "http"])
    + " FROM unified GROUP BY user_id")
def q_user_activity_pivot(spark, sf_dir):
    return QUAL.user_activity_pivot(unified_events(spark, sf_dir))


@register("activity_distribution", SE.ETL_CTE + """
SELECT activity_type, count(*) AS "count" FROM unified GROUP BY activity_type""")
def q_activity_distribution(spark, sf_dir):
    return QUAL.activity_distribution(unified_events(spark, sf_dir))


@register("dataset_description", SE.ETL_CTE + f"""
SELECT count(*) AS total_records, 24 AS n_columns, min("timestamp") AS date_start, max("timestamp") AS date_end,
       {S.r6('avg(data_quality_score)')} AS avg_quality_score,
       {S.r6('count(*) FILTER (WHERE is_valid) * 100.0 / count(*)')} AS valid_records_pct, """ + ", ".join(
    f"count(*) FILTER (WHERE activity_type = '{t}') AS {t}_records" for t in ["logon", "file", "email", "device", "http"])
    + " FROM unified")
def q_dataset_description(spark, sf_dir):
    return round_doubles(QUAL.dataset_description(unified_events(spark, sf_dir)))


@register("etl_forward_fill", SE.ETL_CTE + """,
gaps AS (SELECT event_id, user_id, "timestamp", CASE WHEN activity_type IN ('http', 'file') THEN NULL ELSE pc_id END AS pc_id,
                CASE WHEN activity_type = 'logon' THEN activity_subtype END AS activity_subtype FROM unified)
SELECT event_id, user_id, "timestamp",
       last_value(pc_id IGNORE NULLS) OVER w AS pc_id, last_value(activity_subtype IGNORE NULLS) OVER w AS activity_subtype
FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_etl_forward_fill(spark, sf_dir):
    """Q8: the machine and the last logon kind of a user, carried to the events that do not say."""
    kind = F.col("activity_type")
    gaps = unified_events(spark, sf_dir).select(
        "event_id", "user_id", "timestamp", F.when(~kind.isin("http", "file"), F.col("pc_id")).alias("pc_id"),
        F.when(kind == "logon", F.col("activity_subtype")).alias("activity_subtype"))
    return QUAL.forward_fill(gaps, ["pc_id", "activity_subtype"], "user_id")


def _dates_sql(table: str, key: str, text: str) -> str:
    return rf"""
WITH m AS (SELECT {key}, list_concat(regexp_extract_all({text}, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}'),
                                   regexp_extract_all({text}, '\d{{4}}-\d{{2}}-\d{{2}}'),
                                   regexp_extract_all({text}, '\d{{2}}:\d{{2}}:\d{{2}}')) AS found FROM {table}),
d AS (SELECT {key}, unnest(range(1, len(found) + 1)) AS position, unnest(found) AS one FROM m)
SELECT {key}, position,
       CAST(date_diff('microsecond', TIMESTAMP '1970-01-01', coalesce(try_strptime(one, '%Y-%m-%d %H:%M:%S'),
            try_strptime(one, '%Y-%m-%d'))) AS DOUBLE) / 1e6 AS epoch
FROM d"""


def _dates(df, key: str, text):
    """One row per date found, by its position in the text's list of dates."""
    found = df.select(key, F.posexplode(extract_dates(text)).alias("at", "epoch"))
    return found.select(key, (F.col("at") + 1).cast("bigint").alias("position"), "epoch")


def _raw_dates_sql() -> str:
    body = " UNION ALL ".join(f"SELECT id, date || ' / ' || date AS text FROM raw_{t}" for t in SE.TYPES)
    return f"WITH {SE.RAW}, texts AS ({body}) SELECT id, position, epoch FROM ({_dates_sql('texts', 'id', 'text')})"


@register("raw_log_dates", _raw_dates_sql())
def q_raw_log_dates(spark, sf_dir):
    """N11 over the date texts of all five raw logs: seven layouts and one without a date, twice in each text."""
    texts = union_all([r.select("id", F.concat_ws(" / ", "date", "date").alias("text")) for r in raw_logs(spark, sf_dir).values()])
    return _dates(texts, "id", F.col("text"))


@register("text_dates", _dates_sql("events", "event_id", "CAST(ts AS VARCHAR)"))
def q_text_dates(spark, sf_dir):
    return _dates(read_table(spark, sf_dir, "events"), "event_id", F.col("ts").cast("string"))


# ---------------------------------------------------------------- graph
from vigil.operators import graph as G  # noqa: E402
from vigil.operators import context as C  # noqa: E402

ETL_BODY = SE.ETL_CTE[len("WITH "):]


def processed_events(spark, sf_dir):
    """Unified events written once to the checkpoint folder (the processed
    event table downstream jobs read), so multi-branch plans do not re-run
    the ETL per branch."""
    return cut_lineage(unified_events(spark, sf_dir))


def threat_graph(spark, sf_dir, events=None):
    ev = events if events is not None else processed_events(spark, sf_dir)
    hr = user_dimension(spark, sf_dir)
    users, assets, hrs = G.user_vertices(ev), G.asset_vertices(ev), G.hr_vertices(hr)
    edges = G.simple_edges(G.relations(ev, hr))
    return users, assets, hrs, edges, G.vertices(users, assets, hrs, edges)


GRAPH_SQL = f"""{ETL_BODY},{S.DIM},
uv AS (SELECT user_id AS entity_id, 'user' AS entity_type, CAST(0.0 AS DOUBLE) AS risk_score, count(*) AS activity_count
       FROM unified GROUP BY user_id),
av AS (SELECT DISTINCT pc_id AS entity_id, 'asset' AS entity_type, CAST(0.0 AS DOUBLE) AS risk_score FROM unified),
hv AS (SELECT 'hr_' || user_id AS entity_id, 'hr_record' AS entity_type, CAST(0.0 AS DOUBLE) AS risk_score FROM dim),
rel AS (SELECT user_id AS src, pc_id AS dst FROM unified
        UNION ALL SELECT user_id AS src, 'hr_' || user_id AS dst FROM dim),
edges AS (SELECT src, dst, count(*) AS relation_count,
                 CASE WHEN max(CASE WHEN dst LIKE 'hr_%' THEN 1 ELSE 0 END) = 1 THEN 'has_hr_record' ELSE 'uses_pc' END
                   AS relation_type FROM rel GROUP BY src, dst),
v0 AS (SELECT entity_id, entity_type, risk_score FROM uv UNION ALL SELECT * FROM av UNION ALL SELECT * FROM hv),
verts AS (SELECT * FROM v0 UNION ALL
          SELECT e AS entity_id, 'unknown' AS entity_type, CAST(0.0 AS DOUBLE) AS risk_score
          FROM (SELECT src AS e FROM edges UNION SELECT dst FROM edges) WHERE e NOT IN (SELECT entity_id FROM v0)),
nb AS (SELECT e.src, e.dst, coalesce(v.entity_type, 'unknown') AS entity_type, coalesce(v.risk_score, CAST(0.0 AS DOUBLE)) AS risk_score
       FROM edges e LEFT JOIN verts v ON v.entity_id = e.dst),
cdp AS (
  SELECT src AS user_id, count(DISTINCT entity_type) AS pattern_count,
         array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS entity_types,
         array_to_string(list_sort(list(dst ORDER BY dst)[1:{G.NEIGHBOUR_LIST}]), ',') AS connected_entities,
         least(1.0, round_even(avg(risk_score) + 0.05 * count(*) +
               CASE WHEN count(DISTINCT entity_type) >= 3 THEN 0.3 WHEN count(DISTINCT entity_type) = 2 THEN 0.1
                    ELSE 0.0 END, 3)) AS overall_risk_score
  FROM nb GROUP BY src)"""


@register("graph_vertices", f"WITH {GRAPH_SQL}\nSELECT entity_id, entity_type, risk_score FROM verts")
def q_graph_vertices(spark, sf_dir):
    return threat_graph(spark, sf_dir)[4]


@register("graph_edges", f"WITH {GRAPH_SQL}\nSELECT src, dst, relation_type, CAST(1.0 AS DOUBLE) AS weight, "
                         f"CAST(0.0 AS DOUBLE) AS anomaly_score, relation_count FROM edges")
def q_graph_edges(spark, sf_dir):
    return threat_graph(spark, sf_dir)[3]


@register("graph_entity_features", f"""WITH {GRAPH_SQL},
od AS (SELECT src AS entity_id, count(*) AS o FROM edges GROUP BY src),
idg AS (SELECT dst AS entity_id, count(*) AS i FROM edges GROUP BY dst)
SELECT v.entity_id, v.entity_type,
       CASE v.entity_type
         WHEN 'user' THEN [coalesce(u.activity_count, 0) / 1000.0, 0.0, v.risk_score, coalesce(o, 0) / 100.0]
         WHEN 'system' THEN [coalesce(i, 0) / 100.0, 0.0, 0.0, 0.0]
         WHEN 'asset' THEN [coalesce(i, 0) / 50.0, 0.5, 0.0, 0.0]
         WHEN 'hr_record' THEN [0.0, 0.0, v.risk_score, 0.0]
         ELSE [0.0, 0.0, 0.0, 0.0] END AS features
FROM verts v LEFT JOIN uv u ON u.entity_id = v.entity_id LEFT JOIN od ON od.entity_id = v.entity_id
LEFT JOIN idg ON idg.entity_id = v.entity_id""")
def q_graph_entity_features(spark, sf_dir):
    users, _, hrs, edges, verts = threat_graph(spark, sf_dir)
    return G.entity_features(verts, users, edges, hrs)


@register("graph_entity_features_hr", f"""WITH {GRAPH_SQL}
SELECT 'hr_' || user_id AS entity_id, 'hr_record' AS entity_type,
       [CAST(length(user_id) AS DOUBLE) / 10.0, CASE WHEN manager_level THEN 0.25 ELSE 0.0 END, 0.0, 0.0] AS features FROM dim""")
def q_graph_entity_features_hr(spark, sf_dir):
    """G6 for HR records that carry conflicts and a termination risk (here drawn from the user dimension)."""
    hr = user_dimension(spark, sf_dir).withColumns({"conflicts": F.length("user_id"), "termination_risk": F.when(F.col("manager_level"), 0.25)})
    ev = processed_events(spark, sf_dir)
    users, assets, hrs = G.user_vertices(ev), G.asset_vertices(ev), G.hr_vertices(hr)
    edges = G.simple_edges(G.relations(ev, hr))
    return G.entity_features(G.vertices(users, assets, hrs, edges), users, edges, hrs).where(F.col("entity_type") == "hr_record")


@register("cross_domain_patterns", f"WITH {GRAPH_SQL}\nSELECT * FROM cdp")
def q_cross_domain_patterns(spark, sf_dir):
    *_, edges, verts = threat_graph(spark, sf_dir)
    p = G.cross_domain_patterns(verts, edges)
    return p.select("user_id", "pattern_count", F.array_join("entity_types", ",").alias("entity_types"),
                    F.array_join("connected_entities", ",").alias("connected_entities"), "overall_risk_score")


@register("user_threat_patterns", f"""WITH {GRAPH_SQL},
asked AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events UNION SELECT 'nobody_' || CAST(c_custkey AS VARCHAR) FROM customer),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM nb),
listed AS (SELECT src, string_agg(dst || ':' || entity_type || ':' || CAST(risk_score AS VARCHAR), ',' ORDER BY dst) AS connected
           FROM near WHERE place <= {G.NEIGHBOUR_LIST} GROUP BY src)
SELECT a.user_id, coalesce(pattern_count, 0) AS pattern_count, coalesce(overall_risk_score, 0.0) AS overall_risk_score,
       coalesce(connected, '') AS connected
FROM asked a LEFT JOIN cdp ON cdp.user_id = a.user_id LEFT JOIN listed ON listed.src = a.user_id""")
def q_user_threat_patterns(spark, sf_dir):
    """G7 with each neighbour's type and risk; users that are not in the graph have none."""
    *_, edges, verts = threat_graph(spark, sf_dir)
    asked = (activity_events(spark, sf_dir).select("user_id").distinct()
             .unionByName(read_table(spark, sf_dir, "customer").select(F.concat(F.lit("nobody_"), F.col("c_custkey").cast("string")).alias("user_id"))))
    p = G.patterns_of(asked, G.cross_domain_patterns(verts, edges))
    one = F.transform("connected", lambda x: F.concat_ws(":", x["entity_id"], x["entity_type"], x["risk_score"].cast("string")))
    return p.select("user_id", "pattern_count", "overall_risk_score", F.array_join(one, ",").alias("connected"))


# ---------------------------------------------------------------- context
from vigil.operators.knn import knn_query  # noqa: E402


@register("user_context", f"""WITH {S.EV},{S.DIM}
SELECT u.user_id, coalesce(d.role, 'unknown') AS role, coalesce(d.department, 'unknown') AS department,
       coalesce(d.project, 'unknown') AS project,
       CASE WHEN d.manager_level THEN 'manager' ELSE 'employee' END AS access_level
FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN dim d ON d.user_id = u.user_id""")
def q_user_context(spark, sf_dir):
    users = activity_events(spark, sf_dir).select("user_id").distinct()
    return C.user_context(users, user_dimension(spark, sf_dir))


def intent_report(spark, sf_dir, scored=None):
    m, sc = scored or scored_sessions(spark, sf_dir)
    flagged = (sc.where(F.col("is_outlier")).select("user_id", "session_id")
                 .join(m.select("user_id", "session_id", "session_start"), ["user_id", "session_id"], "left"))
    ctx = C.user_context(flagged, user_dimension(spark, sf_dir))
    keep = ["event_id", "timestamp", "user_id", "activity_subtype", "email_content", "file_name", "file_tree",
            "logon_activity", "http_content", "url", "device_activity"]
    events = processed_events(spark, sf_dir)
    ev = events.select(*keep)
    matched = C.nearest_event(ctx, ev)
    acts = (matched.withColumn("action", C.infer_action())
                   .withColumn("timestamp", F.col("session_start"))
                   .withColumn("time_of_day", F.when(F.col("session_start").isNull(), None)
                               .otherwise(F.hour("session_start").cast("string")))
                   .withColumn("justification", F.lit(None).cast("string")))
    sc2 = C.rule_scores(acts, C.role_permissions_table(spark), C.temporal_rules_table(spark),
                        C.project_lifecycles_table(spark))
    sc2 = sc2.withColumn("intent_score", C.intent_score())
    label, risk = C.intent_label(F.col("intent_score"))
    sc2 = sc2.withColumn("intent_label", label).withColumn("risk_level", risk) \
             .withColumn("reasoning", C.reasoning()) \
             .withColumn("activity_text", C.activity_text(with_justification=False))
    *_, edges, verts = threat_graph(spark, sf_dir, events)
    risk_g = G.cross_domain_patterns(verts, edges).select("user_id", F.col("overall_risk_score").alias("graph_risk_score"))
    out = sc2.join(risk_g, "user_id", "left")
    return out.select("user_id", "session_id", "action", "role", "project", "role_score", "time_score",
                      "project_score", "intent_score", "intent_label", "risk_level", "reasoning",
                      "activity_text", F.coalesce("graph_risk_score", F.lit(0.0)).alias("graph_risk_score"))


def _rules_sql():
    rp = ", ".join(f"('{r}', [{', '.join(repr(a) for a in acts)}]::VARCHAR[])" for r, acts in C.ROLE_PERMISSIONS.items())
    tr = ", ".join(f"('{r}', {s}, {e})" for r, (s, e) in C.TEMPORAL_RULES.items())
    pl = ", ".join(f"('{p}', '{st}', [{', '.join(repr(a) for a in acts)}]::VARCHAR[])"
                   for p, (st, acts) in C.PROJECT_LIFECYCLES.items())
    return f"""rp AS (SELECT * FROM (VALUES {rp}) t(role, allowed)),
tr AS (SELECT * FROM (VALUES {tr}) t(role, start_hour, end_hour)),
pl AS (SELECT * FROM (VALUES {pl}) t(project, stage, expected))"""


def _truthy(c):
    return f"({c} IS NOT NULL AND {c} <> '')"


INFER_SQL = f"""CASE
  WHEN coalesce(contains(lower(activity_subtype), 'email'), false) OR {_truthy('email_content')} THEN 'email_send'
  WHEN {_truthy('file_name')} OR {_truthy('file_tree')} THEN 'file_access'
  WHEN {_truthy('logon_activity')} AND contains(lower(logon_activity), 'login') THEN 'logon'
  WHEN {_truthy('logon_activity')} AND contains(lower(logon_activity), 'logout') THEN 'logout'
  WHEN ({_truthy('http_content')} OR {_truthy('url')}) AND (coalesce(contains(lower(http_content), 'query'), false)
        OR coalesce(contains(lower(url), 'query'), false)) THEN 'database_query'
  WHEN {_truthy('device_activity')} AND contains(lower(device_activity), 'removable') THEN 'device_use'
  WHEN {_truthy('device_activity')} AND contains(lower(device_activity), 'insert') THEN 'device_insert'
  ELSE 'unknown' END"""


INTENT_SQL = f"""WITH {ETL_BODY},{S.DIM},{DBLOF_CTE},{GRAPH_SQL[GRAPH_SQL.index('uv AS'):]},{_rules_sql()},
flag AS (SELECT d.user_id, d.session_id, m.session_start FROM dblof d
         JOIN mat m ON m.user_id = d.user_id AND m.session_id = d.session_id WHERE d.is_outlier),
ctx AS (SELECT f.*, coalesce(dm.role, 'unknown') AS role, coalesce(dm.project, 'unknown') AS project
        FROM flag f LEFT JOIN dim dm ON dm.user_id = f.user_id),
cand AS (SELECT c.user_id, c.session_id, u.event_id, u."timestamp", u.activity_subtype, u.email_content, u.file_name,
                u.file_tree, u.logon_activity, u.http_content, u.url, u.device_activity
         FROM ctx c JOIN unified u ON u.user_id = c.user_id
              AND u."timestamp" >= c.session_start - INTERVAL 10 MINUTE
              AND u."timestamp" <= c.session_start + INTERVAL 10 MINUTE),
firstev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY "timestamp", event_id) rn
                           FROM cand) WHERE rn = 1),
acts AS (SELECT c.*, CASE WHEN fe.user_id IS NULL THEN 'unknown' ELSE {INFER_SQL.replace('activity_subtype', 'fe.activity_subtype').replace(' email_content', ' fe.email_content').replace('(email_content', '(fe.email_content')} END AS action
         FROM ctx c LEFT JOIN firstev fe ON fe.user_id = c.user_id AND fe.session_id = c.session_id),
sc AS (
  SELECT a.*,
    CASE WHEN rp.allowed IS NULL THEN 0.5 WHEN list_contains(rp.allowed, a.action) THEN 1.0
         WHEN len(list_filter(rp.allowed, lambda x: contains(a.action, x))) > 0 THEN 0.7 ELSE 0.2 END AS role_score,
    CASE WHEN tr.start_hour IS NULL OR a.session_start IS NULL THEN 0.8
         WHEN hour(a.session_start) >= tr.start_hour AND hour(a.session_start) <= tr.end_hour
              AND isodow(a.session_start) - 1 < 5 THEN 1.0
         WHEN isodow(a.session_start) - 1 < 5 THEN 0.5 ELSE 0.3 END AS time_score,
    CASE WHEN pl.stage IS NULL THEN 0.7 WHEN list_contains(pl.expected, a.action) THEN 1.0
         WHEN pl.stage = 'completed' AND contains(a.action, 'access') THEN 0.4 ELSE 0.6 END AS project_score
  FROM acts a LEFT JOIN rp ON rp.role = a.role LEFT JOIN tr ON tr.role = a.role LEFT JOIN pl ON pl.project = a.project),
sc2 AS (SELECT *, least(greatest(CAST(role_score AS DOUBLE) * 0.4 + CAST(time_score AS DOUBLE) * 0.3
                                 + CAST(project_score AS DOUBLE) * 0.3, 0.0), 1.0) AS intent_score FROM sc)
SELECT s.user_id, session_id, action, role, project, CAST(role_score AS DOUBLE) AS role_score,
       CAST(time_score AS DOUBLE) AS time_score, CAST(project_score AS DOUBLE) AS project_score,
       {S.r6('intent_score')} AS intent_score,
       CASE WHEN intent_score >= 0.7 THEN 'benign' WHEN intent_score >= 0.4 THEN 'suspicious' ELSE 'malicious' END AS intent_label,
       CASE WHEN intent_score >= 0.7 THEN 'low' WHEN intent_score >= 0.4 THEN 'medium' ELSE 'high' END AS risk_level,
       concat_ws('. ',
         CASE WHEN role_score < 0.5 THEN 'Action ''' || action || ''' is NOT typically permitted for role ''' || role || ''''
              WHEN role_score >= 0.8 THEN 'Action aligns with expected permissions for role ''' || role || '''' END,
         CASE WHEN time_score < 0.5 THEN 'Activity occurred at ' || strftime(session_start, '%H:%M on %A')
              || ', outside typical business hours' END,
         CASE WHEN project_score < 0.5 THEN 'Action unusual for project ''' || project || ''' current lifecycle stage' END,
         'Overall assessment: Activity ' || CASE WHEN intent_score >= 0.7 THEN 'appears BENIGN and contextually justified'
              WHEN intent_score >= 0.4 THEN 'appears SUSPICIOUS and warrants review'
              ELSE 'appears MALICIOUS with high risk indicators' END) || '.' AS reasoning,
       'User role: ' || role || '. Action: ' || action || '. Time: ' || coalesce(CAST(hour(session_start) AS VARCHAR), 'business_hours')
         || '. Project: ' || project || '.' AS activity_text,
       coalesce(cdp.overall_risk_score, 0.0) AS graph_risk_score
FROM sc2 s LEFT JOIN cdp ON cdp.user_id = s.user_id"""


@register("intent_report", INTENT_SQL)
def q_intent_report(spark, sf_dir):
    return round_doubles(intent_report(spark, sf_dir))


RETRIEVAL_K = 5


@register("knowledge_retrieval", f"""WITH {S.EMB_PTS},
pairs AS (SELECT a.id, b.id AS nbr, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON true),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {S.rk('dist')}, nbr) AS rnk FROM pairs)
        WHERE rnk <= {RETRIEVAL_K}),
kb AS (SELECT CAST(vec_id AS VARCHAR) AS nbr, CASE WHEN label = 0 THEN 'malicious' ELSE 'benign' END AS outcome
       FROM embeddings)
SELECT k.id, k.nbr, CAST(k.rnk AS INTEGER) AS "rank", {S.r6('k.dist * k.dist')} AS sq_distance,
       {S.r6('1.0 / (1.0 + k.dist * k.dist)')} AS similarity, kb.outcome
FROM knn k JOIN kb ON kb.nbr = k.nbr""")
def q_knowledge_retrieval(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    pts = to_vectors(emb, "vec_id", vector_col="embedding")
    n = knn_query(pts, pts, RETRIEVAL_K)
    kb = emb.select(F.col("vec_id").cast("string").alias("nbr"),
                    F.when(F.col("label") == 0, "malicious").otherwise("benign").alias("outcome"))
    return round_doubles(n.join(kb, "nbr").select(
        "id", "nbr", "rank", (F.col("dist") * F.col("dist")).alias("sq_distance"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("dist") * F.col("dist"))).alias("similarity"), "outcome"))


@register("knowledge_history", f"""WITH {S.EMB_PTS},
pairs AS (SELECT a.id, b.id AS nbr, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON true),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {S.rk('dist')}, nbr) AS rnk FROM pairs)
        WHERE rnk <= {RETRIEVAL_K}),
kb AS (SELECT CAST(vec_id AS VARCHAR) AS nbr, CASE WHEN label = 0 THEN 'malicious' ELSE 'benign' END AS outcome
       FROM embeddings)
SELECT k.id, {S.r6("sum((1.0 / (1.0 + k.dist * k.dist)) * CASE WHEN outcome = 'benign' THEN 1.0 ELSE 0.0 END) / sum(1.0 / (1.0 + k.dist * k.dist))")} AS history_score,
       CAST(sum(CASE WHEN outcome = 'benign' THEN 1 ELSE 0 END) AS BIGINT) AS benign_count, count(*) AS neighbour_count
FROM knn k JOIN kb ON kb.nbr = k.nbr GROUP BY k.id""")
def q_knowledge_history(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    pts = to_vectors(emb, "vec_id", vector_col="embedding")
    n = knn_query(pts, pts, RETRIEVAL_K)
    kb = emb.select(F.col("vec_id").cast("string").alias("nbr"),
                    F.when(F.col("label") == 0, "malicious").otherwise("benign").alias("outcome"))
    return round_doubles(C.history_share(n.select("id", "nbr", "dist"), kb))


SPLIT_PTS = """pts AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
knn AS (SELECT * FROM (
  SELECT a.id, b.id AS nbr, b.label, list_distance(a.v, b.v) AS dist,
         row_number() OVER (PARTITION BY a.id ORDER BY {key}, b.id) AS rnk
  FROM pts a JOIN pts b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE rnk <= {k})""".format(key=S.rk("list_distance(a.v, b.v)"), k=RETRIEVAL_K)


def _past_and_new(spark, sf_dir):
    """The odd rows as past activities with an outcome, and each even row's nearest ones among them."""
    emb = read_table(spark, sf_dir, "embeddings")
    pts = to_vectors(emb, "vec_id", vector_col="embedding")
    past = emb.where(F.pmod("vec_id", F.lit(2)) == 1).select(
        F.col("vec_id").cast("string").alias("nbr"), F.when(F.col("label") == 0, "malicious").otherwise("benign").alias("outcome"))
    number = F.pmod(F.col("id").cast("long"), F.lit(2))
    return emb, past, knn_query(pts.where(number == 0), pts.where(number == 1), RETRIEVAL_K)


@register("knowledge_retrieval_past", f"""WITH {SPLIT_PTS}
SELECT id, nbr, CAST(rnk AS INTEGER) AS "rank", {S.r6('dist * dist')} AS sq_distance, {S.r6('1.0 / (1.0 + dist * dist)')} AS similarity,
       CASE WHEN label = 0 THEN 'malicious' ELSE 'benign' END AS outcome FROM knn""")
def q_knowledge_retrieval_past(spark, sf_dir):
    """C2 of new activities against a knowledge base that does not hold them."""
    _, past, n = _past_and_new(spark, sf_dir)
    sq = F.col("dist") * F.col("dist")
    return round_doubles(n.join(past, "nbr").select("id", "nbr", "rank", sq.alias("sq_distance"), (F.lit(1.0) / (F.lit(1.0) + sq)).alias("similarity"), "outcome"))


_HIST_ROLES, _HIST_ACTIONS = list(C.ROLE_PERMISSIONS), ["file_access", "run_report", "email_send", "data_export", "logon"]


@register("intent_with_history", f"""WITH {SPLIT_PTS}, {_rules_sql()},
hist AS (SELECT id, sum((1.0 / (1.0 + dist * dist)) * CASE WHEN label = 0 THEN 0.0 ELSE 1.0 END) / sum(1.0 / (1.0 + dist * dist)) AS share,
                sum(CASE WHEN label = 0 THEN 0 ELSE 1 END) AS benign, count(*) AS n FROM knn GROUP BY id),
act AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, {_HIST_ROLES!r}[vec_id // 2 % 4 + 1] AS role, {_HIST_ACTIONS!r}[vec_id // 2 % 5 + 1] AS action
        FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 = 0),
sc AS (
  SELECT a.id, a.role, a.action, CASE WHEN list_contains(rp.allowed, a.action) THEN 1.0
              WHEN len(list_filter(rp.allowed, lambda x: contains(a.action, x))) > 0 THEN 0.7 ELSE 0.2 END AS role_score,
         CAST(h.share AS DOUBLE) AS share, h.benign, h.n
  FROM act a JOIN rp ON rp.role = a.role LEFT JOIN hist h ON h.id = a.id),
s2 AS (SELECT *, least(greatest(CASE WHEN share IS NULL THEN 0.4 * role_score + 0.3 * 0.8 + 0.3 * 0.7
                                     ELSE (0.4 * role_score + 0.3 * 0.8 + 0.3 * 0.7) * 0.7 + share * 0.3 END, 0.0), 1.0) AS s FROM sc)
SELECT id, {S.r6('share')} AS history_score, {S.r6('s')} AS intent_score,
       CASE WHEN s >= 0.7 THEN 'benign' WHEN s >= 0.4 THEN 'suspicious' ELSE 'malicious' END AS intent_label,
       concat_ws('. ', CASE WHEN role_score < 0.5 THEN 'Action ''' || action || ''' is NOT typically permitted for role ''' || role || ''''
              WHEN role_score >= 0.8 THEN 'Action aligns with expected permissions for role ''' || role || '''' END,
         CASE WHEN n > 0 THEN 'Similar activities in history: ' || benign || '/' || n || ' were benign' END,
         'Overall assessment: Activity ' || CASE WHEN s >= 0.7 THEN 'appears BENIGN and contextually justified'
              WHEN s >= 0.4 THEN 'appears SUSPICIOUS and warrants review' ELSE 'appears MALICIOUS with high risk indicators' END) || '.' AS reasoning
FROM s2""")
def q_intent_with_history(spark, sf_dir):
    """Rule scores and the outcomes of similar past activities, with the sentence that tells both.

    Role and action of an activity stand in by its number; some odd rows are asked too, and have no history."""
    emb, past, n = _past_and_new(spark, sf_dir)
    turn = F.floor(F.col("vec_id") / 2)
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(turn, F.lit(len(names))) + 1).cast("int"))
    acts = emb.where((F.pmod("vec_id", F.lit(2)) == 0) | (F.pmod("vec_id", F.lit(5)) == 0)).select(
        F.col("vec_id").cast("string").alias("id"), pick(_HIST_ROLES).alias("role"), pick(_HIST_ACTIONS).alias("action"),
        F.lit(None).cast("string").alias("project"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    acts = acts.join(C.history_share(n.select("id", "nbr", "dist"), past), "id", "left")
    sc = C.rule_scores(acts, C.role_permissions_table(spark), C.temporal_rules_table(spark), C.project_lifecycles_table(spark))
    sc = sc.withColumn("intent_score", C.intent_score(F.col("history_score")))
    return round_doubles(sc.select("id", "history_score", "intent_score", C.intent_label(F.col("intent_score"))[0].alias("intent_label"),
                                   C.reasoning(benign_col="benign_count", n_col="neighbour_count").alias("reasoning")))


# ---------------------------------------------------------------- baselines
from vigil.operators import baseline as BL  # noqa: E402

BASE_W = BL.DEFAULT_WINDOW
MF = S.MATRIX_FEATURES


def _q(c):
    return f'"{c}"'


MAT_CTE = f"mat AS ({S.matrix_sql(GAP, RARE, UNUSUAL, ROLE_PEERS_SQL, rounded=False)})"
STATS_CTE = "gstats AS (SELECT " + ", ".join(
    f"stddev_samp(CAST({_q(c)} AS DOUBLE)) AS {_q('sd_' + c)}" for c in MF) + " FROM mat)"
WIN_CTE = f"""win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY session_start DESC NULLS LAST, session_id DESC) AS recency FROM mat) WHERE recency <= {BASE_W})"""
DECAY_CTE = "dec AS (SELECT user_id, count(*) AS window_size, " + ", ".join(
    f"sum(coalesce(CAST({_q(c)} AS DOUBLE), 0.0) * pow(0.95, recency - 1)) / sum(pow(0.95, recency - 1)) AS {_q(c)}"
    for c in MF) + " FROM win GROUP BY user_id)"
PROF_CTE = "prof AS (SELECT user_id, count(*) AS activity_count, " + ", ".join(
    f"avg(CAST({_q(c)} AS DOUBLE)) AS {_q(c)}" for c in MF) + " FROM mat GROUP BY user_id)"


@register("baseline_global_stats", f"WITH {MAT_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.r6(f'avg(CAST({_q(c)} AS DOUBLE))')} AS mean, "
    f"{S.r6(f'stddev_samp(CAST({_q(c)} AS DOUBLE))')} AS std, {S.r6(f'min(CAST({_q(c)} AS DOUBLE))')} AS min, "
    f"{S.r6(f'max(CAST({_q(c)} AS DOUBLE))')} AS max FROM mat" for c in MF))
def q_baseline_global_stats(spark, sf_dir):
    m = session_matrix(spark, sf_dir)
    return round_doubles(BL.global_stats(m, BL.feature_columns(m)))


@register("baseline_user_profiles", f"WITH {MAT_CTE}, {PROF_CTE}\nSELECT user_id, activity_count, " +
          ", ".join(f"{S.r6(_q(c))} AS {_q(c)}" for c in MF) + " FROM prof")
def q_baseline_user_profiles(spark, sf_dir):
    m = session_matrix(spark, sf_dir)
    return round_doubles(BL.user_profiles(m, BL.feature_columns(m)))


@register("baseline_window", f"WITH {MAT_CTE}, {WIN_CTE}\nSELECT user_id, session_id, CAST(recency AS INTEGER) AS recency FROM win")
def q_baseline_window(spark, sf_dir):
    m = session_matrix(spark, sf_dir)
    return BL.last_w(m, BASE_W).select("user_id", "session_id", F.col("recency").cast("int"))


@register("decayed_baselines", f"WITH {MAT_CTE}, {WIN_CTE}, {DECAY_CTE}\nSELECT user_id, window_size, " +
          ", ".join(f"{S.r6(_q(c))} AS {_q(c)}" for c in MF) + " FROM dec")
def q_decayed_baselines(spark, sf_dir):
    m = session_matrix(spark, sf_dir)
    return round_doubles(BL.decayed_baseline(BL.last_w(m, BASE_W), BL.feature_columns(m)))


def _score_sql():
    parts, used = [], []
    for c in MF:
        ok = f"(s.{_q(c)} IS NOT NULL AND p.{_q(c)} IS NOT NULL AND g.{_q('sd_' + c)} > 0)"
        z = f"abs(s.{_q(c)} - p.{_q(c)}) / g.{_q('sd_' + c)}"
        parts.append(f"CASE WHEN {ok} THEN 1.0 / (1.0 + exp(-({z}) + 2.0)) ELSE 0.0 END")
        used.append(f"CASE WHEN {ok} THEN 1 ELSE 0 END")
    return " + ".join(parts), " + ".join(used)


_SP, _SU = _score_sql()


@register("session_baseline_scores", f"""WITH {MAT_CTE}, {PROF_CTE}, {STATS_CTE}
SELECT s.user_id, s.session_id,
       {S.r6(f"CASE WHEN p.user_id IS NULL OR ({_SU}) = 0 THEN 0.5 ELSE ({_SP}) / ({_SU}) END")} AS baseline_anomaly_score
FROM mat s LEFT JOIN prof p ON p.user_id = s.user_id CROSS JOIN gstats g""")
def q_session_baseline_scores(spark, sf_dir):
    m = _matrix_ckpt(spark, sf_dir)
    feats = BL.feature_columns(m)
    return round_doubles(BL.anomaly_scores(m, BL.user_profiles(m, feats), BL.global_stats(m, feats), feats))


def _drift_sql():
    hits, tot = [], []
    for c in MF:
        ok = f"(l.{_q(c)} IS NOT NULL AND d.{_q(c)} IS NOT NULL)"
        tot.append(f"CASE WHEN {ok} THEN 1 ELSE 0 END")
        hits.append(f"CASE WHEN {ok} AND g.{_q('sd_' + c)} > 0 AND abs(l.{_q(c)} - d.{_q(c)}) / g.{_q('sd_' + c)} > 3.0 "
                    f"THEN 1 ELSE 0 END")
    return " + ".join(hits), " + ".join(tot)


_DH, _DT = _drift_sql()
DRIFT_CTE = f"""{MAT_CTE}, {WIN_CTE}, {DECAY_CTE}, {STATS_CTE},
drift AS (
  SELECT l.user_id, ({_DH}) AS significant_deviations, ({_DT}) AS total_features
  FROM (SELECT * FROM win WHERE recency = 1) l JOIN dec d ON d.user_id = l.user_id CROSS JOIN gstats g)"""


def drift(spark, sf_dir):
    m = _matrix_ckpt(spark, sf_dir)
    feats = BL.feature_columns(m)
    win = BL.last_w(m, BASE_W)
    latest = win.where(F.col("recency") == 1)
    return BL.drift_flags(latest, BL.decayed_baseline(win, feats), BL.global_stats(m, feats), feats)


@register("drift_flags", f"""WITH {DRIFT_CTE}
SELECT user_id, significant_deviations, total_features,
       {S.r6('significant_deviations / total_features')} AS drift_ratio,
       coalesce(significant_deviations / total_features > 0.3, false) AS drift_detected FROM drift""")
def q_drift_flags(spark, sf_dir):
    return round_doubles(drift(spark, sf_dir))


@register("population_drift", f"""WITH {DRIFT_CTE}
SELECT count(*) AS total_users,
       count(*) FILTER (WHERE coalesce(significant_deviations / total_features > 0.3, false)) AS drift_detected_users,
       {S.r6("count(*) FILTER (WHERE coalesce(significant_deviations / total_features > 0.3, false)) / greatest(count(*), 1)")} AS drift_ratio,
       count(*) FILTER (WHERE coalesce(significant_deviations / total_features > 0.3, false)) / greatest(count(*), 1) > 0.2
         AS retrain_recommended
FROM drift""")
def q_population_drift(spark, sf_dir):
    return round_doubles(BL.population_drift(drift(spark, sf_dir)))


# ---------------------------------------------------------------- baselines as they run
RUN_W = 25
WIN25_CTE = WIN_CTE.replace(f"recency <= {BASE_W}", f"recency <= {RUN_W}")


@register("baseline_window_w25", f"WITH {MAT_CTE}, {WIN25_CTE}\nSELECT user_id, session_id, CAST(recency AS INTEGER) AS recency FROM win")
def q_baseline_window_w25(spark, sf_dir):
    """L3 with a window that many users outgrow."""
    return BL.last_w(session_matrix(spark, sf_dir), RUN_W).select("user_id", "session_id", F.col("recency").cast("int"))


def _frames_sql() -> str:
    cols = []
    for i, c in enumerate(MF):
        for name, frame in (("b", f"{RUN_W - 1} PRECEDING AND CURRENT ROW"), ("p", f"{RUN_W} PRECEDING AND 1 PRECEDING")):
            cols.append(f"list(coalesce(CAST({_q(c)} AS DOUBLE), 0.0)) OVER (PARTITION BY user_id ORDER BY position "
                        f"ROWS BETWEEN {frame}) AS {name}l{i}")
    return ", ".join(cols)


def _decayed_sql() -> str:
    w = lambda e: f"list_sum(list_transform({e}, lambda v, i: v * pow(0.95, len({e}) - i))) / list_sum(list_transform({e}, lambda v, i: pow(0.95, len({e}) - i)))"
    return ", ".join(f"{w(f'{n}l{i}')} AS {n}{i}" for i in range(len(MF)) for n in "bp")


_RH = " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL AND g.{_q('sd_' + c)} > 0 AND abs({_q(c)} - b{i}) / g.{_q('sd_' + c)} > 3.0 THEN 1 ELSE 0 END"
                 for i, c in enumerate(MF))
_RT = " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL THEN 1 ELSE 0 END" for c in MF)
_RU = " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL AND g.{_q('sd_' + c)} > 0 THEN 1 ELSE 0 END" for c in MF)
_RS = " + ".join(f"CASE WHEN {_q(c)} IS NOT NULL AND g.{_q('sd_' + c)} > 0 "
                 f"THEN 1.0 / (1.0 + exp(2.0 - abs({_q(c)} - p{i}) / g.{_q('sd_' + c)})) ELSE 0.0 END" for i, c in enumerate(MF))
RUN_CTE = f"""{MAT_CTE}, {STATS_CTE},
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_start ASC NULLS FIRST, session_id) AS position FROM mat),
frames AS (SELECT *, {_frames_sql()} FROM ordered),
run AS (SELECT *, {_decayed_sql()} FROM frames),
hist AS (
  SELECT user_id, session_id, session_start, position, least(position, {RUN_W}) AS window_size,
         CASE WHEN position > 1 THEN {_RH} ELSE 0 END AS significant_deviations,
         CASE WHEN position > 1 THEN {_RT} ELSE 0 END AS total_features,
         CASE WHEN position > 1 AND ({_RU}) > 0 THEN ({_RS}) / ({_RU}) ELSE 0.5 END AS baseline_anomaly_score,
         {", ".join(f"b{i}" for i in range(len(MF)))} FROM run CROSS JOIN gstats g),
flags AS (SELECT *, significant_deviations / nullif(total_features, 0) AS drift_ratio,
                 coalesce(significant_deviations / nullif(total_features, 0) > 0.3, false) AS drift_detected FROM hist),
span AS (SELECT min(CAST(session_start AS DATE)) AS a, max(CAST(session_start AS DATE)) AS b, max(session_start) AS t_end FROM mat),
cuts AS (SELECT v AS version, CAST(a + CAST((b - a) * v // 3 AS INTEGER) AS TIMESTAMP) AS t FROM span, (VALUES (1), (2)) x(v))"""


def running(spark, sf_dir):
    """(session matrix, features, running baselines, drift history, retraining times, last session start)."""
    from datetime import datetime, timedelta
    m = _matrix_ckpt(spark, sf_dir)
    feats = BL.feature_columns(m)
    run = cut_lineage(BL.running_baselines(m, feats, RUN_W))
    first, last = m.agg(F.min("session_start"), F.max("session_start")).first()
    days = (last.date() - first.date()).days
    cuts = [datetime.combine(first.date(), datetime.min.time()) + timedelta(days=days * v // 3) for v in (1, 2)]
    return m, feats, run, BL.drift_history(run, feats, BL.global_stats(m, feats)), cuts, last


@register("drift_history", f"WITH {RUN_CTE}\nSELECT user_id, session_id, CAST(position AS BIGINT) AS position, CAST(window_size AS INTEGER) AS window_size, "
          f"significant_deviations, total_features, {S.r6('drift_ratio')} AS drift_ratio, drift_detected, "
          f"{S.r6('baseline_anomaly_score')} AS baseline_anomaly_score, " +
          ", ".join(f"{S.r6(f'b{i}')} AS {_q('baseline_' + c)}" for i, c in enumerate(MF)) + " FROM flags")
def q_drift_history(spark, sf_dir):
    """L5, L6, L8 for every session: the baseline after it, the drift test, the score against the baseline before it."""
    _, feats, _, hist, _, _ = running(spark, sf_dir)
    return round_doubles(hist.select("user_id", "session_id", "position", "window_size", "significant_deviations", "total_features",
                                     "drift_ratio", "drift_detected", "baseline_anomaly_score",
                                     *[F.col("baseline")[i].alias(f"baseline_{c}") for i, c in enumerate(feats)]))


STATE_CTE = f"""{RUN_CTE},
state AS (SELECT user_id, count(*) AS activity_count, max(window_size) AS window_size, max(session_start) AS last_updated,
                 max(CASE WHEN drift_detected AND session_start > (SELECT max(t) FROM cuts) THEN 1 ELSE 0 END) = 1 AS drift_detected
          FROM flags GROUP BY user_id)"""


@register("user_drift_state", f"""WITH {STATE_CTE}
SELECT user_id, activity_count, CAST(window_size AS INTEGER) AS window_size, last_updated, drift_detected FROM state""")
def q_user_drift_state(spark, sf_dir):
    """L6 + L10: every user's flag since the last retraining."""
    _, _, _, hist, cuts, last = running(spark, sf_dir)
    return BL.user_drift_state(hist, cuts, last)


@register("baseline_statistics", f"""WITH {STATE_CTE}
SELECT count(*) AS total_users, count(*) FILTER (WHERE drift_detected) AS drift_detected_users, CAST(2 AS BIGINT) AS retraining_count,
       {S.r6('avg(window_size)')} AS avg_window_size,
       CAST(max(floor(date_diff('second', last_updated, (SELECT t_end FROM span)) / 86400)) AS BIGINT) AS oldest_profile_age,
       count(*) FILTER (WHERE drift_detected) / count(*) > 0.2 AS retrain_recommended
FROM state""")
def q_baseline_statistics(spark, sf_dir):
    """L9 + L11 over the flags of all sessions."""
    _, _, _, hist, cuts, last = running(spark, sf_dir)
    return round_doubles(BL.statistics(BL.user_drift_state(hist, cuts, last), cuts, last))


_VERSIONS_SQL = f"""wins AS (
  SELECT * FROM (SELECT c.version, c.t AS valid_from, m.*, row_number() OVER (PARTITION BY c.version, m.user_id
                        ORDER BY m.session_start DESC NULLS LAST, m.session_id DESC) AS recency
                 FROM mat m JOIN cuts c ON m.session_start <= c.t OR m.session_start IS NULL) WHERE recency <= {RUN_W}),
versions AS (SELECT version, valid_from, user_id, count(*) AS activity_count, """ + ", ".join(
    f"avg(CAST({_q(c)} AS DOUBLE)) AS {_q(c)}" for c in MF) + " FROM wins GROUP BY version, valid_from, user_id)"


@register("profile_versions", f"WITH {RUN_CTE}, {_VERSIONS_SQL}\nSELECT version, valid_from, user_id, activity_count, " +
          ", ".join(f"{S.r6(_q(c))} AS {_q(c)}" for c in MF) + " FROM versions")
def q_profile_versions(spark, sf_dir):
    """The profiles that each retraining refits, from the windows as they stood then."""
    m, feats, _, _, cuts, _ = running(spark, sf_dir)
    return round_doubles(BL.profile_versions(m, feats, cuts, RUN_W)[0])


@register("retrain_versions", f"WITH {RUN_CTE}, {_VERSIONS_SQL}\nSELECT version, valid_from AS retrained_at, count(*) AS samples_used, "
          "count(DISTINCT user_id) AS users_affected FROM wins GROUP BY version, valid_from")
def q_retrain_versions(spark, sf_dir):
    """One history row per retraining."""
    m, feats, _, _, cuts, _ = running(spark, sf_dir)
    return BL.profile_versions(m, feats, cuts, RUN_W)[2]


@register("baseline_at", f"""WITH {RUN_CTE}, {_VERSIONS_SQL},
asked AS (SELECT DISTINCT user_id, CAST(CAST(session_start AS DATE) + CAST(d AS INTEGER) AS TIMESTAMP) + INTERVAL 12 HOUR AS "at"
          FROM mat, (VALUES (-1), (0), (20)) x(d) WHERE session_start IS NOT NULL),
events AS (
  SELECT user_id, session_start AS t, 0 AS kind, position AS o, NULL AS version, [{", ".join(f"b{i}" for i in range(len(MF)))}] AS b FROM flags
  WHERE session_start IS NOT NULL
  UNION ALL SELECT user_id, valid_from, 1, 0, version, [{", ".join(_q(c) for c in MF)}] FROM versions),
found AS (
  SELECT a.user_id, a."at", e.version, e.t, e.b, row_number() OVER (PARTITION BY a.user_id, a."at" ORDER BY e.t DESC, e.kind DESC, e.o DESC) AS rn
  FROM asked a LEFT JOIN events e ON e.user_id = a.user_id AND e.t <= a."at")
SELECT user_id, "at", version, t AS valid_from, """ + ", ".join(f"{S.r6(f'b[{i + 1}]')} AS {_q('baseline_' + c)}" for i, c in enumerate(MF)) +
          " FROM found WHERE rn = 1")
def q_baseline_at(spark, sf_dir):
    """The baseline valid at noon of the day before, the day of, and 20 days after every session."""
    m, feats, run, _, cuts, _ = running(spark, sf_dir)
    day = F.to_date("session_start")
    noon = F.explode(F.array(*[F.date_add(day, d) for d in (-1, 0, 20)])).alias("day")
    kind = m.schema["session_start"].dataType
    asked = (m.where(F.col("session_start").isNotNull()).select("user_id", noon).distinct()
              .select("user_id", (F.col("day").cast(kind) + F.expr("INTERVAL 12 HOURS")).alias("at")))
    out = BL.baseline_at(asked, run, BL.profile_versions(m, feats, cuts, RUN_W)[0], feats)
    return round_doubles(out.select("user_id", "at", "version", "valid_from",
                                    *[F.col("baseline")[i].alias(f"baseline_{c}") for i, c in enumerate(feats)]))


# ---------------------------------------------------------------- scans, explanations, fairness, feedback, tiers
from vigil.operators import explain as XAI, fairness as FAIR, feedback as FB, scan as SCAN, tiers as TIER  # noqa: E402

DOC_PATTERNS = {**SCAN.DEFAULT_PATTERNS, **SCAN.EMAIL_PATTERN}


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("leak_scan_documents", "WITH h AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern_matched, regexp_extract_all(text, {_sql_str(p)}) AS m FROM documents"
    for n, p in DOC_PATTERNS.items()) + """)
SELECT doc_id, pattern_matched, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS n_matches,
       'high' AS risk_level FROM h WHERE len(m) > 0""")
def q_leak_scan_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    a = SCAN.detect_leakage(docs, "text", ["doc_id"], DOC_PATTERNS)
    return a.select("doc_id", "pattern_matched", F.array_join("matches", "|").alias("matches"),
                    F.size("matches").alias("n_matches"), "risk_level")


@register("text_scan_pages", " UNION ALL ".join(
    f"SELECT page_id, '{n}' AS pattern_matched, 'medium' AS risk_level FROM pages "
    f"WHERE regexp_matches(html, {_sql_str(p)})" for n, p in DOC_PATTERNS.items()))
def q_text_scan_pages(spark, sf_dir):
    return SCAN.scan_text(read_table(spark, sf_dir, "pages"), "html", ["page_id"], DOC_PATTERNS)


@register("text_scan_conversations", " UNION ALL ".join(
    f"SELECT conv_id, turn, '{n}' AS pattern_matched, 'medium' AS risk_level FROM conversations "
    f"WHERE regexp_matches(text, {_sql_str(p)})" for n, p in DOC_PATTERNS.items()))
def q_text_scan_conversations(spark, sf_dir):
    return SCAN.scan_text(read_table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"], DOC_PATTERNS)


LONG_WORD = {"long_word": r"[A-Za-z]{18,}"}


@register("text_scan_conversations_words", f"""SELECT conv_id, turn, 'long_word' AS pattern_matched, 'medium' AS risk_level FROM conversations
WHERE regexp_matches(text, {_sql_str(LONG_WORD["long_word"])})""")
def q_text_scan_conversations_words(spark, sf_dir):
    """D-2 with a caller's pattern, one that these conversations hold."""
    return SCAN.scan_text(read_table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"], LONG_WORD)


EXPLAIN_FEATS = S.MATRIX_FEATURES


@register("explain_outliers", f"""WITH {DBLOF_CTE},
f AS (SELECT d.user_id, d.session_id, u.feature, u.value, abs(u.value) AS importance
      FROM dblof d JOIN mat m ON m.user_id = d.user_id AND m.session_id = d.session_id,
      LATERAL (SELECT unnest([{', '.join(repr(x) for x in EXPLAIN_FEATS)}]) AS feature,
                      unnest([{', '.join(f'CAST(coalesce(m."{x}", 0) AS DOUBLE)' for x in EXPLAIN_FEATS)}]) AS value) u
      WHERE d.is_outlier),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY importance DESC, feature) AS rn FROM f)
SELECT user_id, session_id,
       string_agg(feature, ',' ORDER BY rn) AS top_features,
       'Prediction: anomalous. Key factors: ' ||
       string_agg(printf('%s (%.2f) contributed %.1f%%', replace(feature, '_', ' '), value, importance * 100), '; ' ORDER BY rn)
       || '.' AS natural_language_summary
FROM r WHERE rn <= 3 GROUP BY user_id, session_id""")
def q_explain_outliers(spark, sf_dir):
    m, sc = scored_sessions(spark, sf_dir)
    o = sc.where(F.col("is_outlier")).select("user_id", "session_id").join(m, ["user_id", "session_id"])
    e = XAI.explain(o, EXPLAIN_FEATS, F.lit("anomalous"))
    return e.select("user_id", "session_id", F.array_join("top_features", ",").alias("top_features"),
                    "natural_language_summary")


def _fair_input(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return lab.join(docs, "doc_id").select("doc_id", "lang", "source",
                                            (F.lit(1) - F.col("quality")).alias("prediction"),
                                            F.col("toxic").alias("truth"))


FAIR_CTE = """WITH fin AS (SELECT l.doc_id, d.lang, d.source, 1 - l.quality AS prediction, l.toxic AS truth
                    FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
lng AS (SELECT prediction AS p, truth AS t, 'lang' AS attribute, lang AS value FROM fin
        UNION ALL SELECT prediction, truth, 'source', source FROM fin),
grp AS (SELECT attribute, value,
          coalesce(count(*) FILTER (WHERE p = 1 AND t = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 0.0) AS precision,
          coalesce(count(*) FILTER (WHERE p = 1 AND t = 1) / nullif(count(*) FILTER (WHERE t = 1), 0), 0.0) AS recall,
          avg(CAST(p AS DOUBLE)) AS flag_rate FROM lng GROUP BY attribute, value)"""


@register("fairness_overall", FAIR_CTE + f"""
SELECT {S.r6('avg(CASE WHEN prediction = truth THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {S.r6('coalesce(count(*) FILTER (WHERE prediction = 1 AND truth = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0), 0.0)')} AS precision,
       {S.r6('coalesce(count(*) FILTER (WHERE prediction = 1 AND truth = 1) / nullif(count(*) FILTER (WHERE truth = 1), 0), 0.0)')} AS recall
FROM fin""")
def q_fairness_overall(spark, sf_dir):
    return round_doubles(FAIR.overall(_fair_input(spark, sf_dir)))


@register("fairness_groups", FAIR_CTE + f"""
SELECT attribute, value, {S.r6('precision')} AS precision, {S.r6('recall')} AS recall,
       {S.r6('flag_rate')} AS flag_rate FROM grp""")
def q_fairness_groups(spark, sf_dir):
    return round_doubles(FAIR.group_metrics(_fair_input(spark, sf_dir), ["lang", "source"]))


@register("fairness_disparity", FAIR_CTE + f"""
SELECT {S.r6('max(flag_rate) - min(flag_rate)')} AS demographic_parity,
       round(max(flag_rate) - min(flag_rate), 9) > 0.2 AS bias_detected FROM grp""")
def q_fairness_disparity(spark, sf_dir):
    g = FAIR.group_metrics(_fair_input(spark, sf_dir), ["lang", "source"])
    return round_doubles(FAIR.disparity(g))


def _feedback_input(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    decision = (F.when(F.col("event_type") == "purchase", "true_positive")
                 .when(F.col("event_type") == "error", "false_positive").otherwise("needs_review"))
    return ev.select(F.col("user_id").cast("string").alias("user_id"), "ts", "event_id",
                     (F.col("value") / 500.0).alias("prediction_score"), decision.alias("analyst_decision"))


@register("analyst_feedback", f"""
WITH fb AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id,
                   CASE event_type WHEN 'purchase' THEN -0.01 * (value / 500.0)
                        WHEN 'error' THEN 0.01 * (1.0 - value / 500.0) ELSE 0.0 END AS d,
                   event_type FROM events)
SELECT user_id, count(*) AS total_feedback, count(*) FILTER (WHERE event_type = 'purchase') AS true_positives,
       count(*) FILTER (WHERE event_type = 'error') AS false_positives,
       {S.r6("list_reduce(list(d ORDER BY ts, event_id), lambda acc, x: least(greatest(acc + x, 0.1), 0.9), 0.5)")}
         AS current_threshold
FROM fb GROUP BY user_id""")
def q_analyst_feedback(spark, sf_dir):
    t = FB.adaptive_thresholds(_feedback_input(spark, sf_dir), "user_id", ["ts", "event_id"], "ts")
    return round_doubles(t)


@register("risk_tiers", f"""WITH {MAT_CTE}, {PROF_CTE}, {STATS_CTE},
s AS (SELECT s.user_id, s.session_id,
       CASE WHEN p.user_id IS NULL OR ({_SU}) = 0 THEN 0.5 ELSE ({_SP}) / ({_SU}) END AS score
      FROM mat s LEFT JOIN prof p ON p.user_id = s.user_id CROSS JOIN gstats g)
SELECT user_id, session_id, {S.r6('score')} AS baseline_anomaly_score,
       CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS risk_tier FROM s""")
def q_risk_tiers(spark, sf_dir):
    s = q_session_baseline_scores(spark, sf_dir)
    return s.withColumn("risk_tier", TIER.risk_tier(F.col("baseline_anomaly_score")))


# ---------------------------------------------------------------- remaining variants
@register("feature_variance", f"WITH {MAT_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.r6(f'var_pop(CAST({_q(c)} AS DOUBLE))')} AS var_pop, "
    f"var_pop(CAST({_q(c)} AS DOUBLE)) > 0.01 AS kept FROM mat" for c in MF))
def q_feature_variance(spark, sf_dir):
    """M1 + M2: population variance per numeric feature and the keep flag."""
    m = session_matrix(spark, sf_dir)
    feats = L.select_numeric(m)
    wide = m.agg(*[F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(feats)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("var_pop"))
                               for i, c in enumerate(feats)]))
    out = wide.select(rows.alias("r")).select("r.*").withColumn("kept", F.col("var_pop") > 0.01)
    return round_doubles(out)


def _ueba_sql(contamination: float) -> str:
    """Variant A in SQL: near-constant columns become 0 (as good as dropped), skewed ones log1p, gaps the median."""
    n = range(len(MF))
    x = [f"CAST({_q(c)} AS DOUBLE)" for c in MF]
    point = ", ".join(f"CASE WHEN v{i} > 0.01 THEN (coalesce(x{i}, m{i}) - a{i}) / CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END ELSE 0.0 END" for i in n)
    pts = f"""mat AS ({S.matrix_sql(GAP, RARE, UNUSUAL, ROLE_PEERS_SQL, rounded=False)}),
spr AS (SELECT {", ".join(f"var_pop({x[i]}) AS v{i}, skewness({x[i]}) AS g{i}" for i in n)} FROM mat),
lg AS (SELECT user_id, session_id, {", ".join(f"CASE WHEN abs(g{i}) > 1.0 THEN CASE WHEN {x[i]} > -1 THEN ln(1 + {x[i]}) END ELSE {x[i]} END AS x{i}" for i in n)}
       FROM mat CROSS JOIN spr),
med AS (SELECT {", ".join(f"quantile_cont(x{i}, 0.5) AS m{i}" for i in n)} FROM lg),
mom AS (SELECT {", ".join(f"avg(coalesce(x{i}, m{i})) AS a{i}, stddev_pop(coalesce(x{i}, m{i})) AS s{i}" for i in n)} FROM lg CROSS JOIN med),
pts AS (SELECT user_id || chr(1) || session_id AS id, [{point}] AS v FROM lg CROSS JOIN med CROSS JOIN mom CROSS JOIN spr)"""
    k = "(SELECT CAST(floor(least(greatest(sqrt(count(*)), 5), 50)) AS BIGINT) FROM mat)"
    return f"""{S.knn_lof_sql(pts, k, contamination)},
ueba AS (
  SELECT m.user_id, m.session_id, -s.lof AS lof_factor, s.is_outlier,
         100.0 * ((SELECT max(-lof) FROM scored) + s.lof) / nullif((SELECT max(-lof) - min(-lof) FROM scored), 0) AS anomaly_score
  FROM scored s JOIN mat m ON m.user_id || chr(1) || m.session_id = s.id)"""


@register("ueba_scores", f"""WITH {_ueba_sql(0.02)}
SELECT user_id, session_id, {S.r6('lof_factor')} AS lof_factor, is_outlier, {S.r6('anomaly_score')} AS anomaly_score FROM ueba""")
def q_ueba_scores(spark, sf_dir):
    """Variant A scoring (contamination .02 as in the analytics runner)."""
    return round_doubles(L.ueba_scores(session_matrix(spark, sf_dir), contamination=0.02))


@register("ueba_user_risk", f"""WITH {_ueba_sql(0.02)}
SELECT user_id, count(session_id) AS total_sessions, CAST(sum(CAST(is_outlier AS INT)) AS BIGINT) AS outlier_sessions,
       {S.r6('avg(anomaly_score)')} AS avg_anomaly_score, {S.r6('max(anomaly_score)')} AS max_anomaly_score,
       {S.r6('sum(CAST(is_outlier AS INT)) / count(session_id)')} AS outlier_rate
FROM ueba GROUP BY user_id""")
def q_ueba_user_risk(spark, sf_dir):
    """M17 variant A over the 0–100 scores."""
    return round_doubles(EVAL.user_risk_summary(L.ueba_scores(session_matrix(spark, sf_dir), 0.02),
                                                with_density=False))


@register("kmeans_peer_groups")
def q_kmeans_peer_groups(spark, sf_dir):
    """behaviour peer groups (k-means, best of 10 seeds) per user."""
    from vigil.operators.features import kmeans_peer_groups, user_behaviour
    ev = activity_events(spark, sf_dir)
    m = session_feature_matrix(ev, gap_minutes=GAP, rare_hour_threshold=RARE, unusual_threshold=UNUSUAL, peers=None)
    return kmeans_peer_groups(user_behaviour(m))


@register("user_tenure", f"""WITH {S.EV},{S.DIM},
mx AS (SELECT max("timestamp") AS t FROM ev)
SELECT user_id, role, department, manager_level, hire_date,
       CAST(floor(date_diff('second', CAST(hire_date AS TIMESTAMP), (SELECT t FROM mx)) / 86400) AS INTEGER) AS tenure_days,
       project
FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN dim USING (user_id)""")
def q_user_tenure(spark, sf_dir):
    """user dimension joined to the users seen, tenure to the latest event."""
    from vigil.operators.features import add_user_context
    ev = activity_events(spark, sf_dir)
    users = ev.groupBy("user_id").agg(F.max("timestamp").alias("timestamp"))
    return add_user_context(users, user_dimension(spark, sf_dir)).select(
        "user_id", "role", "department", "manager_level", "hire_date", "tenure_days", "project")


@register("profile_age", f"""WITH {MAT_CTE},
last AS (SELECT user_id, count(*) AS activity_count, max(session_end) AS last_updated FROM mat GROUP BY user_id)
SELECT user_id, activity_count, last_updated,
       CAST(floor(date_diff('second', last_updated, (SELECT max(session_end) FROM mat)) / 86400) AS BIGINT) AS profile_age_days
FROM last""")
def q_profile_age(spark, sf_dir):
    """Profile age in days at the latest session end (as_of)."""
    m = session_matrix(spark, sf_dir)
    prof = m.groupBy("user_id").agg(F.count(F.lit(1)).alias("activity_count"),
                                    F.max("session_end").alias("last_updated"))
    return BL.profile_age(prof, m.agg(F.max("session_end")).scalar())


@register("retrain_history", f"""WITH {MAT_CTE}, {WIN_CTE}
SELECT count(*) AS samples_used, count(DISTINCT user_id) AS users_affected FROM win""")
def q_retrain_history(spark, sf_dir):
    """Refit on the windows only; the history row."""
    m = session_matrix(spark, sf_dir)
    _, _, history = BL.retrain(BL.last_w(m, BASE_W), BL.feature_columns(m))
    return history


def _scored_once(spark, sf_dir):
    m, sc = scored_sessions(spark, sf_dir)
    return m, cut_lineage(sc)


_WEIGHT = TIER.COMPOSITE_WEIGHTS
_TIER_SQL = "CASE WHEN composite > 0.7 THEN 'high' WHEN composite > 0.4 THEN 'medium' ELSE 'low' END"
ALERT_CTE = f"""WITH {DBLOF_CTE}, {GRAPH_SQL},
ends AS (SELECT max(anomaly_score) AS hi, min(anomaly_score) AS lo FROM dblof),
rep AS ({INTENT_SQL}),
parts AS (
  SELECT d.user_id, d.session_id, (d.anomaly_score - lo) / nullif(hi - lo, 0) AS score_0_1, rep.intent_score, cdp.overall_risk_score AS graph_risk,
         rep.user_id IS NOT NULL AS reported
  FROM dblof d CROSS JOIN ends LEFT JOIN rep ON rep.user_id = d.user_id AND rep.session_id = d.session_id
  LEFT JOIN cdp ON cdp.user_id = d.user_id),
comp AS (SELECT *, coalesce(score_0_1, 0.0) * {_WEIGHT['score']} + (1.0 - coalesce(intent_score, 1.0)) * {_WEIGHT['intent']}
                + coalesce(graph_risk, 0.0) * {_WEIGHT['graph']} AS composite FROM parts)"""


@register("composite_risk", f"""{ALERT_CTE}
SELECT user_id, session_id, {S.r6('composite')} AS composite_risk, {_TIER_SQL} AS risk_tier FROM comp WHERE reported""")
def q_composite_risk(spark, sf_dir):
    """R-2 (composite weights are ours, the reference leaves it undefined):
    normalised DBLOF score, intent and graph risk → composite and tier of the flagged sessions."""
    m, sc = _scored_once(spark, sf_dir)
    rep = intent_report(spark, sf_dir, (m, sc))
    norm = L.lof_scores_0_100(sc.select("user_id", "session_id", F.col("anomaly_score").alias("lof")))
    out = rep.join(norm.select("user_id", "session_id", (F.col("score_0_100") / 100.0).alias("score_0_1")),
                   ["user_id", "session_id"], "left")
    comp = TIER.composite_risk(F.col("score_0_1"), F.col("intent_score"), F.col("graph_risk_score"))
    return round_doubles(out.select("user_id", "session_id", comp.alias("composite_risk"))
                            .withColumn("risk_tier", TIER.risk_tier(F.col("composite_risk"))))


@register("integrated_alerts", f"""{ALERT_CTE}
SELECT user_id, session_id, {S.r6('score_0_1')} AS score_0_1, {S.r6('intent_score')} AS intent_score, {S.r6('graph_risk')} AS graph_risk_score,
       {S.r6('composite')} AS composite_risk, {_TIER_SQL} AS risk_tier FROM comp""")
def q_integrated_alerts(spark, sf_dir):
    """R-2 with both stages on: every scored session, by composite risk."""
    scored = _scored_once(spark, sf_dir)
    events = processed_events(spark, sf_dir)

    def graph():
        *_, edges, verts = threat_graph(spark, sf_dir, events)
        return G.cross_domain_patterns(verts, edges)

    return round_doubles(RUNS.integrated(scored[1], lambda: intent_report(spark, sf_dir, scored), graph, True, True))


@register("integrated_alerts_plain", f"""WITH {DBLOF_CTE},
ends AS (SELECT max(anomaly_score) AS hi, min(anomaly_score) AS lo FROM dblof),
comp AS (SELECT user_id, session_id, (anomaly_score - lo) / nullif(hi - lo, 0) AS score_0_1,
                coalesce((anomaly_score - lo) / nullif(hi - lo, 0), 0.0) * {_WEIGHT['score']} AS composite FROM dblof CROSS JOIN ends)
SELECT user_id, session_id, {S.r6('score_0_1')} AS score_0_1, CAST(NULL AS DOUBLE) AS intent_score, CAST(NULL AS DOUBLE) AS graph_risk_score,
       {S.r6('composite')} AS composite_risk, {_TIER_SQL} AS risk_tier FROM comp""")
def q_integrated_alerts_plain(spark, sf_dir):
    """R-2 with both stages off: neither is planned."""
    return round_doubles(RUNS.integrated(_scored_once(spark, sf_dir)[1]))


@register("adaptive_drift")
def q_adaptive_drift(spark, sf_dir):
    """Adaptive-window drift per user over the last-W sessions (rows-only:
    sequential detector, checked by tests against the direct definition)."""
    m = _matrix_ckpt(spark, sf_dir)
    feats = BL.feature_columns(m)
    win = BL.last_w(m, BL.DEFAULT_WINDOW)
    return round_doubles(BL.adaptive_drift(win, BL.user_profiles(m, feats), BL.global_stats(m, feats), feats))
