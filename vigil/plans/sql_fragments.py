"""DuckDB SQL for the oracle side of the correctness check.

These restate each operator independently in plain SQL over the same
parquet tables (no Spark involved), mostly in the direct per-user form the
reference uses, so they also check the Spark side's skew-avoiding rewrites.
"""

def r6(x: str, digits: int = 6) -> str:
    """Same rounding ladder as ``vigil.functions.expr.round6``."""
    from vigil.functions.expr import ROUND_LADDER
    arms = []
    for bound, p, mul in ROUND_LADDER:
        val = f"floor(({x}) * {p!r} + 0.5) / {p!r}" if mul else f"floor(({x}) / {p!r} + 0.5) * {p!r}"
        arms.append(f"WHEN abs({x}) < {bound!r} THEN CAST({val} AS DOUBLE)")
    return f"(CASE {' '.join(arms)} ELSE CAST({x} AS DOUBLE) END)"


def rk(x: str) -> str:
    """Twin of ``knn.rank_key_col`` (same ladder of literal grids)."""
    from vigil.operators.knn import RANK_LADDER
    arms = []
    for bound, g in RANK_LADDER:
        val = f"floor(({x}) * {1.0 / g!r} + 0.5) / {1.0 / g!r}" if g < 1 else f"floor(({x}) / {g!r} + 0.5) * {g!r}"
        arms.append(f"WHEN abs({x}) < {bound!r} THEN CAST({val} AS DOUBLE)")
    return f"(CASE {' '.join(arms)} ELSE CAST({x} AS DOUBLE) END)"


EV = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS "timestamp",
         CAST(user_id AS VARCHAR) AS user_id,
         'PC-' || json_extract_string(props, '$.k') AS pc_id,
         CASE event_type WHEN 'signup' THEN 'logon' WHEN 'click' THEN 'file'
              WHEN 'view' THEN 'http' WHEN 'purchase' THEN 'email'
              WHEN 'error' THEN 'device' END AS activity_type,
         value
  FROM events)"""

DIM = """
dim AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Engineer' WHEN 'BUILDING' THEN 'Manager'
              WHEN 'FURNITURE' THEN 'Admin' WHEN 'HOUSEHOLD' THEN 'Analyst'
              WHEN 'MACHINERY' THEN 'Contractor' END AS role,
         n_name AS department, c_acctbal > 5000 AS manager_level,
         CAST(fo AS DATE) AS hire_date,
         [ 'Alpha', 'Beta', 'Gamma', 'Delta', 'Epsilon', NULL ][(c_custkey % 6) + 1] AS project
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS fo FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = c_custkey)"""

INSIDERS = """
insiders AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer WHERE c_custkey % 10 = 0)"""


def sessions_sql(gap_minutes: float) -> str:
    """F1 in the reference's per-user form: split on gap, first event, null
    gap or calendar-date change; counter is a running sum per user."""
    gap_us = int(round(gap_minutes * 60 * 1_000_000))
    return f"""
sl AS (
  SELECT *, lag("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, event_id) AS prev_ts
  FROM ev),
sp AS (
  SELECT *, (prev_ts IS NULL OR "timestamp" IS NULL
             OR date_diff('microsecond', prev_ts, "timestamp") > CAST({gap_us} AS BIGINT)
             OR CAST(prev_ts AS DATE) <> CAST("timestamp" AS DATE)) AS split
  FROM sl),
sc AS (
  SELECT *, sum(CAST(split AS BIGINT)) OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, event_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
  FROM sp),
sess AS (
  SELECT *, substr(md5(user_id || '_' || CAST(session_no AS VARCHAR)), 1, 16) AS session_id,
         CASE WHEN split THEN 0.0 ELSE date_diff('microsecond', prev_ts, "timestamp") / 1e6 END AS interarrival_s,
         hour("timestamp") AS hour
  FROM sc)"""


def matrix_sql(gap_minutes: float, rare: float, unusual: float, peer_sql: str | None,
               rounded: bool = True) -> str:
    """F1–F13 session matrix; ``peer_sql`` is a CTE body giving (user_id, peer_group)."""
    r6_ = r6 if rounded else (lambda x: f"({x})")
    z_cols = ["session_duration_s", "file_rate", "logon_rate", "device_rate", "http_rate"]
    peer_cte = ""
    z_select = ""
    z_join = ""
    if peer_sql:
        stats = ",\n".join(
            f"avg(e.{c}) AS m_{c}, CASE WHEN stddev_samp(e.{c}) = 0 THEN 1.0 ELSE stddev_samp(e.{c}) END AS s_{c}"
            for c in z_cols)
        peer_cte = f""",
peers AS ({peer_sql}),
ev_rows AS (
  SELECT p.peer_group, a.* FROM sess s JOIN agg a USING (user_id, session_id)
  LEFT JOIN peers p ON p.user_id = s.user_id),
pstats AS (SELECT peer_group, {stats} FROM ev_rows e WHERE peer_group IS NOT NULL GROUP BY peer_group)"""
        z_select = "," + ",".join(
            f"\n  {r6_(f'coalesce((a.{c} - ps.m_{c}) / ps.s_{c}, 0)')} AS {c}_z_peer" for c in z_cols)
        z_join = "LEFT JOIN peers p ON p.user_id = a.user_id LEFT JOIN pstats ps ON ps.peer_group = p.peer_group"
    return f"""
WITH {EV},{DIM},{sessions_sql(gap_minutes)},
logon_total AS (SELECT count(*) AS n FROM sess WHERE activity_type = 'logon' AND hour IS NOT NULL),
rare_hours AS (
  SELECT hour FROM sess WHERE activity_type = 'logon' AND hour IS NOT NULL
  GROUP BY hour HAVING count(*) / (SELECT n FROM logon_total) < {rare}),
flags AS (
  SELECT s.*,
         CASE WHEN s.activity_type = 'logon' AND s.hour IN (SELECT hour FROM rare_hours) THEN 1 ELSE 0 END AS rare_flag,
         CASE WHEN sum(CASE WHEN s.activity_type = 'file' THEN 1 ELSE 0 END) OVER (
                PARTITION BY user_id, session_id ORDER BY "timestamp" NULLS LAST, event_id
                ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS burst
  FROM sess s),
agg0 AS (
  SELECT user_id, session_id, min("timestamp") AS session_start, max("timestamp") AS session_end,
         date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 AS session_duration_s,
         count(*) AS event_cnt,
         count(*) FILTER (WHERE activity_type = 'file') AS file_cnt,
         count(*) FILTER (WHERE activity_type = 'logon') AS logon_cnt,
         count(*) FILTER (WHERE activity_type = 'device') AS device_cnt,
         count(*) FILTER (WHERE activity_type = 'http') AS http_cnt,
         avg(interarrival_s) AS interarrival_mean_s, stddev_samp(interarrival_s) AS interarrival_std_s,
         CAST(max(rare_flag) AS BIGINT) AS rare_logon_hour, CAST(sum(burst) AS BIGINT) AS file_burst,
         min(CAST("timestamp" AS DATE)) AS day
  FROM flags GROUP BY user_id, session_id),
agg AS (
  SELECT *, file_cnt / CASE WHEN session_duration_s IS NULL THEN NULL ELSE greatest(session_duration_s, 1.0) END AS file_rate,
         logon_cnt / CASE WHEN session_duration_s IS NULL THEN NULL ELSE greatest(session_duration_s, 1.0) END AS logon_rate,
         device_cnt / CASE WHEN session_duration_s IS NULL THEN NULL ELSE greatest(session_duration_s, 1.0) END AS device_rate,
         http_cnt / CASE WHEN session_duration_s IS NULL THEN NULL ELSE greatest(session_duration_s, 1.0) END AS http_rate
  FROM agg0),
pairs AS (
  SELECT lag(activity_type) OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, event_id) AS a0,
         activity_type AS a1 FROM ev),
trans AS (
  SELECT a0, a1, count(*) / (SELECT count(*) FROM pairs WHERE a0 IS NOT NULL) AS prob
  FROM pairs WHERE a0 IS NOT NULL GROUP BY a0, a1),
seq0 AS (
  SELECT user_id, CAST("timestamp" AS DATE) AS day, activity_type AS a0,
         lead(activity_type, 1) OVER w AS a1, lead(activity_type, 2) OVER w AS a2
  FROM ev WHERE "timestamp" IS NOT NULL
  WINDOW w AS (PARTITION BY user_id, CAST("timestamp" AS DATE) ORDER BY "timestamp", event_id)),
seq AS (
  SELECT user_id, day,
         count(DISTINCT CASE WHEN a1 IS NOT NULL THEN a0 || '>' || a1 END) AS g2,
         count(DISTINCT CASE WHEN a2 IS NOT NULL THEN a0 || '>' || a1 || '>' || a2 END) AS g3,
         count(*) FILTER (WHERE a1 IS NOT NULL AND coalesce(t.prob, 0) < {unusual}) AS unusual
  FROM seq0 LEFT JOIN trans t USING (a0, a1) GROUP BY user_id, day){peer_cte}
SELECT a.user_id, a.session_id, a.session_start, a.session_end,
       {r6_('coalesce(a.session_duration_s, 0)')} AS session_duration_s, a.event_cnt,
       {r6_('coalesce(a.file_rate, 0)')} AS file_rate, {r6_('coalesce(a.logon_rate, 0)')} AS logon_rate,
       {r6_('coalesce(a.device_rate, 0)')} AS device_rate, {r6_('coalesce(a.http_rate, 0)')} AS http_rate,
       {r6_('coalesce(a.interarrival_mean_s, 0)')} AS interarrival_mean_s,
       {r6_('coalesce(a.interarrival_std_s, 0)')} AS interarrival_std_s,
       a.rare_logon_hour, a.file_burst,
       CAST(coalesce(q.g2, 0) AS DOUBLE) AS "2gram_diversity", CAST(coalesce(q.g3, 0) AS DOUBLE) AS "3gram_diversity",
       CAST(coalesce(q.unusual, 0) AS DOUBLE) AS unusual_transitions{z_select}
FROM agg a LEFT JOIN seq q ON q.user_id = a.user_id AND q.day = a.day
{z_join}"""


def knn_lof_sql(points_cte: str, k: int, contamination: float) -> str:
    """Exact kNN (ties by neighbour id) + LOF + contamination label.
    ``points_cte`` defines pts(id VARCHAR, v DOUBLE[])."""
    return f"""
{points_cte},
pairs AS (
  SELECT a.id, b.id AS nbr, list_distance(a.v, b.v) AS dist
  FROM pts a JOIN pts b ON a.id <> b.id),
knn AS (
  SELECT id, nbr, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY {rk('dist')}, nbr) AS rnk FROM pairs)
  WHERE rnk <= {k}),
kd AS (SELECT id, max(dist) AS kdist FROM knn GROUP BY id),
lrd AS (
  SELECT k.id, 1.0 / (avg(greatest(k.dist, kd.kdist)) + 1e-10) AS lrd
  FROM knn k JOIN kd ON kd.id = k.nbr GROUP BY k.id),
lof AS (
  SELECT k.id, l1.lrd, avg(l2.lrd) / l1.lrd AS lof
  FROM knn k JOIN lrd l2 ON l2.id = k.nbr JOIN lrd l1 ON l1.id = k.id
  GROUP BY k.id, l1.lrd),
scored AS (
  SELECT *, {rk('-lof')} < {rk(f'(SELECT quantile_cont(-lof, {contamination}) FROM lof)')}
            AS is_outlier FROM lof)"""


EMB_PTS = """pts AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


MATRIX_FEATURES = ["session_duration_s", "event_cnt", "file_rate", "logon_rate", "device_rate",
                   "http_rate", "interarrival_mean_s", "interarrival_std_s", "rare_logon_hour",
                   "file_burst", "2gram_diversity", "3gram_diversity", "unusual_transitions",
                   "session_duration_s_z_peer", "file_rate_z_peer", "logon_rate_z_peer",
                   "device_rate_z_peer", "http_rate_z_peer"]


def standardized_points_sql(source: str, feats: list[str], id_expr: str) -> str:
    """M5 + M6: nulls → 0, (x − mean)/population std (0 → 1), as pts(id, v)."""
    parts = []
    for f in feats:
        x = f'CAST(coalesce("{f}", 0) AS DOUBLE)'
        sd = f"stddev_pop({x}) OVER ()"
        parts.append(f"({x} - avg({x}) OVER ()) / CASE WHEN {sd} = 0 THEN 1.0 ELSE {sd} END")
    return f"pts AS (SELECT {id_expr} AS id, [{', '.join(parts)}] AS v FROM {source})"


def dblof_sql(gap: float, rare: float, unusual: float, peer_sql: str, k: int, c: float) -> str:
    mat = matrix_sql(gap, rare, unusual, peer_sql, rounded=False)
    pts = standardized_points_sql("mat", MATRIX_FEATURES, "user_id || chr(1) || session_id")
    return f"""mat AS ({mat}),
{knn_lof_sql(pts, k, c)},
dblof AS (
  SELECT m.user_id, m.session_id, CASE WHEN s.is_outlier THEN -1 ELSE 1 END AS lof_factor,
         s.is_outlier, s.lof AS anomaly_score, 1.0 / (s.lof + 1e-10) AS local_density
  FROM scored s JOIN mat m ON m.user_id || chr(1) || m.session_id = s.id)"""


def grid_sql(gap, rare, unusual, peer_sql, ks=(20, 30, 40),
             base=(0.08, 0.10, 0.12, 0.14, 0.15, 0.16)) -> str:
    """M13 grid (without the final choice): one kNN at max k, LOF per k,
    linear-interpolated thresholds per contamination."""
    mat = matrix_sql(gap, rare, unusual, peer_sql, rounded=False)
    pts = standardized_points_sql("mat", MATRIX_FEATURES, "user_id || chr(1) || session_id")
    kmax = max(ks)
    base_list = ", ".join(f"CAST({b!r} AS DOUBLE)" for b in base)
    ks_list = ", ".join(str(k) for k in ks)
    return f"""mat AS ({mat}),
{INSIDERS},
{pts},
pairs AS (SELECT a.id, b.id AS nbr, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {rk('dist')}, nbr) AS rnk FROM pairs)
        WHERE rnk <= {kmax}),
ks AS (SELECT unnest([{ks_list}]) AS k),
kn AS (SELECT ks.k, knn.id, knn.nbr, knn.dist FROM knn JOIN ks ON knn.rnk <= ks.k),
kd AS (SELECT k, id, max(dist) AS kdist FROM kn GROUP BY k, id),
lrd AS (SELECT a.k, a.id, 1.0 / (avg(greatest(a.dist, kd.kdist)) + 1e-10) AS lrd
        FROM kn a JOIN kd ON kd.k = a.k AND kd.id = a.nbr GROUP BY a.k, a.id),
lof AS (SELECT a.k, a.id, avg(l2.lrd) / l1.lrd AS lof
        FROM kn a JOIN lrd l2 ON l2.k = a.k AND l2.id = a.nbr JOIN lrd l1 ON l1.k = a.k AND l1.id = a.id
        GROUP BY a.k, a.id, l1.lrd),
rate AS (SELECT avg(CASE WHEN i.user_id IS NOT NULL THEN 1.0 ELSE 0.0 END) AS r
         FROM mat m LEFT JOIN insiders i ON i.user_id = m.user_id),
cs AS (SELECT DISTINCT unnest([{base_list}, greatest(0.001, r * 0.5), r, r * 1.1, r * 1.2]) AS c FROM rate),
ranked AS (SELECT k, -lof AS v, row_number() OVER (PARTITION BY k ORDER BY -lof) - 1 AS i,
                  count(*) OVER (PARTITION BY k) AS n FROM lof),
pos AS (SELECT k, c, (n - 1) * c AS h FROM (SELECT DISTINCT k, n FROM ranked) JOIN cs ON true),
thr AS (SELECT p.k, p.c, CASE WHEN floor(p.h) = ceil(p.h) THEN lo.v
                              ELSE (ceil(p.h) - p.h) * lo.v + (p.h - floor(p.h)) * hi.v END AS t
        FROM pos p JOIN ranked lo ON lo.k = p.k AND lo.i = floor(p.h)
                   JOIN ranked hi ON hi.k = p.k AND hi.i = ceil(p.h)),
flags AS (SELECT t.c, t.k, l.lof, {rk('-l.lof')} < {rk('t.t')} AS o FROM thr t JOIN lof l ON l.k = t.k),
grid AS (
  SELECT c AS contamination, k AS n_neighbors, count(*) FILTER (WHERE o) AS num_outliers,
         count(*) FILTER (WHERE o) / count(*) AS outlier_rate,
         coalesce(avg(lof) FILTER (WHERE o), 0.0) AS mean_outlier_score
  FROM flags GROUP BY c, k),
grid2 AS (
  SELECT *, mean_outlier_score * 1e-9 + least(num_outliers, 2500) / 2500.0 * 1000.0 AS combined_score FROM grid)"""
