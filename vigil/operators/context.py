"""Rule-based intent scoring of flagged sessions.

The reference loops over flagged sessions and scans all events per session;
here it is one plan: user context (left join), the ±10 min event match (an
equi-join on (user, 10-minute bucket) plus a range filter, then first event
per session), action inference, rule checks against three small rule tables
(the number of roles / projects the caller registers) and label / reasoning
expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default rule tables (used when the caller registers none).
ROLE_PERMISSIONS = {
    "Engineer": ["file_access", "build_deploy", "code_commit", "database_query"],
    "Manager": ["user_management", "approve_budget", "email_send", "team_management"],
    "Admin": ["create_user", "delete_user", "system_config"],
    "Analyst": ["run_report", "data_export", "database_query"],
}
PROJECT_LIFECYCLES = {
    "Alpha": ("active", ["database_export", "code_commit", "run_report"]),
    "Beta": ("active", ["file_access", "team_management"]),
    "Gamma": ("completed", []),
    "Delta": ("active", ["database_query", "data_export"]),
    "Epsilon": ("active", ["email_send", "file_access"]),
}
TEMPORAL_RULES = {
    "Engineer": (9, 18),
    "Manager": (8, 19),
    "Admin": (9, 17),
    "Analyst": (9, 17),
}
# Intent thresholds and score weights.
BENIGN_AT, SUSPICIOUS_AT = 0.7, 0.4
W_ROLE, W_TIME, W_PROJECT = 0.4, 0.3, 0.3
W_CONTEXT, W_HISTORY = 0.7, 0.3


def role_permissions_table(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rules = rules or ROLE_PERMISSIONS
    return spark.createDataFrame([(r, a) for r, a in rules.items()], "role string, actions array<string>")


def project_lifecycles_table(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rules = rules or PROJECT_LIFECYCLES
    return spark.createDataFrame([(p, s, a) for p, (s, a) in rules.items()],
                                 "project string, stage string, expected_actions array<string>")


def temporal_rules_table(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rules = rules or TEMPORAL_RULES
    return spark.createDataFrame([(r, s, e) for r, (s, e) in rules.items()],
                                 "role string, start_hour int, end_hour int")


def user_context(sessions: DataFrame, user_dim: DataFrame) -> DataFrame:
    """Role / department / project ('unknown' when absent) and access level."""
    dim = user_dim.select("user_id", F.col("role").alias("_r"), F.col("department").alias("_d"),
                          F.col("project").alias("_p"), F.col("manager_level").alias("_m"))
    s = sessions.join(dim, "user_id", "left")
    return (s.withColumn("role", F.coalesce("_r", F.lit("unknown")))
             .withColumn("department", F.coalesce("_d", F.lit("unknown")))
             .withColumn("project", F.coalesce("_p", F.lit("unknown")))
             .withColumn("access_level", F.when(F.col("_m"), "manager").otherwise("employee"))
             .drop("_r", "_d", "_p", "_m"))


def nearest_event(sessions: DataFrame, events: DataFrame, minutes: int = 10,
                  start_col: str = "session_start") -> DataFrame:
    """C11: the first event (by timestamp, event_id) of the same user with
    timestamp within ``start ± minutes``; sessions without one keep nulls.

    Band join as an equi-join on (user, bucket) with buckets of ``minutes``:
    each session probes the buckets its band covers, so work and skew follow
    the (user, time) grid rather than the user alone."""
    width = minutes * 60 * 1_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def bucket(ts):
        return F.floor(F.timestamp_diff("MICROSECOND", epoch, ts) / F.lit(width)).cast("long")

    lo = F.col(start_col) - F.expr(f"INTERVAL {minutes} MINUTES")
    hi = F.col(start_col) + F.expr(f"INTERVAL {minutes} MINUTES")
    probes = (sessions.where(F.col(start_col).isNotNull())
                      .select("user_id", "session_id", start_col,
                              F.explode(F.sequence(bucket(lo), bucket(hi))).alias("_b")))
    ev = events.where(F.col("timestamp").isNotNull()).withColumn("_b", bucket(F.col("timestamp")))
    cols = [c for c in events.columns if c not in ("user_id",)]
    m = (probes.join(ev, ["user_id", "_b"])
               .where((F.col("timestamp") >= F.col(start_col) - F.expr(f"INTERVAL {minutes} MINUTES")) &
                      (F.col("timestamp") <= F.col(start_col) + F.expr(f"INTERVAL {minutes} MINUTES"))))
    first = (m.groupBy("user_id", "session_id")
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]),
                            F.struct(F.col("timestamp"), F.col("event_id"))).alias("_ev")))
    return (sessions.join(first, ["user_id", "session_id"], "left")
                    .select(*[F.col(c) for c in sessions.columns],
                            *[F.col(f"_ev.{c}").alias(f"ev_{c}") for c in cols]))


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def infer_action(prefix: str = "ev_") -> Column:
    """Email → file → logon/logout → database query → device → unknown."""
    def c(n):
        return F.col(prefix + n)
    la, hc, url, da = F.lower(c("logon_activity")), F.lower(c("http_content")), F.lower(c("url")), F.lower(c("device_activity"))
    return (F.when(F.coalesce(F.lower(c("activity_subtype")).contains("email"), F.lit(False)) |
                   _truthy(c("email_content")), "email_send")
             .when(_truthy(c("file_name")) | _truthy(c("file_tree")), "file_access")
             .when(_truthy(c("logon_activity")) & la.contains("login"), "logon")
             .when(_truthy(c("logon_activity")) & la.contains("logout"), "logout")
             .when((_truthy(c("http_content")) | _truthy(c("url"))) &
                   (F.coalesce(hc.contains("query"), F.lit(False)) | F.coalesce(url.contains("query"), F.lit(False))),
                   "database_query")
             .when(_truthy(c("device_activity")) & da.contains("removable"), "device_use")
             .when(_truthy(c("device_activity")) & da.contains("insert"), "device_insert")
             .otherwise("unknown"))


def rule_scores(acts: DataFrame, role_perms: DataFrame, temporal: DataFrame, lifecycles: DataFrame,
                ts_col: str = "timestamp") -> DataFrame:
    """Role, time and project checks.  Spark broadcasts the rule tables where their size allows."""
    rp = role_perms.select("role", F.col("actions").alias("_allowed"))
    tr = temporal.select("role", "start_hour", "end_hour")
    pl = lifecycles.select("project", F.col("stage").alias("_stage"), F.col("expected_actions").alias("_expected"))
    a = acts.join(rp, "role", "left").join(tr, "role", "left").join(pl, "project", "left")
    action = F.col("action")
    role_score = (F.when(F.col("_allowed").isNull(), 0.5)
                   .when(F.array_contains("_allowed", action), 1.0)
                   .when(F.exists("_allowed", lambda x: action.contains(x)), 0.7)
                   .otherwise(0.2))
    hour, wd = F.hour(F.col(ts_col)), F.weekday(F.col(ts_col))
    time_score = (F.when(F.col("start_hour").isNull() | F.col(ts_col).isNull(), 0.8)
                   .when((hour >= F.col("start_hour")) & (hour <= F.col("end_hour")) & (wd < 5), 1.0)
                   .when(wd < 5, 0.5).otherwise(0.3))
    project_score = (F.when(F.col("_stage").isNull(), 0.7)
                      .when(F.array_contains("_expected", action), 1.0)
                      .when((F.col("_stage") == "completed") & action.contains("access"), 0.4)
                      .otherwise(0.6))
    return (a.withColumn("role_score", role_score.cast("double"))
             .withColumn("time_score", time_score.cast("double"))
             .withColumn("project_score", project_score.cast("double"))
             .drop("_allowed", "start_hour", "end_hour", "_stage", "_expected"))


def intent_score(history: Column | None = None) -> Column:
    """.4·role + .3·time + .3·project; with a similarity-weighted benign
    share from neighbours: 70 / 30; clipped to [0, 1]."""
    ctx = (F.col("role_score") * W_ROLE + F.col("time_score") * W_TIME + F.col("project_score") * W_PROJECT)
    s = ctx if history is None else F.when(history.isNull(), ctx).otherwise(ctx * W_CONTEXT + history * W_HISTORY)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def intent_label(score: Column) -> tuple[Column, Column]:
    """(label, risk level)."""
    label = F.when(score >= BENIGN_AT, "benign").when(score >= SUSPICIOUS_AT, "suspicious").otherwise("malicious")
    risk = F.when(score >= BENIGN_AT, "low").when(score >= SUSPICIOUS_AT, "medium").otherwise("high")
    return label, risk


def reasoning(ts_col: str = "timestamp", benign_col: str | None = None, n_col: str | None = None) -> Column:
    """Reasoning sentence from the parts, joined by '. ' and closed with '.'."""
    # Sentence templates.
    parts = [
        F.when(F.col("role_score") < 0.5, F.format_string(
            "Action '%s' is NOT typically permitted for role '%s'", F.col("action"), F.col("role")))
         .when(F.col("role_score") >= 0.8, F.format_string(
            "Action aligns with expected permissions for role '%s'", F.col("role"))),
        F.when(F.col("time_score") < 0.5, F.format_string(
            "Activity occurred at %s, outside typical business hours",
            F.date_format(F.col(ts_col), "HH:mm 'on' EEEE"))),
        F.when(F.col("project_score") < 0.5, F.format_string(
            "Action unusual for project '%s' current lifecycle stage", F.col("project"))),
    ]
    if benign_col and n_col:
        parts.append(F.when(F.col(n_col) > 0, F.format_string(
            "Similar activities in history: %d/%d were benign", F.col(benign_col), F.col(n_col))))
    s = F.col("intent_score")
    parts.append(F.concat(F.lit("Overall assessment: Activity "),
                          F.when(s >= BENIGN_AT, "appears BENIGN and contextually justified")
                           .when(s >= SUSPICIOUS_AT, "appears SUSPICIOUS and warrants review")
                           .otherwise("appears MALICIOUS with high risk indicators")))
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def activity_text(with_justification: bool = True) -> Column:
    """The activity description text (defaults for missing parts)."""
    pieces = [F.lit("User role: "), F.coalesce(F.col("role"), F.lit("unknown")),
              F.lit(". Action: "), F.coalesce(F.col("action"), F.lit("unknown")),
              F.lit(". Time: "), F.coalesce(F.col("time_of_day"), F.lit("business_hours"))]
    if with_justification:
        pieces += [F.lit(". Justification: "), F.coalesce(F.col("justification"), F.lit("routine_work"))]
    pieces += [F.lit(". Project: "), F.coalesce(F.col("project"), F.lit("general")), F.lit(".")]
    return F.concat(*pieces)


def history_share(neighbours: DataFrame, outcomes: DataFrame) -> DataFrame:
    """C6 history part: per query id, sum(sim · benign) / sum(sim), benign
    count and neighbour count.  ``neighbours``: (id, nbr, dist); outcomes:
    (nbr, outcome)."""
    n = neighbours.join(outcomes, "nbr", "left").withColumn(
        "similarity", F.lit(1.0) / (F.lit(1.0) + F.col("dist") * F.col("dist")))
    ben = (F.col("outcome") == "benign").cast("double")
    return n.groupBy("id").agg((F.sum(F.col("similarity") * ben) / F.sum("similarity")).alias("history_score"),
                               F.sum(ben).cast("long").alias("benign_count"),
                               F.count(F.lit(1)).alias("neighbour_count"))
