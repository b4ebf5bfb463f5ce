"""URL filter: listed rules first, empirical-Bayes host reputation for the rest.

Labelled pages count as good or bad outcomes of their host.  Hosts nest in
registered domains, domains in suffixes, suffixes in the whole corpus.  At each
level the outcomes of a group are beta-binomial around the posterior mean of
its parent; how far groups of a level lie apart (the intra-group correlation,
and from it the strength of the prior) is estimated by moments over all groups
of that level.  A host without labels so takes its domain's posterior, one with
many keeps its own rate.  A host is blocked where the lower bound of its
posterior bad rate (mean less ``z`` standard deviations) exceeds ``max_bad_rate``.

Outcomes are aggregated per host before anything else, so a host with a third
of all pages is one row from there on.  Verdicts go back to the pages by a
broadcast of the host table where its counted rows are few; beyond that, hosts
with more than a thousandth of all pages (fewer than a thousand by arithmetic)
are broadcast and the others joined by a shuffle on the host.

Everything is DataFrame functions.  Defined results: a null url, and one
without ``://``, has an empty host and path, fits no rule and is judged as one
host named by the empty string; repeated pages count and are returned as often
as they stand there; pages without a label, and labels with no mark at all,
add no outcome; several labels of one id count once, bad if any is; without
any outcome every rate is the prior 1/2 and nothing is blocked; an empty table
gives an empty result; further columns of the tables are not looked at by
``judge`` and pass through ``allowed``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, checkpoint, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bad rate that a host's lower posterior bound must exceed to be blocked, and standard deviations between mean and bound.
MAX_BAD_RATE, Z = 0.5, 1.645
#: Bounds of an estimated correlation within groups; without groups of two outcomes the lower one holds.
MIN_RHO, MAX_RHO = 0.001, 0.9
#: Suffixes of two labels under which names are registered; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.cn", "com.mx")
#: A host with more pages than one in this many is heavy.
HEAVY = 1000
#: Rules that a caller may pass: they are held by the driver and broadcast.
MAX_RULES = 1_000_000


class Rule(NamedTuple):
    """Block or allow a host with all its subdomains where the path starts with ``path``."""

    host: str
    path: str
    action: str


#: Rules of the registered query (fixed values).
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    """What stands behind the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bare(host: Column) -> Column:
    """The host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"[.]*(:[0-9]*)?$", "")


def suffix_of(host: Column) -> Column:
    """The listed two-label suffix, else the last label; an address of digits and dots has none."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return (F.when(bare.rlike(r"^[0-9.]+$"), F.lit(""))
             .when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1)))


def domain_of(host: Column) -> Column:
    """The registered domain: one label before the suffix; an address is its own."""
    bare = _bare(host)
    return (F.when(bare.rlike(r"^[0-9.]+$"), bare)
             .when(F.substring_index(bare, ".", -2).isin(*SUFFIXES), F.substring_index(bare, ".", -3))
             .otherwise(F.substring_index(bare, ".", -2)))


def outcomes(labels: DataFrame) -> DataFrame:
    """(page, bad): one outcome per labelled id, bad for low quality or toxic text."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    return (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page"))
                  .agg(F.max(bad).cast("int").alias("bad")).where(F.col("bad").isNotNull()))


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from rows (n, k, m): outcomes, bad ones and the parent's mean.

    With correlation r the squared misses add up to the sum of n m (1 - m) (1 + (n - 1) r).
    """
    spread = F.col("m") * (1 - F.col("m"))
    row = groups.agg(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * spread).alias("excess"),
                     F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs")).first()
    rho = row["excess"] / row["pairs"] if row["pairs"] else MIN_RHO
    return 1.0 / min(max(rho, MIN_RHO), MAX_RHO) - 1.0


def _mean(strength: float) -> Column:
    return (F.col("m") * strength + F.col("k")) / (F.col("n") + strength)


def reputation(counts: DataFrame) -> DataFrame:
    """(host, pages, n, k) per host -> host, pages, labelled, bad, bad_rate, bad_rate_sd of its posterior.

    The three levels are aggregates of the host table, and four numbers pass through the driver.
    """
    hosts = checkpoint(counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = checkpoint(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("m", F.lit(rate))
    suffixes = suffixes.select("suffix", _mean(_strength(suffixes)).alias("m"))
    domains = domains.join(suffixes, "suffix")
    domains = checkpoint(domains.select("domain", "suffix", _mean(_strength(domains)).alias("m")))
    hosts = hosts.join(domains, ["domain", "suffix"])
    strength = _strength(hosts)
    mean, size = _mean(strength), F.col("n") + strength
    return hosts.select("host", "pages", F.col("n").alias("labelled"), F.col("k").alias("bad"), mean.alias("bad_rate"),
                        F.sqrt(mean * (1 - mean) / (size + 1)).alias("bad_rate_sd"))


def with_rules(hosts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``hosts`` with the rules that fit each host, longest first: array of (size, text, path, action)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    entry = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("size"), F.concat("rule_host", "rule_path").alias("text"),
                     F.when(F.col("rule_action") == "block", 0).otherwise(1).alias("action"), F.col("rule_path").alias("path"))
    listed = (hosts.sparkSession.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_action string")
                   .groupBy("rule_host").agg(F.sort_array(F.collect_set(entry)).alias("fits")))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (hosts.select("host", F.explode(ends).alias("rule_host")).join(F.broadcast(listed), "rule_host")
                  .groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("fits"))).alias("fits")))
    return hosts.join(found, "host", "left")


def attach(pages: DataFrame, hosts: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``pages`` (with a column host) joined to ``hosts`` (one row per host, with its number of pages)."""
    hosts = checkpoint(hosts)
    size = hosts.agg(F.count(F.lit(1)).alias("rows"), F.sum("pages").alias("pages")).first()
    if size["rows"] <= max_broadcast_rows:
        return pages.join(F.broadcast(hosts), "host")
    heavy = F.col("pages") > size["pages"] / HEAVY
    names = hosts.where(heavy).select("host")
    return (pages.join(F.broadcast(hosts.where(heavy)), "host")
                 .unionByName(pages.join(F.broadcast(names), "host", "left_anti").join(hosts.where(~heavy), "host")))


def _judged(pages: DataFrame, parts: DataFrame, labels: DataFrame, rules: tuple[Rule, ...],
            max_bad_rate: float, z: float, max_broadcast_rows: int) -> DataFrame:
    """``parts`` (columns of ``pages`` with host and path) with rule, verdict and the posterior of the host."""
    counts = (pages.select(F.col("page_id").cast("long").alias("page"), host_of(F.col("url")).alias("host"))
                   .join(outcomes(labels), "page", "left").groupBy("host")
                   .agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    hosts = reputation(counts).withColumn("bound", F.greatest(F.col("bad_rate") - z * F.col("bad_rate_sd"), F.lit(0.0)))
    rows = attach(parts, with_rules(hosts, rules), max_broadcast_rows)
    first = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    rows = rows.withColumn("fit", first)
    verdict = F.when(F.col("fit").isNotNull(), F.when(F.col("fit.action") == 0, "block").otherwise("allow")) \
               .when(F.col("bound") > max_bad_rate, "block").otherwise("allow")
    return rows.withColumn("rule", F.col("fit.text")).withColumn("verdict", verdict)


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad_rate: float = MAX_BAD_RATE,
          z: float = Z, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per page: host, path, the longest rule that fits, the verdict, and the host's outcomes and posterior."""
    url = F.col("url")
    parts = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    return _judged(pages, parts, labels, rules, max_bad_rate, z, max_broadcast_rows).select(
        "page_id", "host", "path", "rule", "verdict", F.col("labelled").alias("host_labelled"), F.col("bad").alias("host_bad"),
        F.round("bad_rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_rate_bound"))


def allowed(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad_rate: float = MAX_BAD_RATE,
            z: float = Z, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The rows of ``pages`` that are not blocked, all columns untouched."""
    whole = free_name(pages.select(F.lit(0).alias("host"), F.lit(0).alias("path")), "row")
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                         F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(whole))
    rows = _judged(pages, parts, labels, rules, max_bad_rate, z, max_broadcast_rows)
    return rows.where(F.col("verdict") == "allow").select(f"{whole}.*")


def _sql_level(name: str, source: str, key: str, parent: str) -> str:
    """SQL of one level: strength by moments and the posterior mean of each group."""
    return f"""
{name}_s AS (
  SELECT CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
         THEN 1 / least(greatest(sum(pow(k - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), {MIN_RHO}), {MAX_RHO}) - 1
         ELSE 1 / {MIN_RHO} - 1 END AS s FROM {source}
), {name} AS (
  SELECT {key}, {parent} n, k, s, (m * s + k) / (n + s) AS m FROM {source}, {name}_s
)"""


_SQL_BARE = "regexp_replace(regexp_replace(host, '^.*@', '', 's'), '[.]*(:[0-9]*)?$', '')"
_SQL_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)

#: The whole query in SQL: the three levels one after the other, rules by their ends and starts.
ORACLE = f"""
WITH r0 AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), pg AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r0
), lb AS (
  SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id
), hc AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM pg LEFT JOIN lb ON page_id = doc_id GROUP BY host
), hb AS (
  SELECT host, n, k, {_SQL_BARE} AS bare FROM hc
), hl AS (
  SELECT host, n, k, bare, string_split(bare, '.') AS l FROM hb
), hp AS (
  SELECT host, n, k, bare, l, array_to_string(l[-2:], '.') AS two, regexp_full_match(bare, '[0-9.]+') AS ip FROM hl
), h AS (
  SELECT host, n, k, CASE WHEN ip THEN bare WHEN two IN ({_SQL_LIST}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
         CASE WHEN ip THEN '' WHEN two IN ({_SQL_LIST}) THEN two ELSE coalesce(l[-1], '') END AS suffix FROM hp
), g AS (
  SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS m FROM h
), s0 AS (
  SELECT suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(g.m) AS m FROM h, g GROUP BY suffix
), {_sql_level("s1", "s0", "suffix", "")}, d0 AS (
  SELECT domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(s1.m) AS m FROM h JOIN s1 ON h.suffix = s1.suffix GROUP BY domain, h.suffix
), {_sql_level("d1", "d0", "domain", "suffix,")}, h0 AS (
  SELECT host, h.n, h.k, d1.m FROM h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix
), {_sql_level("h1", "h0", "host", "")}, v AS (
  SELECT host, n, k, m, greatest(m - {Z} * sqrt(m * (1 - m) / (n + s + 1)), 0) AS bound FROM h1
), rules(rule_host, rule_path, action) AS (
  VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in RULES)}
), fit AS (
  SELECT DISTINCT pg.host, pg.path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM pg) pg JOIN rules
    ON (pg.host = rule_host OR ends_with(pg.host, '.' || rule_host)) AND starts_with(pg.path, rule_path)
  GROUP BY pg.host, pg.path
)
SELECT page_id, pg.host, pg.path, rule, coalesce(action, CASE WHEN bound > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict,
       v.n AS host_labelled, v.k::BIGINT AS host_bad, round(v.m, 6) AS bad_rate, round(bound, 6) AS bad_rate_bound
FROM pg JOIN v ON pg.host = v.host LEFT JOIN fit ON pg.host = fit.host AND pg.path = fit.path
"""
