"""Host reputation against plain Python, rules against a scan of all rules, and edge rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import url_reputation as U

PAGES = "page_id long, url string, Host string, row string"
LABELS = "doc_id long, quality int, toxic int"
EDGES = [(None, "http://a.example.com/x", "h", "r"), (900_001, None, "h", "r"), (900_002, "no scheme", None, None), (900_003, "", "h", "r"),
         (900_004, "http://", "h", "r"), (900_005, "HTTP://WWW.Example.NET/EN/x?y#z", "h", "r"), (900_006, "https://example.net/en/?a://b", "h", "r"),
         (900_007, "https://example.net#/en/", "h", "r"), (900_008, "x://user:pw@m.example.com:80/de/1", "h", "r"), (900_009, "ftp://10.0.0.1:21/", "h", "r"),
         (900_010, "https://notnet/", "h", "r"), (900_011, "https://a.net/", "h", "r"), (900_011, "https://a.net/", "h", "r"), (900_012, "https://a.net", "h", "r"),
         (900_013, "http://shop.foo.co.uk/" + "p" * 200_000, "h", "r"), (900_014, "http://x.org/fr/a", "h", "r"), (900_015, "http://localhost/", "h", "r"),
         (900_016, "a?b=http://c.example.com/de/x", "h", "r"), (900_017, "http://É.example.com/", "h", "r")]


def tables(seed=4):
    r = random.Random(seed)
    pages, labels = list(EDGES), []
    for i in range(700):
        host = r.choice(["hot.example.com"] * 3 + [f"h{r.randrange(40)}.site{r.randrange(6)}.{r.choice(['com', 'org', 'co.uk'])}", "bad.example.com", "10.1.2.3"])
        pages.append((i, f"http://{host}/{r.choice(['en', 'de', 'fr', ''])}/{i}", "h", "r"))
        if r.random() < 0.6:
            bad = r.random() < (0.95 if host.startswith("bad") else 0.4 if host.startswith("h1") else 0.1)
            labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 0, 0), (0, 1, None), (1, None, None), (2, 0, 0), (2, 1, 0), (3, None, 1), (10_000_000, 0, 1)]
    return pages, labels


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]


def names(host):
    bare = host.rsplit("@", 1)[-1]
    head, _, port = bare.rpartition(":")
    if head and (port == "" or port.isdigit()):
        bare = head
    bare = bare.rstrip(".")
    if bare and all(c in "0123456789." for c in bare):
        return bare, ""
    parts = bare.split(".")
    two = ".".join(parts[-2:])
    return (".".join(parts[-3:]), two) if two in U.SUFFIXES else (two, parts[-1])


def expected(pages, labels, rules=U.RULES):
    marks = {}
    for d, q, t in labels:
        known = [x for x in (None if q is None else 1 - q, t) if x is not None]
        if d is not None and known:
            marks[d] = max([*known, *([marks[d]] if d in marks else [])])
    hosts = {}
    for page, url, *_ in pages:
        n, k = hosts.get(split_url(url)[0], (0, 0))
        hosts[split_url(url)[0]] = (n + (page in marks), k + marks.get(page, 0))

    def level(groups):
        """groups: key -> (n, k, m); posterior means and the strength."""
        excess = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups.values())
        pairs = sum(n * (n - 1) * m * (1 - m) for n, k, m in groups.values())
        s = 1 / min(max(excess / pairs if pairs else U.MIN_RHO, U.MIN_RHO), U.MAX_RHO) - 1
        return {g: (m * s + k) / (n + s) for g, (n, k, m) in groups.items()}, s

    def total(key):
        out = {}
        for host, (n, k) in hosts.items():
            a, b = out.get(key(host), (0, 0))
            out[key(host)] = (a + n, b + k)
        return out

    n, k = total(lambda h: 0)[0]
    suffixes, _ = level({s: (*x, (k + 1) / (n + 2)) for s, x in total(lambda h: names(h)[1]).items()})
    domains, _ = level({d: (*x, suffixes[d[1]]) for d, x in total(names).items()})
    means, strength = level({h: (*x, domains[names(h)]) for h, x in hosts.items()})
    out = []
    for page, url, *_ in pages:
        host, path = split_url(url)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        n, k = hosts[host]
        bound = max(means[host] - U.Z * math.sqrt(means[host] * (1 - means[host]) / (n + strength + 1)), 0)
        verdict = rule.action if rule else "block" if bound > U.MAX_BAD_RATE else "allow"
        out.append((page, host, path, rule and rule.host + rule.path, verdict, n, k, means[host], bound))
    return out


def same(got, want):
    """Equal rows but for the rounding of the last two columns."""
    got, want = (sorted(map(tuple, x), key=lambda r: repr(r[:7])) for x in (got, want))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert [x for r in got for x in r[7:]] == pytest.approx([x for r in want for x in r[7:]], abs=1e-6)


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_matches_plain_python(spark, max_rows):
    pages, labels = tables()
    p, lab = spark.createDataFrame(pages, PAGES).repartition(3), spark.createDataFrame(labels, LABELS)
    want = expected(pages, labels)
    same(U.judge(p, lab, max_broadcast_rows=max_rows).collect(), want)
    assert {"block", "allow"} <= {r[4] for r in want if r[3] is None}
    assert {r[4] for r in want if r[1] == "bad.example.com" and r[3] is None} == {"block"}


def test_allowed_keeps_whole_rows(spark):
    pages, labels = tables(8)
    p, lab = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    out = U.allowed(p, lab)
    assert out.columns == p.columns
    ids = [r[0] for r in expected(pages, labels) if r[4] == "allow"]
    assert sorted((r["page_id"] or -1) for r in out.collect()) == sorted(i or -1 for i in ids)
    assert {(r["Host"], r["row"]) for r in out.where(F.col("page_id") == 900_002).collect()} == {(None, None)}


def test_rules_of_equal_text_and_nested_hosts(spark):
    rules = (U.Rule("b.c", "/", "allow"), U.Rule("c", "/x/y", "block"), U.Rule("a.b.c", "", "block"), U.Rule("b.c", "/", "block"), U.Rule("c", "/x", "allow"))
    urls = [(1, "s://a.b.c"), (2, "s://a.b.c/"), (3, "s://b.c/x/y"), (4, "s://q.c/x/yz"), (5, "s://c/xa"), (6, "s://xc/x"), (7, "s://z.b.c/")]
    out = U.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([], LABELS), rules)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == {
        1: ("a.b.c", "block"), 2: ("a.b.c", "block"), 3: ("c/x/y", "block"), 4: ("c/x/y", "block"), 5: ("c/x", "allow"), 6: (None, "allow"), 7: ("b.c/", "block")}


def test_no_rows_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert U.judge(spark.createDataFrame([], PAGES), none).count() == 0
    assert U.allowed(spark.createDataFrame([], PAGES), none).count() == 0
    rows = U.judge(spark.createDataFrame(EDGES, PAGES), none).collect()
    assert {r["verdict"] for r in rows if r["rule"] is None} == {"allow"} and {r["bad_rate"] for r in rows} == {0.5}
