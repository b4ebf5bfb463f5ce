"""Odd rows that once broke an operator: page markup, ids on several texts, values beyond a base span, clashing names."""
import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from vigil.llm import decontaminate, html_text, ngram_jaccard, pii, secrets
from vigil.llm.common import cover, covered

PAGES = "page_id long, url string, html string"


def texts(spark, sources, host="http://h.example.com/"):
    rows = [(i, host + str(i), s) for i, s in enumerate(sources)]
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def article(i, inner=""):
    return f"<html><body><nav>menu</nav><article><p>story number {i} with words</p>{inner}</article></body></html>"


def test_tag_names_with_separators(spark):
    got = texts(spark, [article(i) for i in range(8)] + ["<x;y>odd 1:2</x;y><a:b;c>more</a:b;c>", "<3:x;4>"])
    assert got[8].split("\n\n") == ["odd 1:2", "more"] and got[0] == "story number 0 with words"


def test_unlike_deep_pages(spark):
    deep = "<div>" * 1300 + "deep {}" + "</div>" * 1300
    got = texts(spark, [deep.format(i) for i in range(6)] + ["<section>" + "<div>" * 1250 + "<p>other</p>"] + [article(9)])
    assert got[0] == "deep 0" and got[6] == "other"


@pytest.mark.parametrize("unit", ["<div class='x", "<a '>'", "<div>a</p>", "<a \"'>", "<li>x", "<!--", "<td><div>", "<x y='", "<", "</a '>' ", "<p class=\"a>b\">", "'\"<b>"])
def test_odd_markup_takes_linear_time(unit):
    for end in ("", ">", "'>", "\">"):
        source = unit * (400_000 // len(unit)) + end
        start = time.time()
        html_text.Page(source)
        assert time.time() - start < 6, (unit, end)


def _slow_tags(source):
    """Tags by trying the whole pattern at every place."""
    pos, out = 0, []
    while (m := html_text._TAG.search(source, pos)) is not None:
        out.append((m.start(), m.end(), m[2]))
        pos = m.end()
    return out


def test_tags_equal_the_plain_search():
    r = random.Random(7)
    for _ in range(6000):
        source = "".join(r.choice(["<", ">", "'", '"', "a", " ", "/", "<b", "</b", "<!--", "-->", "<!", "=", "<a '>'", "x"]) for _ in range(r.choice([5, 15, 40])))
        tags, pos, out = html_text._Tags(source), 0, []
        while (m := tags.next(pos)) is not None:
            out.append((m.start(), m.end(), m[2] if m.re is html_text._TAG else None))
            pos = m.end()
        assert out == _slow_tags(source), source


def test_alignment_equals_recursive_matching():
    r = random.Random(3)

    def tree(n):
        parents, labels = [-1], ["#"]
        for i in range(1, n):
            parents.append(r.randrange(i))
            labels.append(r.choice(["div", "p", "div.a", "ul"]))
        return parents, labels

    def best(a, b):
        """Greatest total of matched nodes (and of equal labels) of two trees."""
        kids = lambda t, i: [k for k, p in enumerate(t[0]) if p == i]

        def match(i, j):
            if a[1][i].split(".")[0] != b[1][j].split(".")[0]:
                return 0
            x, y = kids(a, i), kids(b, j)
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p in range(1, len(x) + 1):
                for q in range(1, len(y) + 1):
                    table[p][q] = max(table[p - 1][q], table[p][q - 1], table[p - 1][q - 1] + match(x[p - 1], y[q - 1]))
            return table[-1][-1] + 1 + (a[1][i] == b[1][j])
        return match(0, 0)

    text = lambda t: "\n".join(f"{p}:{x}" for p, x in zip(t[0][1:], t[1][1:]))
    for _ in range(150):
        a, b = tree(r.randrange(1, 9)), tree(r.randrange(1, 9))
        slots = html_text.align(text(a), text(b))
        total = sum(1 + (a[1][s] == b[1][j]) for j, s in enumerate(slots) if s >= 0)
        assert total == best(a, b)
        assert all(slots[b[0][j]] == a[0][s] for j, s in enumerate(slots) if s > 0)


DOCS = "doc_id long, text string, source string, n_words__before string, place string"


def family(words, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(60))


A, B, C, D = (family([f"{x}{i}" for i in range(300)], i) for i, x in enumerate("abcd"))


def rows(*pairs):
    return [(d, t, "s", "x", "y") for d, t in pairs]


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame(rows((3, A), (7, A), (7, B), (9, B), (9, ""), (11, C), (12, None), (12, C), (13, None)), DOCS).repartition(4)
    got = collections.Counter((r.doc_id, r.component_id) for r in ngram_jaccard.groups(docs).collect())
    assert got == {(3, 3): 1, (7, 3): 2, (9, 3): 2, (11, 11): 1, (12, 11): 2, (13, 13): 1}


def test_one_row_of_each_group_stays(spark):
    given = rows((3, A), (7, A), (7, B), (9, B), (20, C), (20, C), (20, D), (None, C), (None, "eins zwei"), (None, "eins zwei"), (None, None), (None, None), (None, ""),
                 (30, ""), (31, ""), (32, None), (32, None), (40, D + " x"))
    docs = spark.createDataFrame(given, DOCS).repartition(4)
    out = ngram_jaccard.keep_first(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 20, 30, 31, 32]
    assert collections.Counter(r.text for r in kept if r.doc_id is None) == {"eins zwei": 1, None: 1, "": 1}
    assert ngram_jaccard.keep_first(docs.limit(0)).count() == 0
    plain = ngram_jaccard.keep_first(docs.where("doc_id in (3, 30, 31)"))
    assert sorted(r.doc_id for r in plain.collect()) == [3, 30, 31]


def test_set_ids_are_checked_against_their_own_text(spark):
    near = B.split()
    near[5] = "changed"
    docs = spark.createDataFrame(rows((1, A), (1, B), (2, " ".join(near)), (5, C)), DOCS)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.groups(docs).collect()}
    assert got == {1: 1, 2: 1 if 100 * 51 >= 75 * 61 else 2, 5: 5}


def test_cleaning_with_a_clashing_name(spark):
    docs = spark.createDataFrame(rows((1, "a b c d e f"), (2, A)), DOCS)
    items = spark.createDataFrame([("i", "b c")], "item_id string, text string")
    out = {r.doc_id: r.text for r in decontaminate.clean(docs, items, max_coverage=1.0).collect()}
    assert out == {1: "a  d e f", 2: A} or out[2] == A and "b c" not in out[1]


def test_values_beyond_a_base_span():
    text = "password = abcdefgh$Xk9!mzQQw"
    base, added = secrets.find(text)
    assert [(text[a:b], k) for a, b, k in base] == [("password = abcdefgh", "assign")]
    assert [(text[a:b], k) for a, b, k in added] == [("abcdefgh$Xk9!mzQQw", "password")]
    assert secrets.redacted(text) == "[secret]"
    assert secrets.find("password = Xk9mzQQw7Rt2")[1] == []          # wholly inside the base span
    start = time.time()
    secrets.find("token = Abcdef12345 " * 20_000)
    assert time.time() - start < 20


def test_many_addresses_with_one_look_alike():
    start = time.time()
    base, added = pii.find("аx " + "a@b.co " * 20_000)
    assert len(base) == 20_000 and added == [] and time.time() - start < 5


def test_cover():
    r = random.Random(1)
    for _ in range(300):
        spans = [(a, a + r.randrange(1, 9)) for a in (r.randrange(30) for _ in range(r.randrange(6)))]
        known = cover(spans)
        for a in range(32):
            for b in range(a + 1, 40):
                assert covered((a, b), *known) == any(x <= a and b <= y for x, y in spans)
