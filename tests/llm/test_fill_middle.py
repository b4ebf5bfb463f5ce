"""Fill-in-the-middle against string code, round trips and edge rows."""

import collections
import hashlib
import random
import re

import pytest

from vigil.llm import fill_middle as M

SCHEMA = "doc_id long, text string, output string, form string, Restored string"
EDGES = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "no feed"), (6, "has <P> inside\nx"), (7, "a<\nP>b<S\n>"),
         (8, "ä\r\nö🎉\nü" * 500), (9, "x" * 300_000), (10, "l\n" * 50_000), (11, "a\nb"), (11, "a\nb"), (12, "<M>"), (13, "tail\n")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rows():
    r = random.Random(3)
    some = [(100 + i, "".join(r.choice(["a", "é", "<", "P>", "\n", "line\n", "<S", ">"]) for _ in range(r.choice([1, 5, 40, 300])))) for i in range(120)]
    return [(d, t, "o", "f", None) for d, t in EDGES + some]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def test_matches_string_code(docs):
    want = collections.Counter()
    for d, t, *_ in rows():
        *head, out = expected(d, t)
        want[(*head, sha(out), sha(t or ""))] += 1
    assert collections.Counter(map(tuple, M.result(docs).collect())) == want


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_transform_and_back(docs, rate, spm):
    out = M.transform(docs, seed=9, rate=rate, spm_rate=spm, form_column="kind")
    assert out.columns == [*docs.columns, "kind"]
    got = collections.Counter((r["doc_id"], r["text"], r["kind"], r["output"], r["form"]) for r in out.collect())
    want = collections.Counter((d, expected(d, t, 9, rate, spm)[5], expected(d, t, 9, rate, spm)[2], "o", "f") for d, t, *_ in rows())
    assert got == want
    back = M.untransform(out, "kind")
    assert back.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((d, t or "") for d, t, *_ in rows())


def test_taken_names_get_underscores(docs):
    assert M.transform(docs).columns == [*docs.columns, "_form"]


def test_descriptors_cover_each_byte_once(docs):
    texts = collections.defaultdict(list)
    for d, t, *_ in rows():
        texts[d].append((t or "").encode())
    for r in M.descriptors(docs).collect():
        pieces = sorted((p["start"], p["length"]) for p in r["pieces"] if p["buffer"] == "text")
        at = 0
        for start, length in pieces:
            if length:
                assert start == at
                at += length
        assert at == len(texts[r["doc_id"]][0])
        assert sum(p["buffer"] == "sentinels" for p in r["pieces"]) == (0 if r["form"] == "plain" else 3)


def test_splitting_descriptors():
    pieces = [M.Piece(0, 0, 3), M.Piece(1, 3, 3), M.Piece(0, 10, 4)]
    for at in range(11):
        left, right = M.split(pieces, at)
        assert sum(p.length for p in left) == at and sum(p.length for p in right) == 10 - at
        spelled = [(p.buffer, p.start + i) for p in left + right for i in range(p.length)]
        assert spelled == [(p.buffer, p.start + i) for p in pieces for i in range(p.length)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.result(empty).count() == 0 and M.transform(empty).count() == 0 and M.descriptors(empty).count() == 0
