"""The operators against brute force, exact round trips and edge rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import (decontaminate, html_text, ngram_jaccard, packing, pii, pu_quality, quality_rules, secrets, substring_dedup)

TEXT = "doc_id long, text string, source string, n_words string, spans string"
EDGES = [(None, "a b c", "s", "x", "y"), (900, None, "s", None, None), (901, "", None, "x", None), (902, " \n\t ", "s", "x", "y"),
         (903, "wort " * 30000, "s", "x", "y"), (904, "same text here", "s", "x", "y"), (904, "same text here", "s", "x", "y")]


def corpus(seed=5, n=60):
    """Random texts over a small vocabulary, with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([0, 3, 6, 9, 12, 60, 200]))]
        kind = r.random()
        if out and kind < 0.2:
            words = list(r.choice(out))
        elif out and kind < 0.5:
            words = list(r.choice(out))
            for _ in range(len(words) // 40 + 1):
                if words:
                    words[r.randrange(len(words))] = "new"
        elif kind < 0.7:
            words[len(words) // 2:len(words) // 2] = passage
        out.append(words)
    return [(i, " ".join(w), "src", "x", "y") for i, w in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() + EDGES, TEXT).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TEXT)


def test_decontamination_matches_brute_force(spark, docs, empty):
    rows = corpus()
    items = [("i1", rows[7][1]), ("i2", "same TEXT here"), ("i3", None), ("i4", ""), ("i2", "same text here"), (None, "b c")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(item or "")
    expected = collections.Counter()
    for d, t, *_ in rows + EDGES:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        expected[(d, len(w), len(hit), len(found), sha, bool(hit))] += 1
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1_000_000, 40):
        assert collections.Counter(map(tuple, decontaminate.result(docs, bench, block_words=block).collect())) == expected
    assert decontaminate.result(empty, bench).count() == 0
    assert decontaminate.result(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.clean(docs, bench, max_coverage=1.0)
    assert clean.columns == docs.columns and decontaminate.result(clean, bench.where("item_id = 'i1'")).where("contaminated").count() == 0


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, window_tokens=5000).collect()
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        total = sum(r.length for r in rs)
        assert total <= 2048 and total & (total - 1) == 0
    for d, t, *_ in corpus() + EDGES[:-2]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[d], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert all(r.doc_tokens == len(ids) for r in got)
    assert {r.ids_crc32 == zlib.crc32(b"") for r in packing.result(docs).collect()} == {False}
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["it's I'LL x²3 ½a µm ÀÉ", "a\x1cb c\x85d\xa0e", "<|endoftext|> a<|endoftext|>b", "ſt 'S İ ΑΣ é",
                                  "日本 👍🏽 x​y", "a\x0bb　e", "foo_bar__ 12,345.67$ €5", "ＡＢ ﬁ"])
def test_encoder_equals_tokenizer(text):
    enc = packing.encoder(packing.default_tokenizer())
    ids = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_substring_dedup_matches_brute_force(docs, empty):
    first, expected = {}, {}
    rows = sorted((d, t) for d, t, *_ in corpus() + EDGES[1:-1])
    hits = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hits[d] = (w, bytearray(len(w)))
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i:i + 20]), (d, i)) != (d, i):
                hits[d][1][i:i + 20] = b"\1" * 20
    for d, (w, hit) in hits.items():
        expected[d] = (len(w), hit.count(1), " ".join(x for x, h in zip(w, hit) if not h))
    for start in (10, 5):
        got = substring_dedup.dedup(docs, start_words=start).where("doc_id is not null").collect()
        assert {r.doc_id: tuple(r[1:]) for r in got} == expected
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_of_shared_ids(spark):
    r = random.Random(3)
    words = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    a, b, head = words(25), words(30), words(22)
    rows = [(None, f"{words(60)} {a}"), (None, f"{words(3)} {a} {words(5)}"), (None, words(21)), (None, words(200)), (7, f"{b} {words(90)}"),
            (7, f"{words(40)} {b}"), (7, words(24)), (8, f"{head} {words(9)}"), (8, f"{head} {words(2)}"), (2, f"{words(4)} {head}"),
            (9, a), (9, a), (9, words(20)), (None, ""), (None, None), (-(1 << 63), f"{words(6)} {a}"), ((1 << 63) - 1, b)]
    rows += [(None, f"{head} {words(k)}") for k in range(12)]
    low = lambda d: (d is not None, d or 0)
    first, expected = {}, collections.Counter()
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 19):
            at = tuple(w[i:i + 20])
            first[at] = min(first.get(at, (low(d), i)), (low(d), i))
    for d, t in rows:
        w = (t or "").split()
        hit = {j for i in range(len(w) - 19) if first[tuple(w[i:i + 20])] != (low(d), i) for j in range(i, i + 20)}
        expected[(d, len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit))] += 1
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        for start in (10, 5):
            assert collections.Counter(map(tuple, substring_dedup.dedup(docs, start_words=start).collect())) == expected
    # rows of one id, and short rows that are equal, go to more than one document bucket
    many = spark.createDataFrame([(None, words(30)) for _ in range(40)] + [(None, "")] * 40, "doc_id long, text string")
    many = many.withColumn("key", substring_dedup._key_column()).withColumn("part", substring_dedup._part_column(8, 20))
    assert {r.n for r in many.groupBy(F.length("text") > 0).agg(F.countDistinct("part").alias("n")).collect()} == {8}


def test_jaccard_matches_brute_force(docs, empty):
    sets = {}
    for d, t, *_ in corpus() + EDGES[1:-1]:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = ngram_jaccard.groups(docs).where("doc_id is not null").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), group[d]) for d, s in sets.items()}
    assert ngram_jaccard.groups(empty).count() == 0
    assert ngram_jaccard.keep_first(docs).columns == docs.columns


def test_personal_data():
    base, added = pii.find("mail john.doe (at) example [dot] com or a@b.c_d@e.fg, card 4111 1111-1111 1111, ip 10.0.0.256 1.2.3.4.5")
    assert [k for *_, k in base] == ["email", "email", "ip", "card"] or {k for *_, k in base} == {"email", "ip", "card"}
    assert [k for *_, k in added] == ["email"]
    for text, kind in (("jоhn@exаmple.com", "email"), ("ｊｏ＠ｅｘ．ｃｏｍ", "email"), ("192 dot 168 dot 1 dot 1", "ip"),
                       ("plus four nine one five one two three four five six seven", "phone")):
        assert pii.find(text) == ([], [(0, len(text), kind)])
    for clean in ("look at the dot in the corner", "one two three", "we met at noon . com", None, "", "x" * 100_000):
        assert pii.find(clean) == ([], [])


def test_disguises_need_no_other_mark():
    for text, kind in (("john at example.com", "email"), ("john at example dot ch", "email"), ("john at example [dot] nl", "email"),
                       ("jo dot doe at example dot co dot nz", "email"), ("john at example.ca", "email"), ("john at example dot it", "email"),
                       ("one nine two dot one six eight dot one dot one", "ip"), ("192 dot one six eight [dot] 1.1", "ip"),
                       ("4111 1111 one one one one 1111", "card"), ("+49 151 two three four 5678", "phone"),
                       ("plus 49 151 two  three-four 5678", "phone")):
        assert pii.find(text) == ([], [(0, len(text), kind)]), text
        assert pii.find(f"so: {text}, yes") == ([], [(4, 4 + len(text), kind)]), text
    for clean in ("we met at noon. It was one or two", "look at the dot matrix", "polka dot dress at 3", "version 1 . 2 . 3 . 4", "one, two"):
        assert pii.find(clean) == ([], [])
    r = random.Random(1)
    bits = ["at", "@", "dot", ".", "[", "]", "(", " ", " ", " ", "-", "one", "Two", "oh", "plus", "7", "12", "jo", "ex", "com", "ch", "the"]
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=12))
        assert pii._disguised(text) or pii._rewrite(text) == (text, None), text


def test_wider_spans_are_added():
    for text, inner in (("j\u043ehn.doe@example.com", (2, 20)), ("john@mail.ex\u0430mple.com", (0, 12)), ("a@b.example (dot) com", (0, 11))):
        assert pii.find(text) == ([(*inner, "email")], [(0, len(text), "email")])
    assert pii.find("a@b.com \u0430 c@d.org") == ([(0, 7, "email"), (10, 17, "email")], [])


def test_secrets():
    text = 'token = "abcdefgh12" and password is Xk9$vQ2!mz AKIAABCDEFGHIJKL ' + "0a" * 16
    base, added = secrets.find(text)
    assert [k for *_, k in base] == ["assign", "access", "hex"] and [text[a:b] for a, b, _ in added] == ["Xk9$vQ2!mz"]
    assert secrets.find("password is required here, token: changeme") == ([(27, 42, "assign")], [])
    assert secrets.guess_cost("qwerty123") < 4 < secrets.guess_cost("Xk9$vQ2!mz")
    assert secrets.redacted(None) is None and secrets.redacted("clean") == "clean" and "Xk9" not in secrets.redacted(text)


def test_long_values_are_judged_whole():
    for start in ("x" * 80, "xy" * 50, "password" * 500, "-=" * 300):
        text = f"password is {start}Xk9$vQ2!mzR7"
        assert secrets.find(text) == ([], [(12, len(text), "password")])
        assert secrets.find(f"password is {start}") == ([], [])
    assert secrets.find("pwd: " + "*" * 20_000) == ([], [])
    assert secrets.guess_cost("abcdefghijklmnopqrstuvwxyz") < 4


def test_page_text(spark):
    body = "".join(f"<li><a href=/{i}>menu</a></li>" for i in range(4))
    rows = [(i, "http://h.example/x", f"<html><body><nav><ul>{body}</ul></nav><div class=ad>buy {i}</div><article><h1>T{i}</h1>"
             f"<p>Same line</p><p>Text &amp; more\n {i}<br>end<div class='comments'><p>first!</p></div></article><footer>f</footer>")
            for i in range(8)] + [(8, None, None), (9, "odd", ""), (9, "odd", "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = html_text.extract(pages).collect()
    assert {r.text for r in got if r.page_id < 8} == {f"T{i}\n\nSame line\n\nText & more {i} end" for i in range(8)}
    assert sorted((r.page_id, r.text) for r in got if r.page_id >= 8) == [(8, ""), (9, ""), (9, "a\n\nb")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_page_text_outside_marked_regions(spark):
    def text(i):
        return f"Main text number {i} of a page, told at some length"
    forms = {"layout.example": lambda i: f"<h1>T</h1><div class='content has-sidebar'><p>{text(i)}</p></div><div class='sidebar'>side {i}</div>",
             "inner.example": lambda i: f"<div class='widget'><article><p>{text(i)}</p></article><p>w {i}</p></div>",
             "teaser.example": lambda i: f"<article>Tease {i}</article><div><p>{text(i)}</p></div>",
             "cards.example": lambda i: f"<article>{text(i)}<div class='comments'><article>re {i}</article></div></article>"
                                        f"<div class='related'><article>card {i}</article></div>",
             "mixed.example": lambda i: f"<div><p>Same on all pages</p><p>{text(i)}</p><p>Made with care</p></div>"}
    for n in (8, 1):
        rows = [(i, f"http://{host}/{i}", f"<html><body>{form(i)}</body></html>") for host, form in forms.items() for i in range(n)]
        got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
        found = {(r.url.split("/")[2], r.page_id): r.text for r in got}
        for i in range(n):
            assert found["layout.example", i] == (text(i) if n > 1 else f"T\n\n{text(i)}")
            assert found["inner.example", i] == text(i)
            assert found["cards.example", i] == text(i)
            assert found["teaser.example", i] == f"Tease {i}\n\n{text(i)}"
            assert found["mixed.example", i] == (text(i) if n > 1 else f"Same on all pages\n\n{text(i)}\n\nMade with care")


def test_quality_rules(spark, docs, empty):
    for d, t, *_ in corpus() + EDGES:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        assert quality_rules.base_counts(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), 0, len(repeat))
    assert quality_rules.base_counts("a\nb\na\n \n \n")[3] == 1
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert quality_rules.train(docs, labels) is None
    assert quality_rules.apply_rules(docs, None).count() == docs.count() and quality_rules.apply_rules(empty, None).count() == 0


def test_classifiers_on_held_out_rows(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    rows = pu_quality.result(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert pu_quality.score(docs.limit(0), None).count() == 0 and pu_quality.train(docs, labels.limit(0)) is None
    verdict = quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in verdict) >= 0.9 * len(verdict)
