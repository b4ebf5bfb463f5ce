"""Every stage of the corpus pipeline, and the whole run, against plain Python over small odd tables."""
import collections
import random
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vigil.llm import decontaminate, ngram_jaccard, packing, quality_rules, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, place string, _sid long"
WORDS = [f"wort{i}" for i in range(500)]


def documents(seed=2):
    r = random.Random(seed)
    passage = [f"bench{i}" for i in range(14)]
    out = []
    for i in range(90):
        words = [r.choice(WORDS) for _ in range(r.choice([20, 60, 80, 150, 300]))]
        if i % 9 == 4:
            words = out[-2][1].split()
            words[3] = "changed"
        if i % 11 == 5:
            words[10:10] = passage
        if i % 13 == 6:
            words += ["password", "is", "Xq7#vLp9$z!2Rt"]
        out.append((i, " ".join(words)))
    out += [(None, out[3][1]), (None, out[3][1] + " " + " ".join(WORDS[:200])), (200, None), (201, ""), (202, " \n"), (203, out[7][1]), (203, out[7][1]), (204, "spam " * 400),
            (205, " ".join(f"l{i}" for i in range(40_000)))]
    return [(d, t, "en", "s", None if t is None else len(t), "k", "p", 1) for d, t in out], " ".join(passage)


@pytest.fixture(scope="module")
def tables(spark):
    rows, passage = documents()
    folder = tempfile.mkdtemp(prefix="vigil-pipe-", dir="/tmp")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs.write.mode("overwrite").parquet(folder + "/documents.parquet")
    labels = [(d, 0 if d % 7 == 0 else 1, 0) for d, *_ in rows if d is not None and d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(folder + "/labels.parquet")
    spark.createDataFrame([("i1", passage), ("i2", None)], "item_id string, text string").write.mode("overwrite").parquet(folder + "/benchmark.parquet")
    return folder, rows, passage


def read(spark, folder):
    return spark.read.parquet(folder + "/documents.parquet")


def count(frame):
    return collections.Counter((r.doc_id, r.text) for r in frame.collect())


def base_failed(text):
    words = (text or "").split()
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_quality_stage(spark, tables):
    folder, rows, _ = tables
    docs = read(spark, folder)
    out = P.keep_good(spark, docs, folder)
    assert out.columns == docs.columns
    verdict = quality_rules.apply_rules(docs, quality_rules.train(docs, spark.read.parquet(folder + "/labels.parquet")))
    want = collections.Counter(r.doc_id for r in verdict.where("kept").collect())
    assert collections.Counter(r.doc_id for r in out.collect()) == want
    kept = count(out)
    assert all(not base_failed(t) for _, t in kept) and 0 < sum(kept.values()) < len(rows)
    assert {r.doc_id for r in verdict.where("base_failed").collect()} == {d for d, t, *_ in rows if base_failed(t)}


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def test_duplicate_stage(spark, tables):
    folder, rows, _ = tables
    docs = read(spark, folder)
    out = P.keep_one_of_each_group(spark, docs, folder)
    assert out.columns == docs.columns
    sets = {i: shingles(r[1]) for i, r in enumerate(rows)}
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in named:
        for y in named:
            a, b = sets[x], sets[y]
            if x < y and (rows[x][0] == rows[y][0] or a and b and 100 * len(a & b) >= 75 * len(a | b)):
                parent[find(y)] = find(x)
    groups = collections.defaultdict(list)
    for i in named:
        groups[find(i)].append(rows[i][0])
    kept = [r.doc_id for r in out.collect()]
    assert sorted(d for d in kept if d is not None) == sorted(min(g) for g in groups.values())
    assert sum(d is None for d in kept) == 1                     # the copy of document 3 goes, the other stays


def test_decontamination_stage(spark, tables):
    folder, rows, passage = tables
    docs = read(spark, folder)
    out = P.remove_benchmark(spark, docs, folder)
    assert out.columns == docs.columns
    items = spark.read.parquet(folder + "/benchmark.parquet")
    assert decontaminate.result(out, items).where("contaminated").count() == 0
    split = lambda t: tuple((t or "").split())
    want = collections.Counter((d, split((t or "").replace(passage, " "))) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, split(r.text)) for r in out.collect()) == want
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_secret_stage(spark, tables):
    folder, rows, _ = tables
    docs = read(spark, folder)
    out = P.redact_secrets(spark, docs, folder)
    assert out.columns == docs.columns
    assert count(out) == collections.Counter((d, secrets.redacted(t)) for d, t, *_ in rows)
    assert out.where(F.col("text").contains("Xq7#vLp9$z!2Rt")).count() == 0


def test_packing_stage(spark, tables):
    folder, rows, _ = tables
    pieces = P.pack_sequences(spark, read(spark, folder), folder).collect()
    total = collections.Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert set(total) == {d for d, *_ in rows}
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_whole_run_is_its_stages(spark, tables):
    folder, rows, _ = tables
    docs = read(spark, folder)
    for _, stage in P.STAGES[:-1]:
        out = tempfile.mkdtemp(prefix="vigil-stage-", dir="/tmp") + "/x"
        before = docs.columns
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == before
    kept = {r.doc_id for r in docs.collect()}
    ran = P.run(spark, folder)
    assert {r.doc_id for r in ran.collect()} == kept
    digest = lambda f: collections.Counter((r.doc_id, r.start, r.length, tuple(r.ids) if "ids" in r else 0) for r in f.collect())
    one, two = digest(ran), digest(P.pack_sequences(spark, docs, folder))
    assert {(d, s) for d, s, *_ in one if s == 0} == {(d, s) for d, s, *_ in two if s == 0}


def test_stages_of_empty_and_extreme_tables(spark, tables):
    folder, rows, _ = tables
    for some in (read(spark, folder).limit(0), spark.createDataFrame([r for r in rows if not (r[1] or "").strip()], SCHEMA)):
        for name, stage in P.STAGES:
            out = stage(spark, some, folder)
            out.collect()
            if name != "packing":
                assert out.columns == some.columns
