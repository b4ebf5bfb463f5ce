"""Spelling variants against brute force, with tight filters, long words and edge rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from vigil.llm import spelling_variants as V

SCHEMA = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    out = collections.Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows(seed=2):
    r = random.Random(seed)
    base = ["grammar", "colour", "naïveté", "strasse", "straße", "aaaaab", "aabbaa", "zebra" * 5, "ÿÿÿÿÿ", "ab×cd÷e"]
    words = list(base)
    for _ in range(250):
        w = r.choice(words)
        i = r.randrange(len(w))
        words.append(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abzéÀ") + w[i:], w[:i] + r.choice("abzéÀ") + w[i + 1:], w.upper()]))
    long = "".join(r.choice("abc") for _ in range(150))
    words += [long, long[:70] + "z" + long[71:], long[:149], long + "x", "x" * 64, "x" * 65, "x" * 66]
    out = [(i, " ".join(r.choice(words[:int(len(words) ** r.random()) + 1]) for _ in range(r.choice([0, 3, 30, 120]))), "w", 1) for i in range(120)]
    out += [(500 + i, " ".join(words[-7:]), "w", 1) for i in range(5)]
    huge = "q" * 20_000
    return out + [(None, "grammar grammer, Grammar", "w", 1), (900, None, None, None), (901, "", "w", 1), (902, " \n.", "w", 1), (903, f"{huge} {huge}q {huge}\n{huge}q {huge} {huge}q", "w", 1),
                  (904, "repeat repeats repeat", "w", 1), (904, "repeat repeats repeat", "w", 1), (905, "repeats", "w", 1)]


@pytest.mark.parametrize("max_blocks", [V.MAX_BLOCKS, 1])
def test_matches_brute_force(spark, max_blocks):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    words = counted(rows())
    vocab = V.vocabulary(docs)
    assert {(r["word"], r["n"]) for r in vocab.collect()} == set(words.items())
    out = V.group(vocab, max_blocks=max_blocks)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = out.collect()
    assert len(got) == len(words) and set(map(tuple, got)) == grouped(words)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got) and max(r["n_near"] for r in got) > 3


def test_chains_of_many_steps(spark):
    words = {"a" * (5 + i): 2 ** i * 3 for i in range(14)}
    out = V.group(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert set(map(tuple, out.collect())) == grouped(words)
    assert {r["root"] for r in out.collect()} == {"a" * 18}


def test_ties_take_the_smallest_word(spark):
    words = {"abcde": 3, "abcdé": 6, "abcdf": 6, "abcd": 6, "abcdef": 6, "other": 9}
    out = {r["word"]: tuple(r) for r in V.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(out.values()) == grouped(words) and out["abcde"][1] == "abcd" and out["other"] == ("other", None, "other", 9, 0, None)


def test_edit_keys_are_keys_of_edited_words():
    r = random.Random(1)
    for size in (2, 5, 9, 70):
        words = ["".join(r.choice("abcé") for _ in range(size)) for _ in range(20)]
        letters = {V.shard_of(size): np.array(sorted(map(ord, "abcéz")), dtype=np.uint8)}
        seen = collections.Counter()
        for _, row, edit, key in V.edits(V._codes(words), letters, V.shard_of):
            for w, e, k in zip(row, edit, key):
                place, letter = int(e) >> 8, int(e) & 255
                edited = words[w][:place] + (chr(letter) if letter else "") + words[w][place + 1:]
                assert V.word_keys([edited])[0] == k
                seen[int(w), edited] += 1
        assert set(seen.values()) == {1}
        for i, w in enumerate(words):
            deleted = {w[:j] + w[j + 1:] for j in range(size)}
            later = {w[:j] + c + w[j + 1:] for j in range(size) for c in "abcéz" if c > w[j]}
            assert {e for k, e in seen if k == i} == deleted | later


def test_filters_pass_every_word(spark):
    words = ["".join(random.Random(i).choice("abcdefg") for _ in range(5 + i % 70)) for i in range(3000)]
    frame = V._with_keys(spark.createDataFrame([(w, 3) for w in sorted(set(words))], "word string, n long"))
    for blocks in (V.MAX_BLOCKS, 8):
        filters = V.build_filters(frame, blocks)
        for w in set(words):
            assert len(filters.contains(V.shard_of(len(w)), V.word_keys([w])))
    assert len(V.build_filters(frame).contains(20, np.random.RandomState(1).randint(0, 2**62, 100_000).astype(np.uint64))) < 1000


def test_empty(spark):
    assert V.result(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.result(spark.createDataFrame([(1, "too rare words", "w", 1)], SCHEMA)).count() == 0
