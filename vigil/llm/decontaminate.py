"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised to words and put into one automaton per block of
bounded size.  Training words are streamed through it; the longest matching
length is tracked, and every word inside an occurrence of an item window is a
hit.  ``clean`` removes hit spans and drops documents beyond a coverage limit.

Words: maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
characters.  A window is ``window`` consecutive item words; an item with fewer
words (but not none) is one window.

Defined results: null or empty text has no words and no hits; an item with null
text or without words is ignored; an item with null id counts as an empty id;
repeated items or rows each count as given (equal item ids once); empty tables
give no hits or no rows.  Extra columns are ignored by ``scan`` and kept by
``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_name

WINDOW = 10
#: Bound on the words of one automaton; more items make more blocks (and passes).
BLOCK_WORDS = 1_000_000
#: Share of hit words above which ``clean`` drops the whole document.
MAX_COVERAGE = 0.5

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def normalise(text: str | None) -> bytes:
    """Bytes of the text with A-Z lower-cased and separators blanked (same byte offsets)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP)


class Automaton:
    """Generalised suffix automaton over word sequences.

    ``next[s]`` maps a word to the following state, ``link`` and ``length`` are
    the usual suffix links and longest lengths.  ``owners[s]`` lists the items
    whose window of exactly ``window`` words ends in state ``s``; ``short[s]``
    lists (length, item) of whole short items that are suffixes in ``s``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        owners: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            if not words:
                continue
            s = 0
            for i, w in enumerate(words, 1):
                s = self.next[s][w]
                if len(words) >= window and i >= window:
                    s = self._shorten(s, window)
                    owners.setdefault(s, set()).add(item)
            if len(words) < window:
                whole.setdefault(self._shorten(s, len(words)), []).append((len(words), item))
        self.owners = {s: sorted(v) for s, v in owners.items()}
        self.short: dict[int, list[tuple[int, str]]] = {}
        if whole:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                got = whole.get(s, []) + self.short.get(self.link[s], [])
                if got:
                    self.short[s] = got

    def _shorten(self, s: int, size: int) -> int:
        """The state that holds the suffix of ``size`` words of what ``s`` has read."""
        while self.length[self.link[s]] >= size:
            s = self.link[s]
        return s

    def _new(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """State for the words of ``p`` then ``w``: ``q`` itself, or a clone cut out of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans (word offsets, end exclusive) and the items with windows in them."""
        nxt, link, length, owners, short, size = self.next, self.link, self.length, self.owners, self.short, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        s = n = 0
        for i, w in enumerate(words):
            after = nxt[s].get(w)
            if after is None:
                while s and w not in nxt[s]:
                    s = link[s]
                    n = length[s]
                after = nxt[s].get(w)
                if after is None:
                    continue
            s = after
            n += 1
            begin = i + 1
            if n >= size:
                begin = i + 1 - size
                items.update(owners.get(self._shorten(s, size), ()))
            if s in short:
                for m, item in short[s]:
                    if m <= n:
                        items.add(item)
                        begin = min(begin, i + 1 - m)
            if begin <= i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i + 1])
        return [(a, b) for a, b in spans], items


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over blocks of whole items, each of about ``block_words`` words at most.

    The driver holds one block at a time.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count = int(total // (2 * block_words) + 1)         # a word takes two characters at least
    for b in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b) if count > 1 else items
        rows = sorted({(r.item_id, normalise(r.text)) for r in part.toLocalIterator()})
        yield Automaton([(i, t.split()) for i, t in rows], window)


def _merge(flat: list[int]) -> list[int]:
    """Sorted, merged spans; all spans are flat lists start, end, start, end, ..."""
    merged: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    return merged


def _step(automaton: Broadcast, texts: list, spans: list, items: list) -> list[tuple]:
    rows = []
    for t, flat, have in zip(texts, spans, items):
        words = normalise(t).split()
        found, names = automaton.value.match(words)
        if found:
            new = [x for s in found for x in s]
            flat, have = (_merge([*flat, *new]), sorted({*have, *names})) if flat else (new, sorted(names))
        rows.append((len(words), flat, have))
    return rows


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
              names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with the word count, the hit spans (flat word offsets) and the items hit.

    One pass per automaton block, none with a shuffle; the hits found so far
    travel with the row.  The names must be free in ``docs``.
    """
    n, spans, found = names
    sc = docs.sparkSession.sparkContext
    fields = f"{n} long, {spans} array<int>, {found} array<string>"
    df = docs.withColumns({spans: F.array().cast("array<int>"), found: F.array().cast("array<string>")})
    for automaton in blocks(items, window, block_words):
        shared = sc.broadcast(automaton)
        last = [free_name(df, f"{c}__before") for c in (n, spans, found)]
        df = df.withColumnsRenamed(dict(zip((n, spans, found), last)))
        df = add_columns(df, ["text", *last[1:]], fields, lambda t, s, i, shared=shared: _step(shared, t, s, i)).drop(*last)
    return df


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document."""
    return with_hits(docs.select("doc_id", "text"), items, window, block_words).drop("text")


def _n_hit(spans: str) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(spans), F.lit(1)) - 1)
    return F.aggregate(F.zip_with(spans, at, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")),
                       F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def result(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Digest per document: counts of words, hit words and items, and a hash of the item ids."""
    return scan(docs, items, window, block_words).select(
        "doc_id", "n_words", _n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans; documents hit in more than ``max_coverage`` of their words go.

    ``n_chars``, where present, is set to the new length.
    """
    names = tuple(free_name(docs, c) for c in ("n_words", "spans", "items"))
    n, spans, _ = names
    hit = with_hits(docs, items, window, block_words, names).where(_n_hit(spans) <= max_coverage * F.col(n))
    new = free_name(hit, "cut")
    hit = add_columns(hit, ["text", spans], f"{new} string", lambda t, s: [(cut(x, y),) for x, y in zip(t, s)])
    hit = hit.withColumn("text", F.col(new))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        hit = hit.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return hit.select(*docs.columns)


def cut(text: str | None, spans: list[int]) -> str | None:
    """Text without the words of ``spans`` (and the separators inside them)."""
    if not spans or text is None:
        return text
    raw, norm = text.encode("utf-8", "surrogatepass"), normalise(text)
    bounds, at = [], 0
    for w in norm.split():
        at = norm.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[done:bounds[a][0]])
        done = bounds[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")
