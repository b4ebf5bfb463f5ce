"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Documents are tokenised and closed with an end id.  Within a window of about a
million tokens, whole sequences are cut off long documents; what is left is
assigned in descending length to the sequence of lowest estimated cost (linear
plus quadratic attention cost) that still has room for it, and a document that
fits nowhere whole is cut over the cheapest sequences with room.  The windows'
last tokens go to sequences whose lengths are powers of two, so none is padded.

Windows follow the order of a partition's rows, so the work needs no shuffle
and a lost task repeats with the same result.  Sequence ids are unique, not
consecutive.

Defined results: null or empty text is a document of the end id alone; repeated
rows are packed each; null ids stay null; an empty table gives no pieces.  Extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, _schemas, _to_batch

LENGTH = 2048
END_ID = 1
WINDOW_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Words and word parts that a Python worker's caches hold; a full one starts anew.
WORDS, PARTS = 400_000, 250_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-ins of the byte-level alphabet, by byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, by cached words.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its words.  Words of Latin-1 characters are split as the
    tokenizer splits them and their parts go to its merge model; all others,
    and texts with separator controls, go through the tokenizer as they are.
    """

    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    _CONTROLS = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.packed = [_pack([i]) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.letters_only = not any(x.isalpha() for x in special)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            raw = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            tokens = self.model.tokenize(raw)
            got = self.packed[tokens[0].id] if len(tokens) == 1 else b"".join([self.packed[t.id] for t in tokens])
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) > "\xff":
            return self._plain(word)
        if self.letters_only and word.isalpha():             # one part, and no added token
            return self._part(word.lower())
        if self.special.search(word):
            return self._plain(word)
        return b"".join(map(self._part, self._PARTS.findall(word.lower())))

    def forget(self) -> None:
        """Empty the caches."""
        self.words.clear()
        self.parts.clear()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._CONTROLS.search(text):
            return self._plain(text)
        words = text.split()
        out = list(map(self.words.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._learn(words[i])
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self._word(word)
            if len(self.words) >= WORDS:
                self.words.clear()
            if len(word) < 64:
                self.words[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) for documents of the given lengths.

    Sequences are numbered from 0.  Full ones hold ``length`` tokens; the rest of
    the total goes to sequences of decreasing powers of two, so all are full.
    """
    pieces, rest = [], []
    seq = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            pieces.append((d, start, length, seq, 0))
            seq += 1
        if n % length:
            rest.append((n % length, d))
    total = sum(n for n, _ in rest)
    sizes = [length] * (total // length) + [1 << k for k in range(length.bit_length() - 1, -1, -1) if total % length >> k & 1]
    room, spent = np.array(sizes, dtype=np.int64), np.zeros(len(sizes))
    cap = room.copy()

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, seq + s, int(cap[s] - room[s])))
        room[s] -= n
        spent[s] += cost(n)

    uncut = []
    for n, d in sorted(rest, key=lambda x: (-x[0], x[1])):
        s = int(np.where(room >= n, spent, np.inf).argmin())
        if room[s] >= n:
            put(d, lengths[d] - n, n, s)
        else:
            uncut.append((n, d))
    for n, d in uncut:
        while n:
            s = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(n, int(room[s]))
            put(d, lengths[d] - n, take, s)
            n -= take
    return pieces


FIELDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID,
         window_tokens: int = WINDOW_TOKENS, keep_words: bool = True) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and places.

    Without ``keep_words`` a task's end empties its worker's caches.  An executor gives its tasks to all its waiting workers
    in turn; where other steps have left more of them than it has cores, each would come to hold full caches.
    """
    path = tokenizer or default_tokenizer()
    out, arrow = _schemas(docs.sparkSession, FIELDS)
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def flush(held: list[tuple], window: int) -> pa.RecordBatch:
        first = TaskContext.get().partitionId() << 40 | window << 20
        rows = [(held[d][0], start, n, held[d][1][4 * start:4 * (start + n)], len(held[d][1]) // 4, first + s, offset)
                for d, start, n, s, offset in assign([len(ids) // 4 for _, ids in held], length)]
        return _to_batch(rows, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held, size, window = [], 0, 0
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = enc.encode(text.as_py() or "") + end
                    held.append((doc_id, ids))
                    size += len(ids) // 4
                    if size >= window_tokens:
                        yield flush(held, window)
                        held, size, window = [], 0, window + 1
            if held:
                yield flush(held, window)
        finally:
            if not keep_words:
                enc.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), out)


def result(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces with a checksum in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                        "sequence_id", "offset")
