"""Fill-in-the-middle transformation over a piece table.

A document is a list of descriptors (buffer, start, length) over two immutable
buffers: its UTF-8 text and the sentinels.  Cutting splits descriptors, an
arrangement permutes the cut parts and puts sentinel descriptors between them,
a digest streams the bytes that descriptors point at, and restoring reads the
parts back from an output and applies the inverse permutation.  Text is copied
only where an output is asked for.

Units are lines: ``[^\\n]*\\n|[^\\n]+``, matched left to right.  Both cuts and the
form come from a hash of the document's id, so a repeated or recomputed row
gives the same output.

Defined results: a null text is the empty text; a null id hashes as the empty
string; an empty text, and one that holds a sentinel, stays plain (its cuts are
null); repeated rows give repeated results; an empty table gives an empty
result; columns of any other name pass through ``transform`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, free_name, map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The sentinel buffer, and where each sentinel stands in it.
SENTINELS = (PREFIX + SUFFIX + MIDDLE).encode()
_PLACE = {p: (SENTINELS.index(p.encode()), len(p.encode())) for p in (PREFIX, SUFFIX, MIDDLE)}
#: What follows what in an output: a sentinel, then the part (0 prefix, 1 middle, 2 suffix) behind it.
ARRANGEMENTS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
TEXT, MARK = 0, 1
#: Seed of the hash, share of documents that are transformed and share of those in suffix-first form, in percent.
SEED, RATE, SPM_RATE = 7, 100, 50


class Piece(NamedTuple):
    """``length`` bytes of a buffer from ``start`` on."""

    buffer: int
    start: int
    length: int


class Cut(NamedTuple):
    """A document's descriptors after cutting and arranging, with the numbers that the cut was made by."""

    units: int
    form: str
    prefix: int | None
    middle: int | None
    pieces: list[Piece]


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors of the first ``at`` bytes and those of the rest."""
    left: list[Piece] = []
    for i, p in enumerate(pieces):
        if at < p.length:
            if at:
                left.append(p._replace(length=at))
            return left, [Piece(p.buffer, p.start + at, p.length - at), *pieces[i + 1:]]
        left.append(p)
        at -= p.length
    return left, []


def arrange(parts: tuple[list[Piece], ...], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    out: list[Piece] = []
    for mark, part in ARRANGEMENTS[form]:
        out += [Piece(MARK, *_PLACE[mark]), *parts[part]]
    return out


def stream(pieces: list[Piece], text: memoryview) -> Iterator[memoryview]:
    """The bytes of the descriptors, piece by piece, without a copy."""
    buffers = (text, memoryview(SENTINELS))
    for p in pieces:
        yield buffers[p.buffer][p.start:p.start + p.length]


def sha256(parts: Iterator[memoryview]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _ends(text: memoryview) -> np.ndarray:
    """Byte offset behind every unit."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def _chars(text: memoryview, start: int, end: int) -> int:
    """Code points in a byte range that starts and ends between code points."""
    return int(np.count_nonzero(np.frombuffer(text[start:end], dtype=np.int8) >= -64))


def numbers(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers drawn for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut(doc_id: int | None, text: memoryview, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Cut:
    """The arranged piece table of one document."""
    whole = [Piece(TEXT, 0, len(text))]
    if not len(text):
        return Cut(0, "plain", None, None, [])
    ends = _ends(text)
    n = len(ends)
    h1, h2, h3, h4 = numbers(doc_id, seed)
    raw = bytes(text)
    if h3 % 100 >= rate or any(p.encode() in raw for p in _PLACE):
        return Cut(n, "plain", None, None, whole)
    offset = [0, *(int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))]
    prefix, rest = split(whole, offset[1])
    middle, suffix = split(rest, offset[2] - offset[1])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return Cut(n, form, _chars(text, 0, offset[1]), _chars(text, offset[1], offset[2]), arrange((prefix, middle, suffix), form))


def restore(output: bytes, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the original text: parts found by their sentinels, in inverse order."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    starts, at = [], 0
    for mark, _ in ARRANGEMENTS[form]:
        at = output.index(mark.encode(), at)
        starts.append((at, at + len(mark.encode())))
        at = starts[-1][1]
    ends = [s for s, _ in starts[1:]] + [len(output)]
    parts = {part: Piece(TEXT, start, end - start) for (_, part), (_, start), end in zip(ARRANGEMENTS[form], starts, ends)}
    return [parts[i] for i in sorted(parts)]


def _buffer(text: str | None) -> memoryview:
    return memoryview((text or "").encode("utf-8", "surrogatepass"))


def _row(doc_id: int | None, text: str | None) -> tuple:
    raw = _buffer(text)
    c = cut(doc_id, raw)
    output = b"".join(stream(c.pieces, raw))
    restored = restore(output, c.form)
    return doc_id, c.units, c.form, c.prefix, c.middle, sha256(stream(c.pieces, raw)), sha256(stream(restored, memoryview(output)))


def result(docs: DataFrame) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, and the hashes of the output and of the restored text."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"),
                       lambda ids, texts: [_row(d, t) for d, t in zip(ids, texts)],
                       "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def descriptors(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per document the arranged descriptors themselves (buffer ``text`` or ``sentinels``; byte offsets)."""
    def rows(ids: list, texts: list) -> list[tuple]:
        out = []
        for d, t in zip(ids, texts):
            c = cut(d, _buffer(t), seed, rate, spm_rate)
            out.append((d, c.form, [{"buffer": ("text", "sentinels")[p.buffer], "start": p.start, "length": p.length} for p in c.pieces]))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), rows,
                       "doc_id long, form string, pieces array<struct<buffer: string, start: long, length: long>>")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, form_column: str = "form") -> DataFrame:
    """``docs`` with the text replaced by its output and the form in a further column (underscores are put before a taken name)."""
    name, form = free_name(docs, "output"), free_name(docs, form_column)

    def rows(ids: list, texts: list) -> list[tuple]:
        out = []
        for d, t in zip(ids, texts):
            raw = _buffer(t)
            c = cut(d, raw, seed, rate, spm_rate)
            out.append((b"".join(stream(c.pieces, raw)).decode("utf-8", "surrogatepass"), c.form))
        return out

    out = add_columns(docs, ["doc_id", "text"], f"`{name}` string, `{form}` string", rows)
    return out.withColumn("text", F.col(name)).select(*[F.col(f"`{c}`") for c in docs.columns], form)


def untransform(rows: DataFrame, form_column: str = "form") -> DataFrame:
    """``rows`` of ``transform`` with their original texts (an originally null text comes back empty) and without the form."""
    name = free_name(rows, "restored")

    def texts(outputs: list, forms: list) -> list[tuple]:
        out = []
        for o, f in zip(outputs, forms):
            raw = (o or "").encode("utf-8", "surrogatepass")
            out.append((b"".join(stream(restore(raw, f or "plain"), memoryview(raw))).decode("utf-8", "surrogatepass"),))
        return out

    out = add_columns(rows, ["text", form_column], f"`{name}` string", texts)
    return out.withColumn("text", F.col(name)).select(*[F.col(f"`{c}`") for c in rows.columns if c != form_column])


#: The contract columns in SQL: lines by their feeds, cuts by joining lists of lines.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4,
         string_split(t, chr(10)) AS parts, length(t) - length(replace(t, chr(10), '')) AS feeds
  FROM d
), l AS (
  SELECT doc_id, t, h1, h2, h3, h4, CASE WHEN t = '' THEN 0 WHEN suffix(t, chr(10)) THEN feeds ELSE feeds + 1 END AS n,
         CASE WHEN t = '' THEN []::VARCHAR[]
              ELSE list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i <= feeds THEN chr(10) ELSE '' END) END AS units
  FROM u
), c AS (
  SELECT doc_id, t, n, units, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS pre,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:], ''), '') AS suf
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
