"""Secret scans: fixed patterns plus a password guess-cost dynamic program.

Base patterns find assignments, access keys and long hexadecimal runs.  Values
that stand in a credential context (``password is ...``, ``pwd: ...``) are
segmented at minimum guess cost into common words, word-like runs, dates,
repeats, keyboard walks and brute-force spans; a value whose cost reaches the
threshold is a secret of kind ``password``.

A value that a base span holds wholly is no span of its own; one that reaches
beyond it stands beside it.

Defined results: null or empty text has no spans; repeated rows get one result
each; an empty table gives an empty result.  Extra columns are ignored by
``scan`` and kept by ``redact``.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cover, covered, free_name, map_batches

KINDS = ("assign", "access", "hex", "password")
#: log10 of the guesses from which a credential value counts as a secret.
MIN_LOG10_GUESSES = 8.0
#: Longest segment but for repeats, which may be of any length: the longest keyboard row.
MAX_SEGMENT = 26
PLACEHOLDER = "[secret]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|credentials?|(?:api|access|private|secret)[\x20_-]?key)"""
    r"""["']?(?:\x20{0,3}(?::=|=>|->|[:=])|\x20{1,3}(?:is|was)\b:?)\x20{0,3}["'`]?([^\s"'`<>]{6,})""", re.I | re.A)
_HINTS = (b"passw", b"secret", b"token", b"key", b"pass", b"pwd", b"credential")
_HEX_MAP = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x2E for c in range(256))
_HEX_RUN = b"h" * 32

#: Words common in passwords and placeholders, most common first.
COMMON_WORDS = (
    "password", "qwerty", "letmein", "admin", "welcome", "monkey", "dragon", "master", "login", "princess",
    "football", "baseball", "sunshine", "shadow", "superman", "iloveyou", "trustno", "hello", "freedom", "whatever",
    "secret", "summer", "winter", "spring", "autumn", "changeme", "default", "guest", "root", "test",
    "user", "access", "hunter", "batman", "killer", "pepper", "charlie", "michael", "jordan", "computer",
    "internet", "example", "sample", "placeholder", "required", "optional", "hidden", "none", "null", "undefined",
    "your", "here", "the", "and", "for", "is", "my", "pass", "word", "key",
    "token", "value", "string", "unknown", "expired", "invalid", "incorrect", "correct", "wrong", "missing",
)
#: Rows of the keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
_WALKS = tuple(r for row in KEY_ROWS for r in (row, row[::-1]))
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_LEET = str.maketrans("013457@$!", "oieastasi")
_VOWELS = frozenset("aeiouyáéíóúàèìòùâêîôûäöü")


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else math.log10(100)


def _case_cost(segment: str) -> float:
    """Guesses for the capitalisation: free, one of three usual forms, or any subset."""
    upper = sum(c.isupper() for c in segment)
    if not upper:
        return 0.0
    if segment[1:].islower() or segment.isupper():
        return math.log10(3)
    return math.log10(sum(math.comb(len(segment), k) for k in range(1, upper + 1)))


def _wordlike(segment: str) -> bool:
    if not segment.isalpha() or len(segment) < 4 or not (segment.islower() or segment.istitle()):
        return False
    low = segment.lower()
    vowels = sum(c in _VOWELS for c in low)
    run = longest = 0
    for c in low:
        run = 0 if c in _VOWELS else run + 1
        longest = max(longest, run)
    return 0.2 <= vowels / len(low) <= 0.8 and longest <= 5


@lru_cache(maxsize=1 << 16)
def segment_cost(segment: str, previous: str) -> float | None:
    """log10 guesses of one segment by the cheapest pattern it fits, None if it fits none."""
    low, n, best = segment.lower(), len(segment), None

    def offer(x: float) -> None:
        nonlocal best
        best = x if best is None or x < best else best

    for form, extra in ((low, 0.0), (low.translate(_LEET), math.log10(2) * (low != low.translate(_LEET)))):
        if form in _RANK:
            offer(math.log10(_RANK[form]) + _case_cost(segment) + extra)
    if _wordlike(segment):
        offer(5.0 + _case_cost(segment))
    if _DATE.fullmatch(segment):
        offer(math.log10(120 * (366 if n > 4 else 1)))
    for size in range(1, n // 2 + 1):
        if n % size == 0 and segment[:size] * (n // size) == segment:
            offer(sum(map(_brute, segment[:size])) + math.log10(n // size))
    if n >= 3 and any(low in row for row in _WALKS):
        offer(math.log10(4 * 10 * n) + _case_cost(segment))
    if n >= 3 and previous.endswith(segment):
        offer(1.0)
    return best


class _Repeats:
    """Cheapest repeats of one unit of ``size`` characters, of any length, that end at the current position.

    A repeat takes its unit by brute force or, from three characters, copies what stands before it.
    """

    def __init__(self, size: int):
        self.size, self.run, self.starts = size, 0, {}

    def cost(self, value: str, end: int, best: list[float], brute: list[float]) -> float:
        size = self.size
        if end <= size or value[end - 1] != value[end - 1 - size]:
            self.run = 0
            self.starts.clear()
            return math.inf
        self.run += 1
        if self.run < size:
            return math.inf
        new = [(best[end - 2 * size] + brute[end] - brute[end - size], end - 2 * size)]
        if size >= 3:
            new.append((best[end - size] + 1.0, end - size))
        have, cheapest = [], math.inf
        for base, at in self.starts.get(end % size, []) + new:
            now = base + math.log10((end - at) // size)
            if now < cheapest - 1e-9:                # dearer than an earlier start: it stays so, as that one's count grows slower
                have, cheapest = [x for x in have if x[0] < base] + [(base, at)], now
        self.starts[end % size] = have
        return cheapest

    def below(self, enough: float) -> bool:
        return any(base < enough for have in self.starts.values() for base, _ in have)


def guess_cost(value: str, enough: float = math.inf) -> float:
    """Minimum log10 guesses over all segmentations; stops where every way to go on costs ``enough``."""
    n = len(value)
    best, brute = [0.0] + [math.inf] * n, [0.0] * (n + 1)
    repeats = [_Repeats(size) for size in range(1, MAX_SEGMENT + 1)]
    for end in range(1, n + 1):
        brute[end] = brute[end - 1] + _brute(value[end - 1])
        best[end] = best[end - 1] + _brute(value[end - 1])
        for start in range(max(0, end - MAX_SEGMENT), end - 1):
            cost = segment_cost(value[start:end], value[max(0, 2 * start - end):start])
            if cost is not None and best[start] + cost + 0.3 < best[end]:
                best[end] = best[start] + cost + 0.3      # 0.3: a factor of two for each more segment
        best[end] = min(best[end], min(r.cost(value, end, best, brute) for r in repeats) + 0.3)
        if best[end] >= enough:
            least = min(best[max(0, end - 2 * MAX_SEGMENT):end + 1])
            if least >= enough and not any(r.below(enough) for r in repeats):
                return least
    return best[n]


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    spans = []
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"key" in low:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def find(text: str | None, min_cost: float = MIN_LOG10_GUESSES) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) as (start, end, kind), each by start, then kind."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(base_spans(text, raw), key=order)
    added, known = [], cover([(a, b) for a, b, _ in base])
    low = raw.lower()
    if any(h in low for h in _HINTS):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            start, end = m.start(1), m.start(1) + len(value)
            if len(value) >= 6 and not covered((start, end), *known) and guess_cost(value, min_cost) >= min_cost:
                added.append((start, end, "password"))
    return base, added


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(text: str | None, min_cost: float = MIN_LOG10_GUESSES) -> tuple:
    base, added = find(text, min_cost)
    count = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
    return *count, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)


def scan(docs: DataFrame, min_cost: float = MIN_LOG10_GUESSES) -> DataFrame:
    """One row per document: base counts, a hash of the base spans and all spans."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"),
                       lambda ids, texts: [(d, *digest(t, min_cost)) for d, t in zip(ids, texts)],
                       "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, min_cost: float = MIN_LOG10_GUESSES) -> str | None:
    """The text with every secret (of an assignment, its value too) replaced by a placeholder."""
    base, added = find(text, min_cost)
    if not base and not added:
        return text
    out, done = [], 0
    for a, b, _ in sorted(base + added):
        if b <= done:
            continue
        out += [text[done:max(a, done)], PLACEHOLDER if a >= done else ""]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, min_cost: float = MIN_LOG10_GUESSES) -> DataFrame:
    """``docs`` with secrets redacted; ``n_chars``, where present, follows the text."""
    name = free_name(docs, "redacted")
    out = add_columns(docs, ["text"], f"{name} string", lambda texts: [(redacted(t, min_cost),) for t in texts])
    changed = ~F.col("text").eqNullSafe(F.col(name))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length(name).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(name)).select(*docs.columns)
