"""Personal data with offset-preserving deobfuscation.

The base patterns run on the text as it is.  Transducers then rewrite
look-alike letters and digits, invisible characters, spelled digits and
``(at)``/``dot`` disguises into plain text while they record which source
characters every output character came from; the same patterns run on the
output and their spans are mapped back.  A span that a base span of its kind
covers wholly is not added; a wider one stands beside the base span.

Defined results: null or empty text has no spans; repeated rows get one result
each; an empty table gives an empty result.  Extra columns are ignored.
Offsets are code points, end exclusive.  Matching is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cover, covered, map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like ASCII letters.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТХЅІЈаеорсухѕіјԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοаｅɑɡıΙѵ∙․。．＠﹫﹒",
    "ABEKMHOPCTXSIJaeopcyxsijdqwhABEZHIKMNOPTYXoaeagiIv....@@."))
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
           "seven": "7", "eight": "8", "nine": "9"}
_INVISIBLE = frozenset("­​‌‍⁠﻿")
#: Domain endings after a plain or blank-framed dot, where a sentence may end too: no everyday words.
ENDINGS = ("com|net|org|edu|gov|mil|int|info|biz|name|app|dev|io|ac|ad|ae|af|ag|ai|al|ao|ar|au|aw|az|ba|bb|bd|bg|bh|bm|bn|bo|br|bs|bt|"
           "bw|bz|ca|cc|cd|cf|cg|ch|ci|ck|cl|cm|cn|co|cr|cu|cv|cw|cy|cz|de|dj|dk|dm|dz|ec|ee|eg|es|eu|fi|fj|fm|fo|fr|ga|gd|ge|gg|gh|gi|"
           "gl|gm|gn|gp|gq|gr|gt|gu|gy|hk|hn|hr|ht|hu|ie|il|im|iq|ir|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kr|kw|ky|kz|lb|lc|li|lk|lr|ls|lt|lu|"
           "lv|ly|mc|md|mg|mh|mk|ml|mm|mn|mo|mp|mq|mr|mt|mu|mv|mw|mx|mz|nc|ne|nf|ng|ni|nl|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|"
           "ps|pt|pw|py|qa|re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|si|sk|sl|sm|sn|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|tr|tt|"
           "tv|tw|tz|ua|ug|uk|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw")
#: Words before or after a bare "dot" that show it to be the noun, unless a listed ending follows.
_NOUN = "(?:the|a|an|this|that|each|every|any|some|no|his|her|its|my|your|our|their)"
_ANY_ENDING = "[A-Za-z]{2,24}(?![A-Za-z0-9])"
_LABEL = "[A-Za-z0-9-]{1,63}"
_BRACKET_DOT = r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?"
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + "|[0-9])"
_TOKEN = "(?:" + "|".join(SPELLED) + "|[0-9]++)"
_OCTET = rf"(?:[0-9]++|{_DIGIT_WORD}(?:[\x20-]{{1,3}}{_DIGIT_WORD}){{0,2}})"
_REWRITE = re.compile(
    rf"(?P<quad>\b{_OCTET}(?:(?:\x20dot\x20|\.|{_BRACKET_DOT}){_OCTET}){{3}}(?![A-Za-z0-9]))"
    rf"|(?P<spelled>\b(?:plus[\x20-]+)?{_DIGIT_WORD}(?:[\x20-]{{1,3}}{_DIGIT_WORD}){{6,}}(?![A-Za-z0-9]))"
    rf"|(?P<mixed>\b(?:plus[\x20-]+)?{_TOKEN}(?:[\x20-]{{1,3}}{_TOKEN})+(?![A-Za-z0-9]))"
    r"|(?P<at>\x20{0,2}(?:\[\x20?(?:at|@)\x20?\]|\(\x20?(?:at|@)\x20?\)|\{\x20?(?:at|@)\x20?\}|<\x20?(?:at|@)\x20?>)\x20{0,2})"
    r"|(?P<dot>\x20{0,2}(?:\[\x20?(?:dot|\.)\x20?\]|\(\x20?(?:dot|\.)\x20?\)|\{\x20?(?:dot|\.)\x20?\}|<\x20?(?:dot|\.)\x20?>)\x20{0,2})"
    rf"|(?P<plain>\x20(?:at|@)\x20(?={_LABEL}(?:(?:\x20?\.\x20?|\x20dot\x20|{_BRACKET_DOT}){_LABEL}){{0,3}}"
    rf"(?:(?:\x20?\.|\x20dot\x20)(?:{ENDINGS})\b|{_BRACKET_DOT}{_ANY_ENDING})"
    rf"|(?!{_NOUN}\x20dot\x20){_LABEL}(?:(?:\.|\x20dot\x20|{_BRACKET_DOT}){_LABEL}){{0,3}}\x20dot\x20{_ANY_ENDING}))"
    rf"|(?P<sep>(?<=[A-Za-z0-9])\x20dot\x20(?=(?:{_LABEL}\x20dot\x20){{0,3}}(?:(?:{ENDINGS})\b|[0-9]|(?!{_NOUN}\b){_ANY_ENDING})))"
    rf"|(?P<blank>(?<=[A-Za-z0-9])\x20\.\x20(?=(?:{ENDINGS})\b))", re.I | re.A)
_ANY_SPELLED = re.compile("|".join(SPELLED), re.I | re.A)
_DOTS = re.compile(rf"\x20dot\x20|\.|{_BRACKET_DOT}", re.I | re.A)
_WORDS = "(?:" + "|".join(SPELLED) + ")"
#: What a match must hold, for lower-case text. One of these marks: quad, at, dot, plain, sep and blank with a bracket, a "dot",
#: a lone "@" or a lone point ...
_MARKS = tuple(a + b + c for a in "[({<" for b in ("", " ") for c in ("at", "@", ".")) + ("dot", " @ ", " . ")
#: ... or "at", a label and a point or bracket: plain; or a spelled digit beside another digit or a point: quad, spelled and mixed.
_NEAR = (re.compile(r"\x20at\x20[a-z0-9-]{1,63}\x20?[.\[({<]"),
         re.compile(rf"{_WORDS}(?:[\x20-]{{1,3}}(?:{_WORDS}|[0-9])|\.[a-z0-9])|[0-9](?:[\x20-]{{1,3}}|\.){_WORDS}"))
_PARTS = re.compile(r"(?P<word>[A-Za-z]+)|(?P<digit>[0-9])|(?P<gap>[\x20-]+)")
_NON_LATIN1 = re.compile("[^\x00-\xff]|\xad")


def _emails(text: str) -> list[Span]:
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            spans.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    return spans


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed, then start."""
    spans = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text)
                      if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return spans


def _plain(c: str) -> str:
    """One source character as the detector should see it ('' for invisible ones)."""
    if c <= "\xff":
        return "" if c == "\xad" else c
    if c in _INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    if "\U0001d400" <= c <= "\U0001d7ff":
        folded = unicodedata.normalize("NFKC", c)
        return folded if len(folded) == 1 and folded.isascii() else c
    return c


def _fold(text: str) -> tuple[str, list[int]]:
    """Look-alike transducer: output and, per output character, its source offset."""
    out, src = [], []
    for i, c in enumerate(text):
        p = _plain(c)
        if p:
            out.append(p)
            src.append(i)
    return "".join(out), src


def _spelled(match: str) -> str:
    digits = [SPELLED.get(w.lower(), w) for w in re.split(r"[\x20-]+", match)]
    return "".join("+" if w.lower() == "plus" else w for w in digits)


def _mixed(match: str, at: int) -> Iterator[tuple[str, tuple[int, int]]]:
    """Digits of a run of digits and spelled digits, one by one, and one blank or hyphen for each gap."""
    plus = False
    for m in _PARTS.finditer(match):
        word = m[0].lower()
        if not (plus and m.lastgroup == "gap"):
            yield "+" if word == "plus" else SPELLED.get(word, word)[0], (at + m.start(), at + m.end())
        plus = word == "plus"


def _rewrite(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """Disguise transducer: output and, per output character, its source range (None: nothing was rewritten)."""
    out: list[str] = []
    src: list[tuple[int, int]] = []
    done = 0
    for m in _REWRITE.finditer(text):
        a, b = m.span()
        kind = m.lastgroup
        if kind in ("spelled", "mixed") and not _ANY_SPELLED.search(m[0]):
            continue
        if kind == "quad" and not re.search("[^0-9.]", m[0]):
            continue
        out.append(text[done:a])
        src += [(i, i + 1) for i in range(done, a)]
        done = b
        if kind == "mixed":
            for new, where in _mixed(m[0], a):
                out.append(new)
                src.append(where)
            continue
        if kind == "quad":
            new = ".".join(_spelled(x) for x in _DOTS.split(m[0]))
        elif kind == "spelled":
            new = _spelled(m[0])
        else:
            new = "@" if kind in ("at", "plain") else "."
        out.append(new)
        src += [(a, b)] * len(new)
    if not out:
        return text, None
    out.append(text[done:])
    src += [(i, i + 1) for i in range(done, len(text))]
    return "".join(out), src


def _disguised(text: str) -> bool:
    """Cheap necessary condition for a rewriting, from every alternative of ``_REWRITE``."""
    low = text.lower()
    return any(x in low for x in _MARKS) or any(x.search(low) for x in _NEAR)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) as (start, end, kind) in source code points."""
    if not text:
        return [], []
    base = detect(text)
    folded, back = text, None
    if not text.isascii() and _NON_LATIN1.search(text):
        folded, back = _fold(text)
    plain, ranges = _rewrite(folded) if _disguised(folded) else (folded, None)
    if ranges is None:
        if back is None:
            return base, []
        ranges = [(i, i + 1) for i in range(len(folded))]
    added: list[Span] = []
    for a, b, kind in detect(plain):
        start, end = ranges[a][0], ranges[b - 1][1]
        if plain[a:b] == folded[start:end] and back is None:
            continue                           # read from unchanged text: base decides
        start, end = (start, end) if back is None else (back[start], back[end - 1] + 1)
        if kind == "email":                    # a neighbouring disguise may have lent its blanks
            while text[start].isspace():
                start += 1
            while text[end - 1].isspace():
                end -= 1
        added.append((start, end, kind))
    known = {kind: cover([(a, b) for a, b, k in base if k == kind]) for kind in KINDS}
    return base, [s for s in added if not covered(s[:2], *known[s[2]])]


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def digest(text: str | None) -> tuple:
    base, added = find(text)
    count = [sum(k == kind for _, _, k in base) for kind in KINDS]
    return *count, hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + added)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, a hash of the base spans and all spans."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"),
                       lambda ids, texts: [(d, *digest(t)) for d, t in zip(ids, texts)],
                       "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
