"""Quality rules: base text rules plus a calibrated hashed n-gram classifier.

The classifier is a logistic regression on hashed character 2–3-grams and
hashed word 1–2-grams (relative frequencies), with a few shape ratios.  It is
trained on a bounded sample of labelled rows, its scores are Platt-calibrated
on folds it was not fitted on, and documents are scored in Arrow batches
against a fixed threshold.

Defined results: null text has no words and fails the base rule; empty text
likewise; repeated rows get one result each; an empty table gives an empty
result; without usable labels the classifier keeps everything that passes the
base rule.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, U64, add_columns, free_name, map_batches, mix, trim, word_hashes

#: Hash slots per feature family.
SLOTS = 512
#: Families: character 2- and 3-grams, word 1- and 2-grams.
FAMILIES = 4
SHAPES = 3
DIM = FAMILIES * SLOTS + SHAPES
#: Bound on the labelled rows the classifier is fitted on.
MAX_LABELLED = 4000
#: Rows of the training sample that are weighed at a time.
FIT_ROWS = 256
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Calibrated probability of good quality from which a document is kept.
KEEP_AT = 0.5
_CHUNK = 1 << 20


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup, seen = 0, set()
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - spaces, symbols, dup, repeat_words(words)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by a window of ``size`` words that occurs twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    one = b"\x01" * size
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i:i + size] = one
            hit[j:j + size] = one
    return hit.count(1)


def _slots(raw: bytes, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(family, slot numbers): characters in chunks of a megabyte, then words."""
    mul, shift = np.uint32(2654435769), np.uint32(23)
    for at in range(0, max(len(raw) - 1, 0), _CHUNK):
        a = np.frombuffer(raw[at:at + _CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        bi = a[:-1] << np.uint32(8) | a[1:]
        tri = bi[:-1] << np.uint32(8) | a[2:]
        yield 0, (bi[:_CHUNK] + np.uint32(70001)) * mul >> shift
        yield 1, (tri[:_CHUNK] + np.uint32(13)) * mul >> shift
    yield 2, (words >> U64(55)).astype(np.int64)
    yield 3, (_pairs(words) >> U64(55)).astype(np.int64)


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * U64(3) + words[1:])


def _shapes(raw: bytes, words: np.ndarray) -> np.ndarray:
    """Distinct-word ratio, length and mean word length."""
    n = len(words)
    distinct = len(np.unique(words)) / n if n else 1.0
    return np.array([distinct, np.log1p(n) / 10, len(raw) / max(1, n) / 20])


def features(text: str | None) -> np.ndarray:
    """Dense feature row (training only)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(raw)
    x = np.zeros((FAMILIES, SLOTS))
    for family, s in _slots(raw, words):
        x[family] += np.bincount(s, minlength=SLOTS)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    return np.concatenate([x.ravel(), _shapes(raw, words)]).astype(np.float32)


@dataclass
class Model:
    """Linear weights on the features and the calibration line."""
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, raw: bytes, words: np.ndarray) -> float:
        table = self.weights[:FAMILIES * SLOTS].reshape(FAMILIES, SLOTS)
        total, count = [0.0] * FAMILIES, [0] * FAMILIES
        for family, s in _slots(raw, words):
            total[family] += float(table[family].take(s).sum())
            count[family] += len(s)
        return (self.bias + sum(t / max(1, n) for t, n in zip(total, count))
                + float(self.weights[FAMILIES * SLOTS:] @ _shapes(raw, words)))

    def probability(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = word_hashes(raw)
        z = self.slope * self.margin(raw, words) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient descent on standardised columns."""
    mean, std = x.mean(0), x.std(0)
    scale = 1 / np.sqrt(std ** 2 + 1e-8) * (std > 1e-7)
    z = x - mean
    z *= scale
    n, d = z.shape

    def weighed(g: np.ndarray) -> np.ndarray:
        """The rows' sum weighed by ``g``, in double precision a few rows at a time: a product of both would copy all of ``z``."""
        return sum(z[at:at + FIT_ROWS].T @ g[at:at + FIT_ROWS] for at in range(0, n, FIT_ROWS))

    v = np.random.RandomState(3).rand(d).astype(z.dtype)
    for _ in range(12):                       # largest eigenvalue by power iteration
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * float(np.linalg.norm(z @ v) ** 2) / n * 1.1 + ridge)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(d, dtype=z.dtype), float(np.log(rate / (1 - rate)))
    pw, pb = w.copy(), b
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        ew, eb = w + m * (w - pw), b + m * (b - pb)
        g = 1 / (1 + np.exp(-np.clip(z @ ew + eb, -30, 30))) - y
        pw, pb = w, b
        w = (ew - step * (weighed(g) / n + ridge * ew)).astype(z.dtype)
        b = eb - min(step, 4.0) * float(g.mean())
    w = w * scale
    return w, b - float(w @ mean)


def fit_calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([(p - t) @ margin, (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[q @ margin ** 2, q @ margin], [q @ margin, q.sum()]]) + np.eye(2) * 1e-6
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5 / (np.abs(d).max() + 1e-12))
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


def train_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows, chosen by a hash of the id.

    The sample is balanced: up to half of it from each label.  Its size is a
    parameter, so the id list can be broadcast.
    """
    lab = (labels.where("doc_id is not null and quality is not null")
           .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")))
    half = max_rows // 2
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = lab.where("y = 0").orderBy(*order).limit(half).union(lab.where("y <> 0").orderBy(*order).limit(max_rows - half))
    rows = [(r.doc_id, min(1, abs(r.y))) for r in pick.collect()]
    ids = docs.sparkSession.createDataFrame(rows, "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model | None:
    """Fit on the bounded labelled sample; None if it lacks one of the labels."""
    rows = map_batches(
        train_rows(docs, labels, max_rows),
        lambda ids, texts, ys: [(d, y, features(t).astype(np.float16).tobytes()) for d, t, y in zip(ids, texts, ys)],
        "doc_id long, y int, x binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("x", "ascending")])
    y = rows["y"].to_numpy().astype(np.float64)
    if y.min() == y.max():
        return None
    x = np.empty((len(y), DIM), dtype=np.float32)
    for i, row in enumerate(rows["x"]):
        x[i] = np.frombuffer(row.as_buffer(), dtype=np.float16)
    del rows
    fold = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for f in range(3):
        if len(set(y[fold != f])) < 2:
            return None
        w, b = fit_logistic(x[fold != f], y[fold != f])
        margin[fold == f] = x[fold == f] @ w + b
    slope, offset = fit_calibration(margin, y)
    w, b = fit_logistic(x, y)
    del x
    trim()                                   # the driver goes on to other steps
    return Model(w, b, slope, offset)


RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, probability double")


def verdict(text: str | None, model: Model | None, keep_at: float) -> tuple:
    """The columns of RESULT after doc_id for one text."""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    p = 1.0 if model is None else model.probability(text)
    return *counts, failed, not failed and p >= keep_at, p


def apply_rules(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: the base counts, the base rule, the calibrated probability and the verdict."""
    return map_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        lambda ids, texts: [(d, *verdict(t, model, keep_at)) for d, t in zip(ids, texts)], RESULT)


def keep_rows(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """Filter form: the rows of ``docs``, unchanged, whose verdict is kept."""
    flag = free_name(docs, "kept")
    judged = add_columns(docs, ["text"], f"{flag} boolean",
                         lambda texts: [(verdict(t, model, keep_at)[6],) for t in texts])
    return judged.where(F.col(flag)).drop(flag)
