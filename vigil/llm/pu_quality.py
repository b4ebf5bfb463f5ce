"""Quality classifier from positive and unlabelled texts.

Trusted positives are a bounded sample of the labelled good rows; the
unlabelled side is every document.  The scorer is linear in class-bigram,
hashed word and shape features with the squared loss, so the whole
positive-unlabelled risk depends on the data only through second moments, which
one pass over all rows sums exactly.  The class prior is estimated from the same
moments by Pearson-divergence matching, and the non-negative unbiased risk is
minimised on the driver over a few hundred weights.

    risk(g) = prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),   l(z) = (1 - z)^2 / 4

The minimiser estimates 2 p(good | text) - 1, so the score is (1 + g) / 2.

Defined results: null and empty texts are scored like a text without words;
repeated rows count and are scored each; without trusted positives every score
is 0.5; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _schemas, _to_batch, map_batches, window_hashes, word_hashes

#: Bound on the trusted positives.
MAX_POSITIVES = 20_000
#: Score from which a text is predicted good.
GOOD_AT = 0.3
FOLDS = 5
CLASSES, WORD_SLOTS, SHAPES = 16, 48, 6
DIM = CLASSES * CLASSES + WORD_SLOTS + SHAPES + 1
_CHUNK = 1 << 20


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters, digits, blanks, stops, symbols one by one, the rest."""
    c = np.full(256, 14, dtype=np.uint16)
    for k, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",",
                               "!?;:'\"()-", "#", "*", "$", "%", "&", "|")):
        c[list(group.encode())] = k
    c[128:] = 15
    return c


_CLASS = _byte_classes()
_LINE = re.compile(rb"[^\n]*\S[^\n]*")


def features(text: str | None) -> np.ndarray:
    """Square roots of class-bigram and hashed word shares, shape ratios and a constant."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(DIM)
    size = CLASSES * CLASSES
    for at in range(0, max(len(raw) - 1, 0), _CHUNK):
        c = _CLASS[np.frombuffer(raw[at:at + _CHUNK + 1], dtype=np.uint8)]
        x[:size] += np.bincount(c[:-1] * np.uint16(CLASSES) + c[1:], minlength=size)
    words = word_hashes(raw)
    n = len(words)
    x[size:size + WORD_SLOTS] = np.bincount((words % U64(WORD_SLOTS)).astype(np.int64), minlength=WORD_SLOTS)
    x[:size] = np.sqrt(x[:size] / max(1, len(raw) - 1))
    x[size:size + WORD_SLOTS] = np.sqrt(x[size:size + WORD_SLOTS] / max(1, n))
    windows = window_hashes(words, 3)
    lines = _LINE.findall(raw)
    x[size + WORD_SLOTS:] = (
        len(np.unique(words)) / n if n else 1.0,
        1 - len(np.unique(windows)) / len(windows) if len(windows) else 0.0,
        np.count_nonzero(words[1:] == words[:-1]) / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        np.log1p(n) / 10,
        1 / (1 + n / 20),
        1.0)
    return x


@dataclass
class Moments:
    """Counts, means and second moments of the unlabelled and the positive side."""
    n_u: float
    n_p: float
    s_u: np.ndarray
    s_p: np.ndarray

    @property
    def m_u(self) -> np.ndarray:
        return self.s_u[:, -1]                  # the last feature is constant 1

    @property
    def m_p(self) -> np.ndarray:
        return self.s_p[:, -1]


def positives(labels: DataFrame, max_rows: int = MAX_POSITIVES) -> list[int]:
    """Ids of at most ``max_rows`` good labelled rows outside the held-out fold, by a hash of the id."""
    good = (labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
            .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1"))
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id").collect()]


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


def moments(docs: DataFrame, trusted: list[int]) -> Moments | None:
    """Sums over all rows of ``docs``; rows with a trusted id also count as positives."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(frozenset(trusted))
    out, arrow = _schemas(spark, "slot long, sums binary")
    shape = (2, DIM, DIM)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(shape), ids.value
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, len(doc_ids), 500):
                x = np.stack([features(t) for t in batch.column(1).slice(at, 500).to_pylist()])
                total[0] += x.T @ x
                p = x[[d in good for d in doc_ids[at:at + 500]]]
                total[1] += p.T @ p
        yield _to_batch([(0, total.tobytes())], arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for v in batch.column(1):
                total += np.frombuffer(v.as_buffer()).reshape(shape)
        yield _to_batch([(0, total.tobytes())], arrow)

    sums = docs.select("doc_id", "text").mapInArrow(first, out)
    parts = docs.rdd.getNumPartitions()
    while parts > 16:                           # sixteen sums a task, until few are left
        parts = -(-parts // 16)
        sums = sums.repartition(parts).mapInArrow(add, out)
    total = sum(np.frombuffer(r.sums).reshape(shape) for r in sums.select("sums").toLocalIterator())
    if not np.ndim(total) or not total[1, -1, -1]:
        return None
    n_u, n_p = total[:, -1, -1]
    return Moments(n_u, n_p, total[0] / n_u, total[1] / n_p)


def estimate_prior(m: Moments, ridge: float = 1e-4) -> float:
    """Class prior by Pearson-divergence matching: 1 / (h' G^-1 h) with h = E_P[x], G = E_U[xx']."""
    scale = np.sqrt(np.diag(m.s_u)) + 1e-6
    g = m.s_u / np.outer(scale, scale) + ridge * np.eye(DIM)
    h = m.m_p / scale
    return float(np.clip(1 / (h @ np.linalg.solve(g, h)), 0.01, 0.99))


def fit(m: Moments, prior: float, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Minimise the non-negative risk by preconditioned gradient steps.

    Where the unlabelled part is negative, the step raises it instead.
    """
    scale = np.sqrt(np.diag(m.s_u)) + 1e-6
    s_u, s_p = m.s_u / np.outer(scale, scale), m.s_p / np.outer(scale, scale)
    m_u, m_p = m.m_u / scale, m.m_p / scale
    inverse = np.linalg.inv(s_u / 2 + 2 * ridge * np.eye(DIM))
    w = np.zeros(DIM)

    def loss(s, mean, sign):                    # E[(1 - sign * g)^2] / 4
        return (1 - 2 * sign * (w @ mean) + w @ s @ w) / 4

    def slope(s, mean, sign):
        return (s @ w - sign * mean) / 2

    for _ in range(steps):
        unlabelled = loss(s_u, m_u, -1) - prior * loss(s_p, m_p, -1)
        rest = slope(s_u, m_u, -1) - prior * slope(s_p, m_p, -1)
        grad = prior * slope(s_p, m_p, 1) + rest if unlabelled >= 0 else -0.1 * rest
        step = inverse @ (grad + 2 * ridge * w)
        w = w - 0.5 * step
        if unlabelled >= 0 and np.abs(step).max() < 1e-9:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES) -> tuple[np.ndarray, float] | None:
    """(weights, estimated class prior), or None without trusted positives."""
    trusted = positives(labels, max_positives)
    m = moments(docs, trusted) if trusted else None
    if m is None:
        return None
    prior = estimate_prior(m)
    return fit(m, prior), prior


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    def rows(ids: list, texts: list) -> list[tuple]:
        out = []
        for d, t in zip(ids, texts):
            s = 0.5 if model is None else float(np.clip((1 + features(t) @ model[0]) / 2, 0, 1))
            out.append((d, s, int(s >= GOOD_AT)))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, score double, predicted int")


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
