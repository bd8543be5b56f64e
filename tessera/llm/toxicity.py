"""Toxicity by a linear classifier on character n-grams with naive Bayes weights.

A text's features are the buckets of its n-grams, each counted once and scaled by the
bucket's log-count ratio: how much more often toxic than other texts have it. A logistic
regression is trained on the scaled features. It is fitted in one task on at most
``most_rows`` labelled texts of at most MOST_BYTES each, the first by hash; scoring then
covers every whole text, however long, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashed_ngrams import buckets, folded, sigmoid
from tessera.llm.tables import lean, map_texts

ORDERS = range(3, 6)
BITS = 20
#: Bounds of the sample that is learned from.
MOST_ROWS = 4_000
MOST_BYTES = 50_000
THRESHOLD = 0.3
SMOOTHING = 1.0
EPOCHS = 12
RATE = 0.15
SHRINK = 1e-4
SEED = 7


@dataclass
class Model:
    """Score of a text: sigmoid of bias plus the weights of its buckets."""

    weights: np.ndarray
    bias: float

    def __reduce__(self):
        return Model.of, (self.weights.astype(np.float32).tobytes(), self.bias)

    @staticmethod
    def of(weights: bytes, bias: float) -> Model:
        return Model(np.frombuffer(weights, np.float32), bias)


def features(raw: bytes, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text. ``seen`` is all false before and after."""
    found = [np.zeros(0, np.int32)]
    for some in buckets(folded(raw), ORDERS, BITS):
        new = np.unique(some[~seen[some]])
        seen[new] = True
        found.append(new)
    out = np.concatenate(found)
    seen[out] = False
    return out


def log_count_ratios(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """For each bucket the logarithm of how much larger its share of toxic texts is than that
    of others, smoothed; 0 for buckets of fewer than two texts."""
    have = np.zeros((2, 1 << BITS), np.float32)
    for y, row in zip(toxic, rows, strict=True):
        have[y, row] += 1
    ratio = np.log((have[1] + SMOOTHING) / (toxic.sum() + 2 * SMOOTHING)) - np.log((have[0] + SMOOTHING) / (len(rows) - toxic.sum() + 2 * SMOOTHING))
    ratio[have.sum(0) < 2] = 0
    return ratio


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """One class alone, or no rows, give a constant: the share of toxic rows, or 0."""
    size, n = 1 << BITS, len(texts)
    share = float(toxic.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(size, np.float32), 30.0 if share else -30.0)
    seen = np.zeros(size, bool)
    rows = [features(t, seen) for t in texts]
    ratio = log_count_ratios(rows, toxic)
    for i, row in enumerate(rows):
        rows[i] = row[np.abs(ratio[row]) > 0.5]
    weights, bias, squares = np.zeros(size, np.float32), 0.0, np.full(size, 1e-2, np.float32)
    random = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        for batch in np.array_split(random.permutation(n), max(1, n // 64)):
            at = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = np.bincount(of, weights[at] * ratio[at], len(batch)) + bias
            error = sigmoid(z) - toxic[batch]
            where, inverse = np.unique(at, return_inverse=True)
            slope = np.bincount(inverse, error[of], len(where)) / len(batch) * ratio[where] + SHRINK * weights[where]
            squares[where] += slope**2
            weights[where] -= RATE * slope / np.sqrt(squares[where])
            bias -= RATE * float(error.mean())
    return Model((weights * ratio).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", label: str = "toxic", text: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """Fits on the rows of ``labels`` for which ``usable`` holds, ``most_rows`` at most.
    Null labels and texts of more than MOST_BYTES are left out; a key with several labels counts
    once, with the largest, and one with several texts with the first of them."""
    import pickle

    ids = labels.where(F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64(key), key).limit(most_rows)
    texts = docs.select(key, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text")).where(F.octet_length("_text") <= MOST_BYTES)
    sample = texts.join(F.broadcast(ids), key).groupBy(key).agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r[0], r[1], r[2]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        model = fit([r[2] for r in rows], np.array([int(r[1] > 0) for r in rows], np.int64))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    found = sample.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([], np.zeros(0))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, score and predicted for every row. Null and empty texts have the score of a
    text without n-grams that were seen in training."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m, seen = shared.value, np.zeros(1 << BITS, bool)

        def of(raw: bytes) -> tuple:
            p = float(sigmoid(np.float64(m.bias + m.weights[features(raw, seen)].sum(dtype=np.float64))))
            return p, int(p >= threshold)

        return of

    return map_texts(docs, keep, [pa.field("score", pa.float64()), pa.field("predicted", pa.int32())], start, text)


def fold(key: str, parts: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % parts
