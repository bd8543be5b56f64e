"""Language identification by averaged subword embeddings.

A text's hashed subwords (character n-grams) have embeddings; their average goes through a
linear softmax. Both are trained together by stochastic gradient descent on stretches of at
most ``most_rows`` labelled texts of at most MOST_BYTES each, in one task. One document in ten
is held back whole; these set the temperature that calibrates the scores of whole texts, and
the score below which a prediction is rejected. As all of it is linear, scoring needs one row
of the product of both matrices a subword. Scoring covers every whole text, however long.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashed_ngrams import buckets, folded
from tessera.llm.tables import decoded, lean, map_texts

ORDERS = range(1, 4)
BITS = 13
DIMENSIONS = 16
#: Bounds of the sample that is learned from.
MOST_ROWS = 2_000
MOST_BYTES = 50_000
#: One document in so many is held back.
HELD = 10
STRETCH = 240
EPOCHS = 4
#: A small sample is gone through more often, for so many steps.
LEAST_STEPS = 200
RATE = 40.0
SEED = 11
#: Of the predictions kept, this share shall be right on the rows held back.
PRECISION = 0.99
UNKNOWN = "und"
LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row for each bucket: its embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    least_score: float


def counts(text: str) -> np.ndarray:
    out = np.zeros(1 << BITS, np.float32)
    for b in buckets(text, ORDERS, BITS):
        out += np.bincount(b, minlength=1 << BITS)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[bytes], langs: list[str]) -> Model:
    names = sorted(set(langs))
    size, k = 1 << BITS, max(1, len(names))
    if not names:
        return Model([], np.zeros((size, 1), np.float32), np.zeros(1), 1.0, 0.0)
    random = np.random.default_rng(SEED)
    held = set(random.permutation(len(texts))[: len(texts) // HELD].tolist())
    parts, of = [], []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        if i in held:
            continue
        whole = folded(text)
        for at in range(0, len(whole), STRETCH):
            if len(whole) - at >= 40 or not at:
                parts.append(whole[at : at + STRETCH])
                of.append(names.index(lang))
    y, rest = np.array(of), np.arange(len(parts))
    mean = lambda some: (x := np.stack([counts(s) for s in some])) / np.maximum(1, x.sum(1, keepdims=True))
    embedding = random.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    weights, bias = random.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    batches = max(1, len(rest) // 128)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps = epochs * batches
    step = 0
    for _ in range(epochs):
        for at in np.array_split(random.permutation(rest), batches):
            if not len(at):
                continue
            rate = RATE * (1 - step / (steps + 1))
            x = mean([parts[i] for i in at])
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            slope = error @ weights.T
            weights -= 0.1 * rate * hidden.T @ error
            bias -= 0.01 * rate * error.sum(0)
            embedding -= rate * x.T @ slope
            step += 1
    table = embedding @ weights
    temperature, least = 1.0, 0.0
    if held:
        known = np.array([names.index(langs[i]) for i in sorted(held)])
        z = np.concatenate([mean([folded(texts[i])]) @ table + bias for i in sorted(held)])
        temperature, least = calibrated(z, known)
    return Model(names, table.astype(np.float32), bias, temperature, least)


def calibrated(z: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    """The temperature at which the right languages are likeliest, and the least score at which
    PRECISION of the predictions from it on are right (1 if none is)."""
    right = np.arange(len(known)), known
    temperature = min((-np.log(softmax(z / t)[right] + 1e-12).mean(), t) for t in np.geomspace(0.05, 20, 60))[1]
    p = softmax(z / temperature)
    best, hit = p.max(1), p.argmax(1) == known
    down = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(hit[down]) / np.arange(1, len(down) + 1) >= PRECISION)
    return float(temperature), float(best[down][good[-1]]) if len(good) else 1.0


def train(docs: DataFrame, usable: Column, key: str = "doc_id", lang: str = "lang", text: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """Fits on the rows that have a language and for which ``usable`` holds, the
    ``most_rows`` first by hash of the key; a key with several rows counts once. Null texts and
    those of more than MOST_BYTES are left out. Without any, all texts stay unknown."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & usable & (F.octet_length(F.col(text).cast("binary")) <= MOST_BYTES))
    ids = rows.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most_rows)
    sample = rows.select(key, F.struct(lang, F.col(text).cast("binary").alias("_text")).alias("_row")).join(F.broadcast(ids), key)
    sample = sample.groupBy(key).agg(F.min("_row").alias("_row")).select(key, F.col(f"_row.{lang}").alias("_lang"), "_row._text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(r[0], r[2], r[1]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([r[1] for r in found], [r[2] for r in found]))]})

    out = sample.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(out[0].model) if out else fit([], [])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred, score (the calibrated probability) and accepted (whether the
    score reaches the rejection threshold). Texts that are null or have no letter, and all
    texts if no language was learned, are ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def of(raw: bytes) -> tuple:
            if not m.languages or not (LETTER.search(raw) or any(map(str.isalpha, decoded(raw)))):
                return UNKNOWN, 0.0, False
            x = counts(folded(raw))
            p = softmax((x @ m.table / max(1.0, float(x.sum())) + m.bias) / m.temperature)
            best = int(p.argmax())
            return m.languages[best], min(1.0, float(p[best])), bool(p[best] >= m.least_score)

        return of

    return map_texts(docs, keep, [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("accepted", pa.bool_())], start, text)
