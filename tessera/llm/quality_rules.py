"""Quality rules: counts a rule can state, and documents unlike the rest of their kind.

Base rules fail short documents and those that mostly repeat themselves. The others are
judged by a vector of four statistics, transformed so that they vary alike at any level: the
logarithm of the mean word length, and the angles arcsin(sqrt(share)) of symbols among
characters, of repeated lines among lines and of words in repeated windows among words.

Each language and source has its own centre and covariance, of minimum determinant over
half of the documents: from componentwise medians and deviations, steps of concentration
take the half nearest to the present estimate, until the estimates stay the same. They are then
taken again over all that is near (one reweighting), and a document goes if its Mahalanobis
distance is beyond what one in ten thousand of a normal distribution has. A group of few
documents has its language's estimate, a language of few that of all.

Everything is counted over all documents. Vectors are whole numbers of 1/UNITS, so equal ones
are counted once (cells) and sums are exact: in whatever order they are added, the estimates
are the same. A step needs the documents in order of distance, which no task sorts: distances
are counted by narrow ranges, and the half is made of the nearest whole ranges.

* Null, empty and wordless texts have counts of 0 and fail the base rules.
* Null lang or source are a language or source like others.
* Texts are taken whole, of any length; malformed UTF-8 counts as U+FFFD.
* Repeated rows and equal keys are rows like others; ties don't matter, as ranges are whole.
* An empty table gives no rows; where fewer than ``least`` documents pass the base rules, they
  are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import decoded, map_texts, scratch, shared_dir, stored

LEAST_WORDS = 50
#: Per cent of the words that may stand in repeated windows.
MOST_REPEATED = 50
SYMBOLS = b"#*$%&|<>"
UNITS = 64
#: Standard deviations that each statistic has at least, so that ordinary documents are no outliers
#: where most have no symbol, repeated line or repeated window at all.
FLOORS = (0.07, 0.05, 0.2, 0.2)
#: Documents that a group's own estimate takes.
LEAST_GROUP = 100
MOST_STEPS = 12
#: Of the chi-square distribution with four degrees of freedom: median, 97.5 and 99.99 per cent.
MEDIAN, NEAR, CUT = 3.357, 11.143, 23.513
#: Ranges of distance for each doubling of 1 + d².
RANGES = 16

V = [f"_v{i}" for i in range(4)]
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
SUMS = ["_n", *(f"_s{i}" for i in range(4)), *(f"_p{i}{j}" for i, j in PAIRS)]
ESTIMATE = ["_m0", "_m1", "_m2", "_m3", *(f"_a{i}{j}" for i, j in PAIRS)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LEVELS = ["_own", "_language", "_all"]


# Counting


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    last = {w: i for i, w in enumerate(words)}
    at = np.fromiter(map(last.__getitem__, words), np.int64, n)
    pair = at[:-2] * n + at[1:-1]
    if n >= 1 << 21:  # else three numbers below n fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair * n + at[2:]
    inorder = np.sort(window)
    twice = inorder[1:][inorder[1:] == inorder[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(window, twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def counts(raw: bytes) -> tuple[int, ...]:
    """The five counts and the number of lines with a word."""
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0
    chars = len(decoded(raw)) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def vector(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> tuple[int, ...]:
    """The four statistics in units; zeros without words."""
    if not n_words:
        return 0, 0, 0, 0
    shares = np.array([n_symbols / word_chars, n_dup_lines / n_lines, n_repeat_words / n_words])
    parts = [np.log(word_chars / n_words), *np.arcsin(np.sqrt(np.minimum(shares, 1)))]
    return tuple(int(x) for x in np.floor(np.array(parts) * UNITS + 0.5))


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the five counts, base_failed and the vector of every row."""

    def start():
        def of(raw: bytes) -> tuple:
            found = counts(raw)
            return *found[:5], *vector(*found)

        return of

    fields = [pa.field(c, pa.int64()) for c in [*COUNTS, *V]]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return map_texts(docs, keep, fields, start, text).withColumn("base_failed", failed)


# Estimating


def solved(sums: np.ndarray, floors: tuple[float, ...]) -> list[float]:
    """Centre and inverse covariance of exact sums."""
    n, s = sums[0], sums[1:5] / sums[0]
    spread = np.zeros((4, 4))
    for (i, j), p in zip(PAIRS, sums[5:], strict=True):
        spread[i, j] = spread[j, i] = p / n - s[i] * s[j]
    inverse = np.linalg.inv(spread + np.diag([(f * UNITS) ** 2 for f in floors]))
    return [*s, *(inverse[i, j] for i, j in PAIRS)]


def distance(at: list[str] = V, estimate: list[str] = ESTIMATE) -> Column:
    """The squared Mahalanobis distance of a row's vector from its row's estimate."""
    off = [F.col(v) - F.col(m) for v, m in zip(at, estimate, strict=False)]
    terms = [F.col(a) * off[i] * off[j] * (1 if i == j else 2) for (i, j), a in zip(PAIRS, estimate[4:], strict=True)]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def first_estimate(floors: tuple[float, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Medians and median deviations of one group's values, of which a row is one value of one
    component with its count."""

    def middle(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)])

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        centre, spread = [], []
        for i in range(4):
            mine = rows[rows["_of"] == i]
            v, n = mine["_v"].to_numpy(), mine["_n"].to_numpy()
            centre.append(middle(v, n))
            spread.append((1.4826 * middle(np.abs(v - centre[-1]), n)) ** 2 + (floors[i] * UNITS) ** 2)
        inverse = [1 / spread[i] if i == j else 0.0 for i, j in PAIRS]
        return pd.DataFrame([[rows["_key"].iloc[0], 0, 0, *centre, *inverse]], columns=["_key", "_within", "_sum", *ESTIMATE])

    return of


def next_estimate(floors: tuple[float, ...], half: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group's estimate from its sums by range of distance: over the nearest ranges that hold
    half of it, or over those that are near once distances are scaled by their median."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_range")
        upto = np.cumsum(rows["_n"].to_numpy())
        middle = int(np.searchsorted(upto, (upto[-1] + 1) // 2))
        last = middle
        if not half:
            upper = 2 ** ((rows["_range"].to_numpy() + 1) / RANGES) - 1
            last = max(middle, int(np.searchsorted(upper, NEAR * max(1.0, upper[middle] / MEDIAN), "right")) - 1)
        sums = rows[SUMS].to_numpy()[: last + 1].astype(object).sum(axis=0)
        mark = int(sums[1:].dot(np.arange(1, len(sums))) % (1 << 62))
        made = solved(np.array(sums, float), floors)
        return pd.DataFrame([[rows["_key"].iloc[0], int(sums[0]), mark, *made]], columns=["_key", "_within", "_sum", *ESTIMATE])

    return of


ESTIMATE_TYPE = "_key string, _within long, _sum long, " + ", ".join(f"{c} double" for c in ESTIMATE)


def by_range(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    """Exact counts and sums of each group's vectors by range of their distance."""
    placed = cells.join(estimates, "_key").withColumn("_range", F.floor(RANGES * F.log2(1 + distance())))
    parts = [F.col("_n"), *(F.col("_n") * F.col(v) for v in V), *(F.col("_n") * F.col(V[i]) * F.col(V[j]) for i, j in PAIRS)]
    return placed.groupBy("_key", "_range").agg(*(F.sum(p).alias(s) for p, s in zip(parts, SUMS, strict=True)))


def estimates_of(cells: DataFrame, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """For each _key of ``cells`` (_key, the vector, _n) its final estimate."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_of"), F.col(v).alias("_v")) for i, v in enumerate(V))))
    values = cells.select("_key", "_n", each.alias("_x")).groupBy("_key", "_x._of", "_x._v").agg(F.sum("_n").alias("_n"))
    now = stored(values.groupBy("_key").applyInPandas(first_estimate(floors), ESTIMATE_TYPE), "estimates")
    for _ in range(MOST_STEPS):
        then = now
        now = stored(by_range(cells, then).groupBy("_key").applyInPandas(next_estimate(floors, True), ESTIMATE_TYPE), "estimates")
        if not now.join(then.select("_key", "_within", "_sum"), ["_key", "_within", "_sum"], "left_anti").limit(1).count():
            break
    return stored(by_range(cells, now).groupBy("_key").applyInPandas(next_estimate(floors, False), ESTIMATE_TYPE), "estimates")


def level_keys(lang: str, source: str) -> list[Column]:
    """Texts that name a row's language and source, its language, and all; nulls have names too."""
    return [F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s"))), F.to_json(F.struct(F.col(lang).alias("l"), F.lit(True).alias("every"))), F.lit("")]


def judged(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", text: str = "text", floors: tuple[float, ...] = FLOORS, least: int = LEAST_GROUP, cut: float = CUT) -> DataFrame:
    """``keep``, the five counts, base_failed, distance (squared, null without an estimate) and
    kept, of every row. The counts are written to the shared folder once."""
    spark = docs.sparkSession
    kept = [f"_keep{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), level_keys(lang, source)[0].alias("_own"), level_keys(lang, source)[1].alias("_language"), F.col(text).alias("_said"))
    out = shared_dir(spark, "judged")
    with scratch(spark):
        rows = stored(counted(own, [*kept, "_own", "_language"], "_said"), "counted")
        cells = rows.where("not base_failed").groupBy("_own", "_language", *V).agg(F.count("*").alias("_n"))
        cells = stored(cells.withColumn("_all", F.lit("")), "cells")
        levels = cells.select(F.explode(F.array(*LEVELS)).alias("_key"), *V, "_n")
        levels = stored(levels.groupBy("_key", *V).agg(F.sum("_n").alias("_n")), "levels")
        sizes = levels.groupBy("_key").agg(F.sum("_n").alias("_size")).where(F.col("_size") >= least)
        found = estimates_of(levels.join(sizes.select("_key"), "_key", "left_semi"), floors).select("_key", F.struct(*ESTIMATE).alias("_e"))
        groups = cells.select(*LEVELS).distinct()
        for level in LEVELS:
            groups = groups.join(found.select(F.col("_key").alias(level), F.col("_e").alias(f"_e{level}")), level, "left")
        chosen = stored(groups.select("_own", F.coalesce(*(f"_e{level}" for level in LEVELS)).alias("_e")), "chosen")
        placed = rows.join(chosen.select("_own", "_e.*"), "_own", "left").withColumn("distance", distance())
        verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
        found = placed.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), *COUNTS, "base_failed", "distance", verdict.alias("kept"))
        return stored(found, "judged", out)
