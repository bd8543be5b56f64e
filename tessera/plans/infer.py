"""The boundary to models: batch functions on pandas frames, one model a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(rows: DataFrame, load: Callable[[], Model], schema: str) -> DataFrame:
    """``load`` runs once a task; what it returns takes a batch of rows and gives rows of
    ``schema``. Filters belong before this call: Spark doesn't move them below it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            if len(frame):
                yield model(frame)

    return rows.mapInPandas(run, schema)


DETECTIONS = "tile string, patch_seq int, box_ix int, cx double, cy double, w double, h double, score double, text_score double, phrase string"


def stub_detector() -> Model:
    """Stands in for a text-prompted detector: boxes from the patch's number alone."""

    def detect(patches: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for tile, seq in zip(patches["tile"], patches["patch_seq"], strict=True):
            for k in range(int(seq) % 3):
                rows.append((tile, int(seq), k, 0.25 + 0.25 * k, 0.5, 0.05 + 0.01 * (int(seq) % 5), 0.06, 0.1 + 0.05 * (int(seq) % 7), 0.25 + 0.1 * (int(seq) % 4), "bush"))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return detect


def stub_segmenter() -> Model:
    """Stands in for a box-prompted segmenter: a box's logit is its score less a half, with
    three candidates of falling quality."""

    def segment(prompts: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for k in range(3):
            part = prompts[["tile", "patch_seq", "box_ix", "channel", "x0", "y0", "x1", "y1"]].copy()
            part["logit"] = (prompts["score"] - 0.1 * (k + 1)).astype("float32")
            part["quality"] = 0.9 - 0.2 * k
            parts.append(part)
        return pd.concat(parts)

    return segment


MASKS = "tile string, patch_seq int, box_ix long, channel string, x0 double, y0 double, x1 double, y1 double, logit float, quality double"


def embed_once(prompts: DataFrame, by: list[str], load: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """``load`` gives an embedder of a group's key and a decoder of (embedding, its rows). Rows of
    a group follow each other in one task, so it is embedded once however many batches it has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed, decode = load()
        key, embedding = None, None
        for frame in frames:
            for now, rows in frame.groupby(by, sort=False):
                if now != key:
                    key, embedding = now, embed(now)
                yield decode(embedding, rows)

    return prompts.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def stub_embedder() -> tuple[Callable, Callable]:
    """Stands in for an encoder and a decoder: half of the patch's number, plus a box's width."""

    def decode(embedding: float, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop(columns=["x0", "x1"]).assign(v=embedding + rows["x1"] - rows["x0"])

    return lambda key: key[0] * 0.5, decode


# Means and deviations of the colours that models are trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalised(value: Column, colour: int) -> Column:
    """A colour's value from 0 to 255 as models take it."""
    return (value / F.lit(255.0) - MEAN[colour]) / DEVIATION[colour]


def resized(width: Column, height: Column, short: int = 800, long: int = 1333) -> tuple[Column, Column]:
    """The size at which the shorter side is ``short``, or less if the longer were over ``long``."""
    side = F.least(F.lit(short), F.round(long * F.least(width, height) / F.greatest(width, height)).cast("int"))
    return (
        F.when(width <= height, side).otherwise(F.floor(side * width / height)).cast("int"),
        F.when(width <= height, F.floor(side * height / width)).otherwise(side).cast("int"),
    )
