"""Connected regions of masks, and masks without small objects and holes.

A mask is its set pixels. Blocks of pixels are labelled as runs of columns, small ones together;
what continues across a block's border is an edge between two blocks' labels, and labels are
merged until none are left that belong together. So no task holds more than some
blocks, whatever a region's size, and what is joined is a row for each pixel of the borders.

Pixels touch along their sides. A hole is a region of pixels that aren't set, within the
image's frame; as a region that meets the frame's border is one too, a small corner cut off by
a mask is filled. A region is named by its first pixel, row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.sources.writers import stored

BLOCK = 256
#: Pixels of blocks that are labelled at once.
CELLS = 1 << 21
#: Nodes that a task joins at once.
CONTRACTED = 200_000


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and the column after the last of each run of set pixels, in order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def labels_of(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """For each run the first run of its region."""
    wide = width + 2
    low = np.searchsorted(row * wide + end, (row + 1) * wide + start, "right")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + end, "left")
    n = np.maximum(0, high - low)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(a))
    label = np.arange(len(row))
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label != (up := label[label])).any():
            label = up
    return label


def block_runs(keys: int, block: int, unset: bool, at_once: int = CELLS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The labelled runs of blocks' pixels, many small blocks at a time: ``keys`` columns of an
    image's name, block, row, col, height and width, in order of image and block. Rows with a
    height say how large the frame is."""
    tall = block + 1  # a row between blocks, so that they don't touch

    def firsts(rows: pa.Table) -> np.ndarray:
        """The first row of each block."""
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in rows.columns[: keys + 2]:
            code = pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def of(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        n, block_of = len(first), np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
        top, left = (rows.column(keys + i).to_numpy()[first] * block for i in range(2))
        own = rows.column("height").is_null().to_numpy()
        mask = np.zeros((n, tall, block), bool)
        at = block_of[own]
        mask[at, rows.column("row").to_numpy()[own] - top[at], rows.column("col").to_numpy()[own] - left[at]] = True
        if unset:
            size = np.zeros((2, n), np.int64)
            for k, (c, start) in enumerate((("height", top), ("width", left))):
                np.maximum.at(size[k], block_of[~own], rows.column(c).filter(pa.array(~own)).to_numpy())
                size[k] = np.minimum(block, size[k] - start)
            mask = ~mask & (np.arange(tall) < size[0][:, None])[:, :, None] & (np.arange(block) < size[1][:, None])[:, None, :]
        row, start, end = runs_of(mask.reshape(-1, block))
        label = labels_of(row, start, end, block)
        at, row = row // tall, row % tall
        region = (row[label] + top[at] << 32) + start[label] + left[at]
        made = [pa.array(v, pa.int64()) for v in (row + top[at], start + left[at], end + left[at], region)]
        named = rows.select(rows.column_names[:keys]).take(pa.array(first[at])).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in named.columns), *made], names=[*named.column_names, "row", "start", "end", "region"])

    def made(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, at_once // (tall * block))
        ends = np.append(first, rows.num_rows)
        for k in range(0, len(first), step):
            last = min(k + step, len(first))
            yield of(rows.slice(ends[k], ends[last] - ends[k]), first[k:last] - first[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < at_once // 16:
                continue
            rows = pa.Table.from_batches(held)
            first = firsts(rows)
            yield from made(rows.slice(0, first[-1]), first[:-1])  # the last block may go on
            held = rows.slice(first[-1]).combine_chunks().to_batches()
            n = 0
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from made(rows, firsts(rows))

    return run


def stars(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Edges (image's names, u, v) as edges to the smallest node of what they connect, some at a
    time."""
    parent: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def joined(names: list[str]) -> Iterator[pa.RecordBatch]:
        found = [(*x[:-1], x[-1], r[-1]) for x in parent if (r := root(x)) != x]
        parent.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        for *key, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root((*key, u)), root((*key, v))
            parent[max(a, b)] = min(a, b)
            if len(parent) >= at_once:
                yield from joined(names)
    yield from joined(names)


def components(edges: DataFrame, by: list[str], at_once: int = CONTRACTED) -> DataFrame:
    """(by, node, root) for the nodes of ``edges`` (by: names; u, v) but the smallest of each
    component, which is root. Edges are first joined within tasks. If that doesn't settle it,
    nodes merge in rounds into the first of themselves and their neighbours in an order that each
    round draws anew, so that chains are short and about half of the nodes go each time."""
    own = edges.where("u <> v").repartition(*by, F.shiftright("u", 44)).select(*by, "u", "v")
    kinds = ", ".join(f"{c} string" for c in by)
    now = stored(own.mapInArrow(partial(stars, at_once=at_once), f"{kinds}, u long, v long").distinct(), "edges")
    if settled(now, by):
        return now.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    merged: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(merged))).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        into = both.groupBy(*by, "u").agg(F.least(F.min(order("v")), F.min(order("u")))["n"].alias("to"))
        into = stored(into, "merged")
        merged.append(into.select(*by, F.col("u").alias("node"), F.col("to").alias("root")))
        ends = now.join(into, [*by, "u"]).select(*by, F.col("to").alias("a"), F.col("v").alias("u")).join(into, [*by, "u"])
        now = stored(ends.where("a <> to").select(*by, F.greatest("a", "to").alias("u"), F.least("a", "to").alias("v")).distinct(), "edges")
    found = merged.pop()
    for step in reversed(merged):
        later = found.select(*by, F.col("node").alias("root"), F.col("root").alias("_last"))
        found = step.join(later, [*by, "root"], "left").select(*by, "node", F.coalesce("_last", "root").alias("root"))
    found = stored(found, "found")
    least = found.groupBy(*by, "root").agg(F.min("node").alias("_first"))
    return found.join(least, [*by, "root"]).where("node <> _first").select(*by, "node", F.col("_first").alias("root"))


def settled(edges: DataFrame, by: list[str]) -> bool:
    """Whether each node has one edge, to a node that has none from it."""
    several = edges.groupBy(*by, "u").agg(F.count("*").alias("n")).where("n > 1").select(*by, "u")
    return several.unionByName(edges.join(edges.select(*by, F.col("v").alias("u")), [*by, "u"], "left_semi").select(*by, "u")).isEmpty()


def regions(pixels: DataFrame, by: list[str], frame: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Runs (by, row, start, end, region) of the regions of set pixels (by, row, col); with a
    frame (by, height, width), of the pixels in it that aren't set. Repeated pixels count once,
    and pixels outside a frame, or with null coordinates, not at all. Images without pixels have
    no regions of set ones; nulls in ``by`` name an image like others."""
    ours = pixels.where("row is not null and col is not null").select(*by, F.col("row").cast("long"), F.col("col").cast("long"))
    sized = ours.withColumns({"height": F.lit(None).cast("long"), "width": F.lit(None).cast("long")})
    if frame is not None:
        whole = frame.select(*by, F.col("height").cast("long"), F.col("width").cast("long")).where("height > 0 and width > 0").distinct()
        same = [ours[c].eqNullSafe(whole[c]) for c in by]
        inside = ours.join(whole, [*same, ours["row"].between(0, whole["height"] - 1), ours["col"].between(0, whole["width"] - 1)], "left_semi")
        sized = inside.withColumns({"height": F.lit(None).cast("long"), "width": F.lit(None).cast("long")})
        starts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(block).cast("long")))
        sized = sized.unionByName(whole.withColumn("row", starts("height")).withColumn("col", starts("width")))
    dealt = sized.withColumns({"_br": F.floor(F.col("row") / block), "_bc": F.floor(F.col("col") / block)})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*by).schema)
    at = [*by, "_br", "_bc"]
    blocks = dealt.select(*at, "row", "col", "height", "width").repartition(*at).distinct().sortWithinPartitions(*at)
    runs = stored(blocks.mapInArrow(block_runs(len(by), block, frame is not None), f"{kinds}, row long, start long, end long, region long"), "runs")
    named = {c: f"_by{i}" for i, c in enumerate(by)}  # nulls in them are values here
    keyed = runs.select(*(F.to_json(F.struct(F.col(c).alias("v"))).alias(n) for c, n in named.items()), "row", "start", "end", "region")
    keys = list(named.values())
    right = keyed.where(F.col("end") % block == 0).select(*keys, "row", F.col("end").alias("at"), F.col("region").alias("u"))
    left = keyed.where(F.col("start") % block == 0).select(*keys, "row", F.col("start").alias("at"), F.col("region").alias("v"))
    columns = F.explode(F.sequence("start", F.col("end") - 1))
    below = keyed.where(F.col("row") % block == block - 1).select(*keys, (F.col("row") + 1).alias("row"), columns.alias("at"), F.col("region").alias("u"))
    above = keyed.where(F.col("row") % block == 0).select(*keys, "row", columns.alias("at"), F.col("region").alias("v"))
    edges = right.join(left, [*keys, "row", "at"]).unionByName(below.join(above, [*keys, "row", "at"]))
    roots = components(edges, keys).withColumnRenamed("node", "region")
    named_runs = runs.withColumns({n: F.to_json(F.struct(F.col(c).alias("v"))) for c, n in named.items()})
    return named_runs.join(roots, [*keys, "region"], "left").select(*by, "row", "start", "end", F.coalesce("root", "region").alias("region"))


def sizes(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, region, n): the pixels of each region."""
    return runs.groupBy(*by, "region").agg(F.sum(F.col("end") - F.col("start")).alias("n"))


def pixels_of(runs: DataFrame, by: list[str]) -> DataFrame:
    """The pixels of runs."""
    return runs.select(*by, F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.col("start").cast("int"), (F.col("end") - 1).cast("int"))).alias("col"))


def of_size(runs: DataFrame, by: list[str], condition: str) -> DataFrame:
    """Runs of regions whose number of pixels, n, meets a condition."""
    found = sizes(runs, by).where(condition)
    same = [runs[c].eqNullSafe(found[c]) for c in [*by, "region"]]
    return runs.join(found, same, "left_semi")


def without_small_objects(pixels: DataFrame, by: list[str], least: int, block: int = BLOCK) -> DataFrame:
    """Set pixels (by, row, col) of regions of ``least`` pixels or more."""
    return pixels_of(of_size(regions(pixels, by, block=block), by, f"n >= {least}"), by)


def without_small_holes(pixels: DataFrame, by: list[str], frame: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """Set pixels (by, row, col), distinct, and those of holes of fewer than ``least`` pixels.
    An image of a frame without any set pixel is filled if it is that small."""
    filled = pixels_of(of_size(regions(pixels, by, frame, block), by, f"n < {least}"), by)
    own = pixels.select(*by, F.col("row").cast("int"), F.col("col").cast("int")).where("row is not null and col is not null")
    return own.distinct().unionByName(filled)


def cleaned(pixels: DataFrame, by: list[str], frame: DataFrame, least: int = 500, block: int = BLOCK) -> DataFrame:
    """A mask without small holes, then without small objects, then opened and closed with a
    cross of five pixels; what is outside the frame counts as set where it is eroded."""
    solid = stored(without_small_holes(pixels, by, frame, least, block), "filled")
    large = without_small_objects(solid, by, least, block)
    opened = raster.dilated(raster.eroded(large, by, raster.CROSS, frame), by, raster.CROSS, frame)
    return raster.eroded(raster.dilated(opened, by, raster.CROSS, frame), by, raster.CROSS, frame)
