"""Cutting tiles into overlapping patches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.functions.boxes import Corners
from tessera.functions.geometry import edges, in_parts, in_ring, ring_edges
from tessera.operators.raster import spread

#: Patches times edges that are tested at once, and patches that are sent on at once; tiles with so
#: few are tested together.
AT_ONCE, FEW = 1 << 20, 1000


def steps(extent: Column, size: float, stride: float) -> Column:
    """How many patches cover an extent; the last may reach beyond it."""
    return F.greatest(F.lit(1), (F.ceil((extent - size) / stride) + 1)).cast("int")


def grid(tiles: DataFrame, size: float, stride: float, polygon: str | None = None) -> DataFrame:
    """The patches of each tile (x0, y0, x1, y1): tile columns and patch_seq, i, j, px0, py0,
    px1, py1. Row-major from the bottom. With ``polygon`` (a ring, or parts), those that meet it."""
    t = Corners.named()
    rows, cols = steps(t.height(), size, stride), steps(t.width(), size, stride)
    if polygon:
        hit = patches_on(tiles.withColumns({"_rows": rows, "_cols": cols}), size, stride, polygon).withColumn("patch_seq", F.explode("_hits"))
        cells = hit.withColumns({"i": F.floor(F.col("patch_seq") / F.col("_cols")).cast("int"), "j": F.col("patch_seq") % F.col("_cols")}).select(*tiles.columns, "i", "j")
    else:
        cells = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), cols - 1)))
    x, y = t.x0 + F.col("j") * stride, t.y0 + F.col("i") * stride
    return cells.withColumns({"patch_seq": F.col("i") * cols + F.col("j"), "px0": x, "py0": y, "px1": x + size, "py1": y + size})


def patches_on(tiles: DataFrame, size: float, stride: float, polygon: str) -> DataFrame:
    """Tiles with the numbers (_hits) of those of their _rows x _cols patches that meet their polygon;
    a tile of many patches has several rows. Tests are those of ``polygon_hits_box`` and
    ``parts_hit_box``, for many patches at once. Few tiles may have many patches: they are dealt out."""
    parts = has_parts(tiles, polygon)
    of = F.transform((ring_edges if parts else edges)(F.col(polygon)), lambda e: F.array(*(e[p][c].cast("double") for p in "ab" for c in "xy")))
    whole = lambda e: ~F.exists(e, lambda v: v.isNull() | F.isnan(v))
    names = [c for c in tiles.columns if c not in ("_rows", "_cols")]
    own = tiles.where("_rows is not null and _cols is not null").withColumn("_edges", F.flatten(F.filter(of, whole))).where("size(_edges) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            kept = batch.select([*names, "_rows", "_cols"])
            at, found, n = [], [], 0
            x0, y0, rows, cols = (column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "_rows", "_cols"))
            edged = column("_edges").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            ends = np.cumsum(column("_edges").value_lengths().to_numpy(zero_copy_only=False)) // 4
            sizes = np.diff(ends, prepend=0)
            small = np.int64(rows) * cols * sizes <= FEW
            for m in np.unique(sizes[small]):  # many tiles at once
                mine = np.flatnonzero(small & (sizes == m))
                for some in np.array_split(mine, -(-len(mine) * FEW // AT_ONCE)):
                    n_of = rows[some] * cols[some]
                    of = np.repeat(np.arange(len(some)), n_of)
                    seq = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
                    i, j = seq // cols[some][of], seq % cols[some][of]
                    e = np.stack([edged[ends[some] - m + v] for v in range(m)], 1)[of]
                    hit = hits_of(e[:, None, None], (x0[some][of] + j * stride)[:, None], (y0[some][of] + i * stride)[:, None], size, parts)[:, 0, 0]
                    of, seq = of[hit], seq[hit].astype(np.int32)
                    first = np.flatnonzero(np.diff(of, prepend=-1))
                    if len(of):
                        yield listed(kept, some[of[first]].tolist(), np.split(seq, first[1:]))
            for k in np.flatnonzero(~small):
                e = edged[ends[k] - sizes[k] : ends[k]]
                step = max(1, AT_ONCE // max(1, cols[k] * len(e)))
                for first in range(0, rows[k], step):
                    i = np.arange(first, min(rows[k], first + step))
                    hits = np.flatnonzero(hits_of(e, x0[k] + np.arange(cols[k]) * stride, y0[k] + i * stride, size, parts)) + first * cols[k]
                    if len(hits):
                        at.append(k)
                        found.append(hits.astype(np.int32))
                        n += len(hits)
                    if n >= AT_ONCE:
                        yield listed(kept, at, found)
                        at, found, n = [], [], 0
            if at:
                yield listed(kept, at, found)

    schema = own.drop("_edges").schema.add("_hits", ArrayType(IntegerType()))
    return spread(own).mapInArrow(run, schema)


def listed(batch: pa.RecordBatch, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    """Some of a batch's rows, with lists beside them."""
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
    return pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, lists], [*batch.schema.names, "_hits"])


def hits_of(e: np.ndarray, x: np.ndarray, y: np.ndarray, size: float, parts: bool) -> np.ndarray:
    """Whether the boxes with those left and lower borders meet a polygon, given by its edges."""
    ax, ay, bx, by = (e[..., k] for k in range(4))
    x, y = x[..., None, :, None], y[..., :, None, None]  # rows, columns, edges
    ex, ey, mx, my = (x + size - x) / 2, (y + size - y) / 2, (ax + bx) / 2 - (x + (x + size)) / 2, (ay + by) / 2 - (y + (y + size)) / 2
    dx, dy = (bx - ax) / 2, (by - ay) / 2
    near = (np.abs(my) <= ey + np.abs(dy)) & (np.abs(mx) <= ex + np.abs(dx))
    hit = (near & (np.abs(dx * my - dy * mx) <= ex * np.abs(dy) + ey * np.abs(dx))).any(-1)
    spans = (ay > y) != (by > y)
    if not parts:
        with np.errstate(all="ignore"):
            right = ax + (y - ay) * (bx - ax) / (by - ay)
        return hit | ((spans & (x < right)).sum(-1) % 2 == 1)
    across = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    level = (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
    on = (across == 0) & level & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx))
    return hit | on.any(-1) | ((spans & ((across > 0) == (by > ay))).sum(-1) % 2 == 1)


def has_parts(rows: DataFrame, polygon: str) -> bool:
    """Whether a column holds polygons of parts rather than rings."""
    return isinstance(rows.schema[polygon].dataType.elementType, ArrayType)


def batches(patches: DataFrame, batch_size: int, by: list[str], order: str = "patch_seq") -> DataFrame:
    """batch_ix and place for consecutive patches of each tile. No patch is lost or padded."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    return patches.withColumns({"batch_ix": F.floor(n / batch_size).cast("int"), "place": (n % batch_size).cast("int")})


def batch_count(patches: int, batch_size: int) -> int:
    return math.ceil(patches / batch_size)


def tile_pixels(extent: Column, resolution: float) -> Column:
    """An extent in pixels; an error unless that is a whole number."""
    n = F.round(extent / resolution)
    return F.when(F.abs(extent / resolution - n) < 1e-6, n.cast("long")).otherwise(F.raise_error(F.lit("a tile's size is no whole number of pixels")))


def draw(*of: Column) -> Column:
    """A number from 0 to 1 that depends on the values alone, not on how rows are dealt out."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in of))), 1, 8), 16, 10)
    return digits.cast("double") / float(1 << 32)


def random_patches(tiles: DataFrame, size: float, count: int, seed: int, key: str, polygons: tuple[str, ...] = (), rounds: int = 40) -> DataFrame:
    """``count`` patches at random, tiles (named by ``key``) weighed by area; with polygons,
    patches with their centre in all of them. Each round a tile draws its share, and it goes on
    until there are enough; an error if they aren't after so many rounds. Without tiles there are
    no patches. Each tile draws, however many there are: they are dealt out."""
    t = Corners.named()
    total = tiles.agg(F.sum(t.area()).alias("_total"))
    shares = spread(tiles).crossJoin(F.broadcast(total)).withColumn("_n", F.ceil(t.area() / F.col("_total") * count * (2 if polygons else 1)).cast("int") + 1)
    found, drawn = None, 0
    for k in range(rounds):
        mine = shares.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_k", F.col("_k") + F.col("_n") * k)
        at = lambda axis: draw(F.lit(f"{seed}{axis}"), F.col(key), F.col("_k"))
        placed = mine.withColumns({"px0": t.x0 + at("x") * F.greatest(F.lit(0.0), t.width() - size), "py0": t.y0 + at("y") * F.greatest(F.lit(0.0), t.height() - size)})
        placed = placed.withColumns({"px1": F.col("px0") + size, "py1": F.col("py0") + size, "_order": at("o")})
        x, y = Corners.named("px0", "py0", "px1", "py1").center()
        for polygon in polygons:
            placed = placed.where((in_parts if has_parts(tiles, polygon) else in_ring)(x, y, F.col(polygon)))
        found = placed if found is None else found.unionByName(placed)
        drawn += placed.limit(count).count()
        if drawn >= count or (not k and tiles.isEmpty()):
            return found.orderBy("_order", key, "_k").limit(count).drop("_n", "_k", "_total", "_order")
    raise ValueError(f"{drawn} of {count} patches found: the polygons have too little room")


def random_fraction(rows: DataFrame, fraction: float, seed: int, by: list[str]) -> DataFrame:
    """floor(n * fraction) rows of each group, at random by a hash of their values; a group is
    ranked in one task."""
    n = F.count("*").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(draw(F.lit(seed), *map(F.col, rows.columns)), *rows.columns))
    return rows.withColumns({"_n": n, "_rank": rank}).where(F.col("_rank") <= F.floor(F.col("_n") * fraction)).drop("_n", "_rank")


def padded(batched: DataFrame, batch_size: int, by: list[str]) -> DataFrame:
    """Batches with rows for what the last one lacks: nulls but for ``by``, batch_ix and place,
    and is_pad."""
    last = batched.groupBy(*by).agg(F.max(F.struct("batch_ix", "place")).alias("_last"))
    places = F.sequence(F.col("_last.place") + 1, F.lit(batch_size - 1))
    fill = last.where(F.col("_last.place") < batch_size - 1).select(*by, F.col("_last.batch_ix").alias("batch_ix"), F.explode(places).alias("place"), F.lit(True).alias("is_pad"))
    return batched.withColumn("is_pad", F.lit(False)).unionByName(fill, allowMissingColumns=True)


def until(batched: DataFrame, last_batch: int | None) -> DataFrame:
    """Batches up to one; None is all."""
    return batched if last_batch is None else batched.where(F.col("batch_ix") <= last_batch)


def sub_batches(rows: DataFrame, parallel: int, by: list[str], order: list[str]) -> DataFrame:
    """sub_ix for so many consecutive rows of each group."""
    return rows.withColumn("sub_ix", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / parallel).cast("int"))


def collated(batched: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for each batch: how many samples it has, and for each column an array of theirs in
    order of place. Padding (is_pad) is left out."""
    own = batched.where(~F.col("is_pad")) if "is_pad" in batched.columns else batched
    one = own.groupBy(*by, "batch_ix").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("_all"))  # a batch's size at most
    return one.select(*by, "batch_ix", F.size("_all").cast("long").alias("n"), *(F.col(f"_all.{c}").alias(c) for c in columns))
