"""Points drawn evenly from polygons, exactly as many as wanted, without trying again.

What all of a row's polygons have in common is cut into trapezoids between levels at which edges
begin, end or cross. Their areas, as whole numbers, are laid end to end on a line, and each draw is a
place on it: trapezoids and draws meet by cells of the line, in one equi-join. How thin polygons
are, or how little of their envelopes they fill, is no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.boxes import Corners
from tessera.functions.geometry import PARTS
from tessera.operators.raster import spread
from tessera.operators.tiling import has_parts

#: Areas are shares of the whole in units of 2^-BITS; a trapezoid of less than one isn't drawn from.
BITS = 52
BUCKETS = 256
PIECE = "_piece int, _y0 double, _y1 double, _l0 double, _r0 double, _l1 double, _r1 double"


def edges_of(parts: list) -> np.ndarray:
    """(ax, ay, bx, by) of the edges of all rings that aren't level, from below to above."""
    found = []
    for part in parts if parts is not None else []:
        for ring in part:
            p = np.array([(v["x"], v["y"]) for v in ring], float).reshape(-1, 2)
            found.append(np.concatenate([p[:-1], p[1:]], axis=1))
    e = np.concatenate(found) if found else np.zeros((0, 4))
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def crossing_levels(e: np.ndarray) -> np.ndarray:
    """The heights at which edges cross."""
    a, r = e[:, :2], e[:, 2:] - e[:, :2]
    across = r[:, None, 0] * r[None, :, 1] - r[:, None, 1] * r[None, :, 0]
    q = a[None] - a[:, None]
    with np.errstate(all="ignore"):
        t = (q[..., 0] * r[None, :, 1] - q[..., 1] * r[None, :, 0]) / across
        u = (q[..., 0] * r[:, None, 1] - q[..., 1] * r[:, None, 0]) / across
    i, j = np.nonzero((across != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
    return a[i, 1] + t[i, j] * r[i, 1]


def trapezoids(polygons: list[np.ndarray]) -> np.ndarray:
    """(y0, y1, left and right at y0, left and right at y1) of what polygons, given by their edges,
    have in common."""
    of = np.repeat(np.arange(len(polygons)), [len(e) for e in polygons])
    e = np.concatenate(polygons) if polygons else np.zeros((0, 4))
    levels = np.unique(np.concatenate([e[:, 1], e[:, 3], crossing_levels(e)]))
    out = []
    for y0, y1 in zip(levels, levels[1:]):
        own = (e[:, 1] <= y0) & (e[:, 3] >= y1)
        if not own.any():
            continue
        (ax, ay, bx, by), mine = e[own].T, of[own]
        x0, x1 = (ax + (y - ay) * (bx - ax) / (by - ay) for y in (y0, y1))
        order = np.argsort(x0 + x1, kind="stable")
        x0, x1, mine = x0[order], x1[order], mine[order]
        inside = np.stack([np.cumsum(mine == k) % 2 == 1 for k in range(len(polygons))]).all(0)
        out += [(y0, y1, x0[i], x0[i + 1], x1[i], x1[i + 1]) for i in np.flatnonzero(inside[:-1]) if x0[i] + x1[i] < x0[i + 1] + x1[i + 1]]
    return np.array(out).reshape(-1, 6)


def rectangle(x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    return np.array([[x0, y0, x0, y1], [x1, y0, x1, y1]], float)


def pieces(rows: DataFrame, polygons: list[str], size: float) -> DataFrame:
    """Each row's trapezoids: of its polygons, within its box (x0, y0, x1, y1) less half a patch on
    each side, where it has that much."""
    rings = [c for c in polygons if not has_parts(rows, c)]
    own = spread(rows.withColumns({c: F.array(F.array(c)).cast(PARTS) for c in rings}))  # few bytes, much work

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, found = [], []
            for i in range(len(frame)):
                row = frame.iloc[i]
                half_x, half_y = (size / 2 if row[b] - row[a] > size else 0.0 for a, b in (("x0", "x1"), ("y0", "y1")))
                box = rectangle(row["x0"] + half_x, row["y0"] + half_y, row["x1"] - half_x, row["y1"] - half_y)
                t = trapezoids([box, *(edges_of(row[c]) for c in polygons)])
                at += [i] * len(t)
                found.append(np.column_stack([np.arange(len(t)), t]))
            names = [c.split()[0] for c in PIECE.split(", ")]
            made = pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 7)), columns=names).astype({"_piece": "int32"})
            yield pd.concat([frame.drop(columns=polygons).iloc[at].reset_index(drop=True), made], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in polygons)
    return own.mapInPandas(run, f"{kinds}, {PIECE}")


def share(*of: Column) -> Column:
    """A number from 0 to 1, of BITS bits, that depends on the values alone."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in of))), 1, 13), 16, 10)
    return digits.cast("double") / float(1 << 52)


def patches_in(tiles: DataFrame, size: float, count: int, seed: int, key: str, polygons: tuple[str, ...] = ()) -> DataFrame:
    """``count`` patches (px0, py0, px1, py1) with the tile's columns but its polygons: their centres
    are spread evenly over what a tile's box (x0, y0, x1, y1) and polygons (rings or parts) have in
    common, so far from the box's border that patches are within it where they fit. Tiles are named
    by ``key``. Without any such area there are no patches. The tiles are cut once, in one pass."""
    from tessera.sources.writers import stored

    cut = stored(pieces(tiles, list(polygons), size), "pieces")
    area = (F.col("_r0") - F.col("_l0") + F.col("_r1") - F.col("_l1")) / 2 * (F.col("_y1") - F.col("_y0"))
    total = cut.agg(F.sum(area.cast("decimal(38,12)")).cast("double").alias("_total"))  # exact in any order
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("_piece").cast("string"))), 1, 2), 16, 10).cast("int")
    weighed = cut.crossJoin(F.broadcast(total)).withColumn("_w", F.floor(area / F.col("_total") * float(1 << BITS))).where("_w > 0").withColumn("_bucket", bucket).drop("_total")
    sums = weighed.groupBy("_bucket").agg(F.sum("_w").alias("_sum"))  # BUCKETS rows at most
    before = sums.select("_bucket", (F.sum("_sum").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    placed = weighed.join(F.broadcast(before), "_bucket")
    end = F.col("_before") + F.sum("_w").over(W.partitionBy("_bucket").orderBy(key, "_piece").rowsBetween(W.unboundedPreceding, 0))
    cell = lambda at: F.floor(at / F.col("_all") * count)
    lined = placed.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_w"))
    spread = lined.withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))))
    drawn = tiles.sparkSession.range(count).crossJoin(F.broadcast(before.select("_all").distinct()))
    drawn = drawn.withColumn("_t", F.floor(share(F.lit(seed), F.col("id")) * F.col("_all"))).select("id", "_t", cell(F.col("_t")).alias("_at"))
    met = spread.join(drawn, (F.col("_cell") == F.col("_at")) & (F.col("_start") <= F.col("_t")) & (F.col("_t") < F.col("_end")))
    v, u = share(F.lit(f"{seed}v"), F.col("id")), share(F.lit(f"{seed}u"), F.col("id"))
    w0, w1 = F.col("_r0") - F.col("_l0"), F.col("_r1") - F.col("_l1")
    up = F.when(w0 == w1, v).otherwise((F.sqrt(w0 * w0 + (w1 * w1 - w0 * w0) * v) - w0) / (w1 - w0))
    mix = lambda a, b, t: a + (b - a) * t
    at = met.withColumn("_up", up).withColumn("_cy", mix(F.col("_y0"), F.col("_y1"), F.col("_up")))
    at = at.withColumn("_cx", mix(mix(F.col("_l0"), F.col("_l1"), F.col("_up")), mix(F.col("_r0"), F.col("_r1"), F.col("_up")), u))
    half = size / 2
    box = Corners(F.col("_cx") - half, F.col("_cy") - half, F.col("_cx") + half, F.col("_cy") + half)
    return at.select(*(c for c in tiles.columns if c not in polygons), *box.columns("px0", "py0", "px1", "py1"))
