"""The nearest place of each point, by a tree cut where the places are.

The tree is a k-d tree over a bounded sample of the places: halves by longitude, then by
latitude, and so on, so its leaves have about as many places each wherever those lie. All places
are then dealt to leaves, and each leaf's own envelope and one of its places are known. A point
takes the distance to the place of the leaf that it falls in as a bound, goes down the tree once
more for the leaves that may have something nearer, and meets the places of those: an equi-join
on the leaf, whose places are one row, so that a row for each leaf leaves the join. So however far
away a point or a place is, there is one round, and no point meets all places. Points at one
position look once; their keys are joined then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.raster import spread

#: Places a leaf, about; bounds of the tree (at 2^14 leaves, 1 MB is sent to tasks) and its sample.
LEAF, MOST_LEVELS, A_LEAF = 32, 14, 8


@dataclass
class Tree:
    """Cuts in heap order; for each node its envelope (x0, y0, x1, y1); for each leaf a place.
    Nodes without places have an envelope that is infinitely far away."""

    levels: int
    cuts: np.ndarray
    boxes: np.ndarray
    spots: np.ndarray

    def leaf_of(self, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            node = 2 * node + 1 + (at[:, level % 2] >= self.cuts[node])
        return node - len(self.cuts)

    def leaves_near(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``at`` and leaves that may have their nearest place. The first bound is the
        distance to the place of the own leaf, the second to the nearest of those of the leaves
        found."""
        bound = squares(at - self.spots[self.leaf_of(at)])
        row, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for level in range(self.levels + 1):
            off = self.off(at[row], node)
            near = off <= bound[row] * (1 + 1e-9)
            row, node, off = row[near], node[near], off[near]
            if level < self.levels:
                row, node = np.repeat(row, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
        leaf = node - len(self.cuts)
        np.minimum.at(bound, row, squares(at[row] - self.spots[leaf]))
        near = off <= bound[row] * (1 + 1e-9)
        return row[near], leaf[near]

    def off(self, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances from the nodes' envelopes."""
        box = self.boxes[node]
        return squares(np.maximum(0, np.maximum(box[:, :2] - at, at - box[:, 2:])))


def squares(off: np.ndarray) -> np.ndarray:
    return (off * off).sum(1)


def cuts_of(sample: np.ndarray, levels: int) -> np.ndarray:
    """Medians of the halves of a sample, in heap order."""
    cuts, groups = [], [sample]
    for level in range(levels):
        below = []
        for group in groups:
            values = np.sort(group[:, level % 2]) if len(group) else np.zeros(1)
            cut = values[len(values) // 2]
            cuts.append(cut)
            right = group[:, level % 2] >= cut if len(group) else np.zeros(0, bool)
            below += [group[~right], group[right]]
        groups = below
    return np.array(cuts)


def dealt(rows: DataFrame, tree: Tree, x: str, y: str, near: bool) -> DataFrame:
    """Rows with their leaf, or once for each leaf that may have their nearest place."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame[[x, y]].to_numpy(np.float64)
            row, leaf = shared.value.leaves_near(at) if near else (slice(None), shared.value.leaf_of(at))
            yield frame.iloc[row].assign(_leaf=leaf)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{own}, _leaf long")


def placed(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(f"`{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`) and abs(`{x}`) < double('inf') and abs(`{y}`) < double('inf')")


def tree_of(spots: DataFrame, px: str, py: str) -> tuple[Tree, DataFrame]:
    """A tree over places (distinct positions), and those with their leaf. Runs three small jobs
    over the places: they are counted, sampled by hash, and each leaf's envelope is taken."""
    n = spots.count()
    levels = int(min(MOST_LEVELS, max(0, np.ceil(np.log2(max(n, 1) / LEAF)))))
    sample = spots.select(px, py).orderBy(F.xxhash64(px, py), px, py).limit(A_LEAF << levels).toPandas().to_numpy(np.float64)
    size = 1 << levels
    tree = Tree(levels, cuts_of(sample.reshape(-1, 2), levels), np.tile([np.inf, np.inf, -np.inf, -np.inf], (2 * size - 1, 1)), np.zeros((size, 2)))
    leaves = dealt(spots, tree, px, py, False)
    spot = np.full((2 * size - 1, 2), np.inf)
    for r in leaves.groupBy("_leaf").agg(F.min(px), F.min(py), F.max(px), F.max(py), F.min(F.struct(px, py)).alias("spot")).collect():
        tree.boxes[size - 1 + r[0]], spot[size - 1 + r[0]] = r[1:5], r.spot
    for node in range(size - 2, -1, -1):
        a, b = 2 * node + 1, 2 * node + 2
        tree.boxes[node] = [*np.minimum(tree.boxes[a, :2], tree.boxes[b, :2]), *np.maximum(tree.boxes[a, 2:], tree.boxes[b, 2:])]
        spot[node] = np.where(np.isinf(spot[a]), spot[b], spot[a])
    for node in range(1, 2 * size - 1):  # a leaf without places bounds by a neighbour's
        spot[node] = np.where(np.isinf(spot[node]), spot[(node - 1) // 2], spot[node])
    tree.spots[:] = spot[size - 1 :]
    return tree, leaves


def nearest(points: DataFrame, places: DataFrame, x: str, y: str, px: str, py: str, key: list[str], place: str) -> DataFrame:
    """``key``, the nearest place by squared distance, ties by name, and distance2. Places at one
    position count once, by the first name; points and places without finite coordinates are left
    out, and without any place there is no row. Equal keys are one point."""
    spots = placed(places, px, py).groupBy(F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py")).agg(F.min(place).alias("_place"))
    tree, leaves = tree_of(spots, "_px", "_py")
    own = placed(points, x, y).select(*key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    near = leaves.groupBy("_leaf").agg(F.collect_list(F.struct("_px", "_py", "_place")).alias("_spots"))  # a leaf's places
    dx, dy = lambda s: F.col("_x") - s["_px"], lambda s: F.col("_y") - s["_py"]
    first = F.array_min(F.transform("_spots", lambda s: F.struct((dx(s) * dx(s) + dy(s) * dy(s)).alias("d"), s["_place"].alias("p"))))
    met = dealt(spread(own.select("_x", "_y").distinct()), tree, "_x", "_y", True).join(near, "_leaf").select("_x", "_y", first.alias("_first"))
    found = met.groupBy("_x", "_y").agg(F.min("_first").alias("_first"))
    best = own.join(found, ["_x", "_y"]).groupBy(*key).agg(F.min("_first").alias("_best"))
    return best.select(*key, F.col("_best.p").alias(place), F.col("_best.d").alias("distance2"))
