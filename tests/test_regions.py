"""Connected regions and cleaned masks against a flood fill."""

from __future__ import annotations

import random

import pytest
from tessera.operators import regions


def flooded(pixels):
    """Region by region, each a set of pixels that touch along their sides."""
    left, out = set(pixels), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            found.add((r, c))
            for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(found)
    return out


def spiral(n):
    """A path of one pixel's width that fills a square."""
    r, c, dr, dc, out = 0, 0, 0, 1, {(0, 0)}
    for _ in range(n * n):
        ahead, beyond = (r + dr, c + dc), (r + 2 * dr, c + 2 * dc)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or beyond in out:
            dr, dc = dc, -dr
            ahead = (r + dr, c + dc)
            if (r + 2 * dr, c + 2 * dc) in out or not (0 <= ahead[0] < n and 0 <= ahead[1] < n):
                break
        r, c = ahead
        out.add(ahead)
    return out


def images(seed):
    r = random.Random(seed)
    out = {f"i{k}": {(y, x) for y in range(30) for x in range(37) if r.random() < p} for k, p in enumerate((0.05, 0.4, 0.55, 0.65, 0.97))}
    return out | {"spiral": spiral(30), None: {(0, 0), (29, 36)}, "empty": set()}


def rows(spark, masks, repeat=1):
    r = [(i, y, x) for i, own in masks.items() for y, x in own] * repeat
    return spark.createDataFrame(r, "image string, row int, col int").repartition(3)


def frame(spark, masks):
    return spark.createDataFrame([(i, 30, 37) for i in masks], "image string, height int, width int")


def found(df):
    out = {}
    for x in df.collect():
        out.setdefault(x.image, []).append((x.row, x.col))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [4, 256])
def test_regions_are_those_of_a_flood_fill(spark, block):
    masks = images(1)
    runs = regions.regions(rows(spark, masks, 2), ["image"], block=block)
    got = {}
    for x in runs.collect():
        got.setdefault((x.image, x.region), set()).update((x.row, c) for c in range(x.start, x.end))
    expected = {(i, (min(f)[0] << 32) + min(f)[1]): f for i, own in masks.items() for f in flooded(own)}
    assert got == expected


@pytest.mark.parametrize("least", [5, 40])
def test_small_objects_and_holes(spark, least):
    masks = images(2)
    kept = {i: {p for f in flooded(own) if len(f) >= least for p in f} for i, own in masks.items()}
    assert found(regions.without_small_objects(rows(spark, masks), ["image"], least, 8)) == {i: v for i, v in kept.items() if v}
    every = {(y, x) for y in range(30) for x in range(37)}
    filled = {i: own | {p for f in flooded(every - own) if len(f) < least for p in f} for i, own in masks.items()}
    assert found(regions.without_small_holes(rows(spark, masks), ["image"], frame(spark, masks), least, 8)) == {i: v for i, v in filled.items() if v}


def test_cleaned(spark):
    masks = images(3)
    every = {(y, x) for y in range(30) for x in range(37)}
    cross = lambda p: {(p[0] + a, p[1] + b) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))} & every
    erode, dilate = (lambda m: {p for p in every if cross(p) <= m}), (lambda m: {p for p in every if cross(p) & m})
    expected = {}
    for i, own in masks.items():
        solid = own | {p for f in flooded(every - own) if len(f) < 12 for p in f}
        large = {p for f in flooded(solid) if len(f) >= 12 for p in f}
        expected[i] = erode(dilate(dilate(erode(large))))
    assert found(regions.cleaned(rows(spark, masks), ["image"], frame(spark, masks), 12, 8)) == {i: v for i, v in expected.items() if v}


def test_nothing(spark):
    none = rows(spark, {})
    assert regions.regions(none, ["image"]).count() == 0
    assert regions.without_small_objects(spark.createDataFrame([("a", None, 1), ("a", 2, None)], none.schema), ["image"], 1).count() == 0
    assert regions.without_small_holes(none, ["image"], frame(spark, {}), 5).count() == 0
    assert found(regions.without_small_holes(none, ["image"], frame(spark, ["a"]), 30 * 37 + 1)) == {"a": {(y, x) for y in range(30) for x in range(37)}}
    outside = spark.createDataFrame([("a", 40, 1), ("a", -1, 1)], none.schema)
    runs = regions.regions(outside, ["image"], frame(spark, ["a"])).collect()
    assert sum(r.end - r.start for r in runs) == 30 * 37


@pytest.mark.parametrize("at_once", [regions.CONTRACTED, 7])
def test_components(spark, at_once):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(80), 100 + r.randrange(80)) for _ in range(50)]
    edges = spark.createDataFrame([(g, *p) for g in "ab" for p in pairs] + [("c", 3, 3), ("c", 9, 4)], "g string, u long, v long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    expected = {(g, x): find(x) for g in "ab" for x in parent if find(x) != x} | {("c", 9): 4}
    rows = regions.components(edges.repartition(3), ["g"], at_once).collect()
    assert len(rows) == len(expected) and {(x.g, x.node): x.root for x in rows} == expected


@pytest.mark.parametrize("unset", [False, True])
def test_small_blocks_are_labelled_together(monkeypatch, unset):
    """Each block was a call of its own before. Batches end within blocks, and blocks may go on for several."""
    import numpy as np
    import pyarrow as pa

    r, rows = np.random.default_rng(5), []
    for image in [None, *range(40)]:
        for br, bc in ((0, 0), (0, 1), (3, 2)):
            rows += [(image, br, bc, br * 4, bc * 4, br * 4 + 3, bc * 4 + 4)] * unset
            high = 3 if unset else 4
            rows += [(image, br, bc, br * 4 + i, bc * 4 + j, None, None) for i, j in np.argwhere(r.random((high, 4)) < 0.5)]
    table = pa.Table.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(7)], names=["image", "_br", "_bc", "row", "col", "height", "width"])
    calls, real = [], regions.labels_of
    monkeypatch.setattr(regions, "labels_of", lambda *a: (calls.append(1), real(*a))[1])

    def found(at_once, size):
        calls.clear()
        made = [x for b in regions.block_runs(1, 4, unset, at_once)(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        return made, len(calls)

    together, few = found(regions.CELLS, 10_000)
    alone, many = found(1, 7)
    assert few == 1 and many == len({x[:3] for x in rows}) and together == alone and len(together) > 300
