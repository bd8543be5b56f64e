"""Exact samples: as many as wanted, inside, and evenly spread."""

from __future__ import annotations

import numpy as np
import pytest
from tessera.functions.geometry import PARTS
from tessera.operators import sampling

TILES = f"name string, x0 double, y0 double, x1 double, y1 double, one {PARTS}, two {PARTS}"


def parts(*polygons):
    return [[[{"x": float(x), "y": float(y)} for x, y in (*ring, ring[0])] for ring in polygon] for polygon in polygons]


def area(t):
    return float((((t[:, 3] - t[:, 2]) + (t[:, 5] - t[:, 4])) / 2 * (t[:, 1] - t[:, 0])).sum())


SQUARE, HOLE, FAR = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 6), (6, 6), (6, 3)], [(20, 0), (30, 0), (20, 10)]
L_SHAPE, THIN = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)], [(0, 0), (1000, 999), (1000, 1000)]


@pytest.mark.parametrize(("polygons", "expected"), [
    ([[SQUARE]], 100), ([[SQUARE, HOLE]], 91), ([[SQUARE, HOLE], [FAR]], 141), ([[L_SHAPE]], 64), ([[THIN]], 500), ([[[(0, 0), (5, 8), (2, 3)]]], 0.5), ([], 0),
])
def test_trapezoids_have_the_polygons_area(polygons, expected):
    assert area(sampling.trapezoids([sampling.edges_of(parts(*polygons))])) == pytest.approx(expected)


def test_what_polygons_have_in_common():
    one, two = sampling.edges_of(parts([SQUARE, HOLE])), sampling.edges_of(parts([[(5, -5), (15, 5), (5, 15), (-5, 5)]]))
    assert area(sampling.trapezoids([one, two])) == pytest.approx(100 - 9)  # the diamond touches the corners
    half = sampling.rectangle(4, 0, 10, 10)
    assert area(sampling.trapezoids([one, half])) == pytest.approx(60 - 6)
    star, bar = sampling.edges_of(parts([[(0, 0), (4, 8), (8, 0), (4, 3)]])), sampling.rectangle(0, 1, 8, 2)
    grid = np.stack(np.meshgrid(np.linspace(0, 8, 801)[:-1] + 0.005, np.linspace(1, 2, 101)[:-1] + 0.005), -1).reshape(-1, 2)

    def inside(x, y):
        above_left, above_right = y < 2 * x, y < 2 * (8 - x)
        return above_left & above_right & (y > np.where(x < 4, 0.75 * x, 0.75 * (8 - x)))

    assert area(sampling.trapezoids([star, bar])) == pytest.approx(inside(*grid.T).mean() * 8, abs=0.02)


def test_patches(spark):
    rows = [("holed", 0.0, 0.0, 10.0, 10.0, parts([SQUARE, HOLE]), parts([SQUARE])), ("thin", 0.0, 0.0, 1000.0, 1000.0, parts([THIN]), parts([[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]])), ("none", 0.0, 0.0, 5.0, 5.0, parts([FAR]), [])]
    tiles = spark.createDataFrame(rows, TILES)
    drawn = sampling.patches_in(tiles, 0.5, 4000, 7, "name", ("one", "two")).collect()
    assert len(drawn) == 4000 and {r.name for r in drawn} == {"holed", "thin"}
    x, y = (np.array([(r[a] + r[b]) / 2 for r in drawn]) for a, b in (("px0", "px1"), ("py0", "py1")))
    holed = np.array([r.name == "holed" for r in drawn])
    room = 9.5 * 9.5 - 9
    assert holed.mean() == pytest.approx(room / (room + 499.25), abs=0.02)
    a, b = x[holed], y[holed]
    assert ((a >= 0.25) & (a <= 9.75) & (b >= 0.25) & (b <= 9.75)).all() and not ((a > 3) & (a < 6) & (b > 3) & (b < 6)).any()
    assert (a < 3).mean() == pytest.approx(2.75 * 9.5 / room, abs=0.06) and (b > 6).mean() == pytest.approx(3.75 * 9.5 / room, abs=0.06)
    a, b = x[~holed], y[~holed]
    assert (b <= a + 1e-6).all() and (b >= a * 0.999 - 1e-6).all()
    assert (a > 1000 / 2**0.5).mean() == pytest.approx(0.5, abs=0.03)
    again = sampling.patches_in(tiles.repartition(3), 0.5, 4000, 7, "name", ("one", "two")).collect()
    assert sorted(again) == sorted(drawn)


def test_nothing_to_draw_from(spark):
    empty = spark.createDataFrame([], TILES)
    assert sampling.patches_in(empty, 1, 10, 1, "name", ("one",)).count() == 0
    outside = spark.createDataFrame([("none", 0.0, 0.0, 5.0, 5.0, parts([FAR]), None)], TILES)
    assert sampling.patches_in(outside, 1, 10, 1, "name", ("one", "two")).count() == 0
    assert sampling.patches_in(outside, 1, 10, 1, "name").count() == 10
