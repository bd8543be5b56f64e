"""Offset curves against distances."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions.geometry import VERTICES
from tessera.operators import offsets


def sampled(piece, every=0.05):
    for (ax, ay), (bx, by) in zip(piece, piece[1:]):
        n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / every))
        yield from ((ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(n + 1))


def length(piece):
    return sum(math.dist(a, b) for a, b in zip(piece, piece[1:]))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("d", [1.0, -1.0, 3.5])
def test_curves_keep_their_distance_and_leave_nothing_out(seed, d):
    r = random.Random(seed)
    line, at, angle = [(0.0, 0.0)], (0.0, 0.0), 0.0
    for _ in range(7):
        angle += r.uniform(-2.2, 2.2)
        at = (at[0] + r.uniform(1, 8) * math.cos(angle), at[1] + r.uniform(1, 8) * math.sin(angle))
        line.append(at)
    p = np.array(line)
    pieces = offsets.offset_curve(line, d, quarter=64)
    spots = [s for piece in pieces for s in sampled(piece)]
    assert (abs(offsets.distances(np.array(spots).reshape(-1, 2), p) - abs(d)) < 2e-3 * abs(d)).all()
    for (ax, ay), (bx, by) in zip(line, line[1:]):  # what is d beside an edge, and no nearer to others
        n = math.hypot(bx - ax, by - ay)
        for t in np.linspace(0.01, 0.99, 25):
            spot = np.array([ax + t * (bx - ax) - (by - ay) / n * d, ay + t * (by - ay) + (bx - ax) / n * d])
            if offsets.distances(spot[None], p)[0] > abs(d) * (1 - 1e-7):
                assert min(math.dist(spot, s) for s in spots) < 0.06


def test_single_bends():
    square = [(0, 0), (10, 0), (10, 10)]
    inner, = offsets.offset_curve(square, 2)
    assert np.allclose(inner, [(0, 2), (8, 2), (8, 10)])
    outer, = offsets.offset_curve(square, -2)
    assert np.allclose([outer[0], outer[1], outer[-2], outer[-1]], [(0, -2), (10, -2), (12, 0), (12, 10)]) and len(outer) == 4 + offsets.QUARTER - 1
    assert np.allclose(offsets.offset_curve(square, -2, mitre=True), [[(0, -2), (12, -2), (12, 10)]])
    assert length(outer) == pytest.approx(20 + 2 * math.pi / 2, rel=1e-3)
    notch = [(0, 0), (10, 0), (10, -6), (12, -6), (12, 0), (22, 0)]
    assert [len(x) for x in offsets.offset_curve(notch, 2)][0] > 2 and len(offsets.offset_curve(notch, -2)) >= 1
    back, = offsets.offset_curve([(0, 0), (5, 0), (0, 0)], 1)
    assert length(back) == pytest.approx(10 + math.pi, rel=1e-2)


def test_lines_of_no_length_and_straight_ones():
    assert offsets.offset_curve([], 1) == [] and offsets.offset_curve([(1, 1)], 1) == [] and offsets.offset_curve([(1, 1), (1, 1)], 1) == []
    assert np.allclose(offsets.offset_curve([(0, 0), (1, 0), (1, 0), (3, 0)], 1)[0], [(0, 1), (1, 1), (3, 1)])
    assert offsets.offset_curve([(0, 0), (3, 0)], 0) == [[(0.0, 0.0), (3.0, 0.0)]]


def test_offset_lines(spark):
    v = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = spark.createDataFrame([(1, v((0, 0), (10, 0), (10, 10))), (2, None), (3, [])], f"id int, g {VERTICES}")
    out = offsets.offset_lines(rows, "g", [2.0, -2.0], mitre=True).orderBy("distance").collect()
    assert [(r.id, r.distance, r.piece, [(p.x, p.y) for p in r.g]) for r in out] == [(1, -2.0, 0, [(0.0, -2.0), (12.0, -2.0), (12.0, 10.0)]), (1, 2.0, 0, [(0.0, 2.0), (8.0, 2.0), (8.0, 10.0)])]


def test_equal_lines_are_one(spark):
    many = spark.range(3000).selectExpr("id", "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), null, named_struct('x', 10D, 'y', id % 3 + 1D)) g")
    made = offsets.offset_lines(many, "g", [0.25, -0.25])
    out = made.groupBy((F.col("id") % 3).alias("k"), "distance").agg(F.count("*").alias("n"), F.min(F.hash("g")), F.max(F.hash("g"))).collect()
    assert len(out) == 6 and all(r.n == 1000 and r[3] == r[4] for r in out)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_line" in plan[plan.index("MapInPandas") :]  # curves are made of distinct lines
