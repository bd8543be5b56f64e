"""Boxes covered by better ones, held against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.operators import covering
from tessera.operators import spatial_join as sj

BOXES = "kind string, x0 double, y0 double, x1 double, y1 double, score double"


def slow(boxes, share):
    def covers(o, t):
        if None in o[:5] or None in t[:5] or o[0] != t[0] or not (t[1] <= o[3] and o[1] <= t[3] and t[2] <= o[4] and o[2] <= t[4]):
            return False
        rank = lambda b: (b[5] is not None, b[5] or 0.0, b[3], b[4])
        common = (min(o[3], t[3]) - max(o[1], t[1])) * (min(o[4], t[4]) - max(o[2], t[2]))
        area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
        return rank(o) > rank(t) and common > share * (area(t) + area(o) - common)

    return {t for t in boxes if not any(covers(o, t) for o in boxes)}


@pytest.mark.parametrize("share", [0.5, 0.1, 0.9])
@pytest.mark.parametrize("few", [0, 1 << 12])
def test_covered_boxes(spark, share, few, monkeypatch):
    monkeypatch.setattr(covering, "FEW", few)
    monkeypatch.setattr(covering, "AT_ONCE", 200)
    r, boxes = random.Random(int(share * 10)), set()
    for _ in range(350):
        x, y, s = r.choice([-5000.0, 0.0, 1e6]) + r.randrange(60), r.randrange(40) - 20.0, r.choice([1, 1, 1, 20, 900])
        boxes.add((r.choice("ab"), x, y, x + s * r.randrange(0, 12), y + s * r.uniform(1, 9), r.choice([None, 0.1, 0.2, 0.3])))
    boxes |= {(None, 0.0, 0.0, 5.0, 5.0, 0.3), ("a", None, 0.0, 5.0, 5.0, 0.3), ("a", 9.0, 9.0, 1.0, 1.0, 0.2)}
    boxes = list({b[:5]: b for b in boxes}.values())
    found = [tuple(x) for x in sj.without_covered(spark.createDataFrame(boxes, BOXES), "kind", "score", share).collect()]
    assert len(found) == len(set(found)) and set(found) == slow(boxes, share)


def test_boxes_on_one_spot_make_no_pairs(spark, monkeypatch):
    """Thousands of boxes on one spot: they were joined as pairs before, with the square of them."""
    n = 3000
    boxes = spark.range(n).selectExpr("'a' kind", "0D x0", "0D y0", "10 + id / 10000D x1", "10D y1", "cast(id * 7919 % 3000 as double) score")
    left = sj.without_covered(boxes, "kind", "score", 0.5)
    assert "Join" not in left._jdf.queryExecution().executedPlan().toString()
    assert [x.score for x in left.collect()] == [n - 1.0]
    at = np.arange(n)
    table = boxes.selectExpr("*", "0 _level", "true _own").toArrow()
    compared, real = [], np.minimum
    monkeypatch.setattr(np, "minimum", lambda a, b, **k: (compared.append(np.broadcast_shapes(np.shape(a), np.shape(b))), real(a, b, **k))[1])
    assert covering.uncovered("score", 0.5, 100.0)(table).num_rows == 1
    assert sum(np.prod(s, dtype=np.int64) for s in compared) < 300 * len(at)
