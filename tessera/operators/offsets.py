"""Lines beside lines: offset curves of bent lines.

Each edge is shifted to its left (right for a negative distance). On the outside of a bend the
shifted edges are joined by an arc, or by a corner (mitre) where that isn't too long; on the inside
they cross. The curve is then cut where it crosses itself, the other side's curve or the arcs around
the line's ends, and what lies nearer to the line than the distance goes. So a bend that is narrower than the distance leaves several pieces, or none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import VERTICES, vertex
from tessera.operators.raster import spread

#: Arcs have so many edges a quarter of a circle; a mitre is so many times as long as the distance.
QUARTER, LONGEST_MITRE = 16, 5.0


def raw_curve(p: np.ndarray, d: float, mitre: bool, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of shifted and joined edges, and for each edge between them the centre of its
    arc, or NaN."""
    along = np.diff(p, axis=0)
    along /= np.hypot(*along.T)[:, None]
    left = np.stack([-along[:, 1], along[:, 0]], 1)
    points, centres, none = [p[0] + d * left[0]], [], np.full(2, np.nan)
    for i in range(1, len(p) - 1):
        a, b = left[i - 1], left[i]
        turn, cosine = a[0] * b[1] - a[1] * b[0], float(np.clip(a @ b, -1, 1))
        points.append(p[i] + d * a)
        centres.append(none)
        if turn * d < 0 or cosine == -1:  # the outside
            angle = math.acos(cosine)
            if mitre and cosine > -1 and math.sqrt(2 / (1 + cosine)) <= LONGEST_MITRE:
                points[-1] = p[i] + d * (a + b) / (1 + cosine)
                continue
            n = 1 if mitre else max(1, math.ceil(angle / (math.pi / 2 / quarter) - 1e-9))
            for k in range(1, n + 1):
                t = math.copysign(angle * k / n, -d)
                points.append(p[i] + d * np.array([a[0] * math.cos(t) - a[1] * math.sin(t), a[0] * math.sin(t) + a[1] * math.cos(t)]))
                centres.append(none if mitre else p[i])
        elif cosine < 1:
            points.append(p[i] + d * b)
            centres.append(none)
    points.append(p[-1] + d * left[-1])
    centres.append(none)
    return np.array(points), np.array(centres)


def outline(p: np.ndarray, d: float, quarter: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges (start, extent) of the curves on both sides and of the arcs around the ends."""
    parts = []
    for line in (p, p[::-1]):
        parts.append(raw_curve(line, d, False, quarter)[0])
        along = (line[-1] - line[-2]) / np.hypot(*(line[-1] - line[-2]))
        t = np.linspace(math.pi / 2, -math.pi / 2, 2 * quarter + 1)[:, None]
        parts.append(line[-1] + abs(d) * (np.cos(t) * along + np.sin(t) * np.array([-along[1], along[0]])))
    return np.concatenate([x[:-1] for x in parts]), np.concatenate([np.diff(x, axis=0) for x in parts])


def crossings(p: np.ndarray, others: np.ndarray, extents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where edges of a line are crossed by other edges: their numbers, and places from 0 to 1."""
    r, q = np.diff(p, axis=0)[:, None], others[None] - p[:-1, None]
    across = r[..., 0] * extents[:, 1] - r[..., 1] * extents[:, 0]
    with np.errstate(all="ignore"):
        t, u = (q[..., 0] * extents[:, 1] - q[..., 1] * extents[:, 0]) / across, (q[..., 0] * r[..., 1] - q[..., 1] * r[..., 0]) / across
        edge, other = np.nonzero((across != 0) & (t > 1e-9) & (t < 1 - 1e-9) & (u >= 0) & (u <= 1))
    return edge, t[edge, other]


def distances(at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """From points to a line."""
    a, r = p[:-1], np.diff(p, axis=0)
    off = at[:, None] - a
    t = np.clip((off * r).sum(2) / (r * r).sum(1), 0, 1)
    off -= t[..., None] * r
    return np.sqrt((off * off).sum(2).min(1))


def offset_curve(vertices: list[tuple[float, float]], d: float, mitre: bool = False, quarter: int = QUARTER) -> list[list[tuple[float, float]]]:
    """The pieces of the curve at distance d to the left of a line."""
    p = np.array(vertices, float).reshape(-1, 2)
    p = p[np.append(True, (np.diff(p, axis=0) != 0).any(1))] if len(p) else p
    if len(p) < 2:
        return []
    if d == 0:
        return [[tuple(v) for v in p.tolist()]]
    points, centres = raw_curve(p, d, mitre, quarter)
    edge, t = crossings(points, *outline(p, d, quarter))
    n = len(points) - 1
    cuts = np.unique(np.concatenate([np.stack([edge, t], 1), *(np.stack([np.arange(n), np.full(n, end)], 1) for end in (0.0, 1.0))]), axis=0)
    edge, t0, t1 = cuts[:-1, 0].astype(int), cuts[:-1, 1], cuts[1:, 1]
    edge, t0, t1 = (x[t1 > t0] for x in (edge, t0, t1))  # else the next edge begins
    start, extent = points[edge], points[edge + 1] - points[edge]
    middle, arc = start + extent * ((t0 + t1) / 2)[:, None], ~np.isnan(centres[edge, 0])
    off = middle[arc] - centres[edge[arc]]
    middle[arc] = centres[edge[arc]] + off * (abs(d) / np.hypot(*off.T))[:, None]  # of the arc, not of its chord
    far = distances(middle, p) >= abs(d) * (1 - 1e-6)
    pieces: list[list[tuple[float, float]]] = []
    joined = False
    for kept, first, a, b in zip(far.tolist(), (t0 == 0).tolist(), (start + extent * t0[:, None]).tolist(), (start + extent * t1[:, None]).tolist()):
        if kept:
            if not joined and not (pieces and math.dist(pieces[-1][-1], a) <= 1e-9 * abs(d)):
                pieces.append([tuple(a)])
            if joined and not first:  # nothing was cut here
                pieces[-1].pop()
            if tuple(b) != pieces[-1][-1]:
                pieces[-1].append(tuple(b))
        joined = kept
    return [x for x in pieces if len(x) > 1]


def offset_lines(lines: DataFrame, geometry: str, distances: list[float], mitre: bool = False, quarter: int = QUARTER) -> DataFrame:
    """Each line's columns but its geometry, distance and piece (from 0) and geometry of the curves
    at those distances. Lines without two different vertices have none; nulls among the
    coordinates are left out. Equal lines are one until their curves are made."""
    keep = [c for c in lines.columns if c != geometry]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for vertices in frame["_line"]:
                own = [(v["x"], v["y"]) for v in vertices if v is not None and v["x"] is not None and v["y"] is not None]
                out += [(vertices, d, k, [{"x": x, "y": y} for x, y in piece]) for d in distances for k, piece in enumerate(offset_curve(own, d, mitre, quarter))]
            yield pd.DataFrame(out, columns=["_line", "distance", "piece", "_curve"])

    plain = lines.select(*keep, F.transform(geometry, lambda v: vertex(v["x"], v["y"])).alias("_line")).where("_line is not null")
    made = spread(plain.select("_line").distinct()).mapInPandas(run, f"_line {VERTICES}, distance double, piece int, _curve {VERTICES}")
    return plain.join(made, "_line").select(*keep, "distance", "piece", F.col("_curve").alias(geometry))
