"""Quadkeys of web-mercator tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_of(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    n = 1 << level
    rad = F.radians(lat)
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(math.pi)) / 2
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c * n).cast("int")))
    return inside((lon + 180) / 360), inside(y)


def quadkey(x: Column, y: Column, level: int) -> Column:
    """As a string, which keeps leading zeros."""
    digits = [(F.shiftright(x, i).bitwiseAND(1) + 2 * F.shiftright(y, i).bitwiseAND(1)).cast("string") for i in range(level - 1, -1, -1)]
    return F.concat(*digits) if digits else F.lit("")


def parents(key: Column, least: int, most: int) -> Column:
    """A key's ancestors and itself at the levels from ``least`` to ``most``."""
    return F.transform(F.sequence(F.lit(least), F.least(F.lit(most), F.length(key))), lambda n: F.substring(key, F.lit(1), n))


def covering(lon0: Column, lat0: Column, lon1: Column, lat1: Column, level: int) -> Column:
    """The quadkeys of all tiles that a rectangle touches."""
    x0, y1 = tile_of(lon0, lat0, level)
    x1, y0 = tile_of(lon1, lat1, level)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: quadkey(x, y, level))))


def with_parents(keys: Column, least: int, most: int) -> Column:
    """Distinct keys and all their ancestors down to a level."""
    return F.array_distinct(F.flatten(F.transform(keys, lambda k: parents(k, least, most))))


# Ranges of keys: a table sorted by quadkeys of one level is pruned by them.


def tile_at(lon: float, lat: float, level: int) -> tuple[int, int]:
    n = 1 << level
    rad = math.radians(max(-85.06, min(85.06, lat)))
    y = (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2
    return tuple(max(0, min(n - 1, math.floor(c * n))) for c in ((lon + 180) / 360, y))


def cover(lon0: float, lat0: float, lon1: float, lat1: float, level: int) -> list[str]:
    """The fewest keys, of mixed levels down to ``level``, that make up the tiles of that level
    which a rectangle touches; in order. As many as its border has tiles, at most about."""
    x0, y0 = tile_at(lon0, lat1, level)
    x1, y1 = tile_at(lon1, lat0, level)
    found, todo = [], [("", 0, 0)]
    while todo:
        key, x, y = todo.pop()
        size = 1 << level - len(key)
        if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
            continue
        if x >= x0 and y >= y0 and x + size - 1 <= x1 and y + size - 1 <= y1:
            found.append(key)
            continue
        half = size // 2
        todo += [(f"{key}{i}", x + half * (i % 2), y + half * (i // 2)) for i in range(4)]
    return sorted(found)


def key_ranges(keys: list[str], level: int, most: int = 64) -> list[tuple[str, str]]:
    """First and last key of ``level`` of each run of keys; the runs with the smallest gaps are
    joined until there are no more than ``most``, so that what they name may be more."""
    runs: list[list[int]] = []
    for key in sorted(keys):
        start = int(key or "0", 4) << 2 * (level - len(key))
        end = start + (1 << 2 * (level - len(key))) - 1
        if runs and runs[-1][1] + 1 == start:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    if len(runs) > most:
        gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
        joined = set(gaps[: len(runs) - most])
        merged: list[list[int]] = []
        for i, run in enumerate(runs):
            if i in joined:
                merged[-1][1] = run[1]
            else:
                merged.append(run)
        runs = merged
    name = lambda n: "".join(str(n >> 2 * i & 3) for i in range(level - 1, -1, -1))
    return [(name(a), name(b)) for a, b in runs]


def in_ranges(key: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a key is in one of the ranges: comparisons that a scan can prune by."""
    found = F.lit(False)
    for i, (a, b) in enumerate(ranges):
        found = key.between(a, b) if not i else found | key.between(a, b)
    return found
