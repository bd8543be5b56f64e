"""Boxes that a better one covers, block by block.

A pair that shares more than a part of its union is alike in size and place: sides differ by that
part at most, and as much of either is common. So a box is a candidate in one block of space, of a
grid for boxes of its size, and looks into the few blocks where it can cover something. In a block
cells are gone through best boxes first, and only what is not yet covered is compared on. What
remains open is bounded by the room in a cell, as boxes that stay don't cover each other, so the
work grows with the boxes rather than with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a block's side; pairs compared at once; pairs of a cell so few that cells go together.
BLOCK, AT_ONCE, FEW = 8, 1 << 18, 1 << 12
CORNERS = ("x0", "y0", "x1", "y1")


def order_of(rows: pa.Table, score: str) -> np.ndarray:
    """Whole numbers in order of score (nulls first, NaN last), then x1 and y1; equal for equals."""
    column = rows.column(score)
    column = column.fill_null(0) if pa.types.is_floating(column.type) else pc.rank(column, sort_keys="ascending", tiebreaker="dense")
    by = [rows.column(score).is_valid().to_numpy(), column.to_numpy(), *(rows.column(c).cast(pa.float64()).to_numpy() for c in ("x1", "y1"))]
    if by[1].dtype.kind == "f":
        by[1] = np.unique(by[1], return_inverse=True)[1]
    at = np.lexsort(by[::-1])
    new = np.zeros(len(at), bool)
    for v in by:
        new[1:] |= v[at][1:] != v[at][:-1]
    order = np.empty(len(at), np.int64)
    order[at] = np.cumsum(new)
    return order


def spans(low: np.ndarray, high: np.ndarray, width: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last cell in which boxes of at most a cell's width that these can cover begin."""
    size, slack = high - low, 1e-9 * (width + np.abs(low) + np.abs(high))
    first = np.floor((low - (1 - share) * np.minimum(width, size / share) - slack) / width)
    return first.astype(np.int64), np.floor((high - share * size + slack) / width).astype(np.int64)


def uncovered(score: str, share: float, cell: float) -> Callable[[pa.Table], pa.Table]:
    """Of one block's rows those that are its own (_own) and that no better one covers."""

    def of(rows: pa.Table) -> pa.Table:
        own, level = rows.column("_own").to_numpy(), rows.column("_level")[0].as_py()
        kept = rows.select([c for c in rows.column_names if not c.startswith("_")])
        if level < 0 or not own.any():
            return kept.filter(pa.array(own))
        width = cell * 2.0**level
        box = np.stack([rows.column(c).cast(pa.float64()).to_numpy() for c in CORNERS])
        order, area = order_of(rows, score), (box[2] - box[0]) * (box[3] - box[1])
        low, high = np.minimum(box[:2], box[2:]), np.maximum(box[:2], box[2:])
        mine = np.flatnonzero(own)
        at = np.floor(low[:, mine] / width).astype(np.int64)
        base, size = at.min(1), at.max(1) - at.min(1) + 1
        cells = (at[0] - base[0]) * size[1] + at[1] - base[1]
        by = np.lexsort([-order[mine], cells])
        mine, cells = mine[by], cells[by]
        (x, x_last), (y, y_last) = (spans(low[k], high[k], width, share) for k in (0, 1))
        x, y = np.maximum(x - base[0], 0), np.maximum(y - base[1], 0)
        nx, ny = (np.maximum(0, np.minimum(last - base[k], size[k] - 1) - v + 1) for k, last, v in ((0, x_last, x), (1, y_last, y)))
        n = nx * ny
        other = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(other)) - np.repeat(np.cumsum(n) - n, n)
        there = (x[other] + k // ny[other]) * size[1] + y[other] + k % ny[other]
        by = np.lexsort([-order[other], there])
        other, there = other[by], there[by]
        names, start = np.unique(cells, return_index=True)
        ends = np.append(start[1:], len(cells))
        first, last = np.searchsorted(there, names, "left"), np.searchsorted(there, names, "right")
        covered = np.zeros(len(own), bool)

        def covers(b: np.ndarray, a: np.ndarray) -> np.ndarray:
            p, q = box[:, a], box[:, b]
            common = (np.minimum(p[2], q[2]) - np.maximum(p[0], q[0])) * (np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]))
            meet = (p[0] <= q[2]) & (q[0] <= p[2]) & (p[1] <= q[3]) & (q[1] <= p[3])
            return (order[b] > order[a]) & meet & (common > share * (area[a] + area[b] - common))

        few = (ends - start) * (last - first) <= FEW
        for b, a in pairs_of(mine, start[few], ends[few], other, first[few], last[few]):
            covered[a[covers(b, a)]] = True
        for i in np.flatnonzero(~few):
            left, at = mine[start[i] : ends[i]], first[i]
            while at < last[i]:
                left = left[np.searchsorted(-order[left], -order[other[at]], "right") :]  # none of the rest is better than those before
                if not len(left):
                    break
                some = other[at : min(last[i], at + max(1, min(AT_ONCE // len(left), 256)))]
                at += len(some)
                hit = covers(some[:, None], left[None, :]).any(0)
                covered[left[hit]] = True
                left = left[~hit]
        return kept.filter(pa.array(own & ~covered))

    return of


def pairs_of(a: np.ndarray, start: np.ndarray, ends: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (of b, of a) of cells, given by stretches of both, many cells at once."""
    wide = last - first
    n = (ends - start) * wide
    portion = np.cumsum(n) // AT_ONCE
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(portion)) + 1):
        cell = np.repeat(some, n[some])
        k = np.arange(len(cell)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        yield b[first[cell] + k % wide[cell]], a[start[cell] + k // wide[cell]]
