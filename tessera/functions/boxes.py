"""Boxes as four columns: relative centre and size, or pixel corners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Corners:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def named(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Corners:
        return Corners(F.col(x0), F.col(y0), F.col(x1), F.col(y1))

    @staticmethod
    def of_center(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> Corners:
        """Pixel corners of a box given relative to an image."""
        return Corners((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)

    def columns(self, *names: str) -> list[Column]:
        return [c.alias(n) for c, n in zip((self.x0, self.y0, self.x1, self.y1), names or ("x0", "y0", "x1", "y1"), strict=True)]

    def width(self) -> Column:
        return self.x1 - self.x0

    def height(self) -> Column:
        return self.y1 - self.y0

    def area(self, resolution: float = 1.0) -> Column:
        return self.width() * self.height() * (resolution * resolution)

    def center(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def shifted(self, left: Column, top: Column) -> Corners:
        """Patch pixels to tile pixels."""
        return Corners(self.x0 + left, self.y0 + top, self.x1 + left, self.y1 + top)

    def grown(self, by: float) -> Corners:
        """Wider and higher by ``by``, half of it on each side."""
        return Corners(self.x0 - by / 2, self.y0 - by / 2, self.x1 + by / 2, self.y1 + by / 2)

    def in_patch(self, left: Column, top: Column, resolution: float, grow: float = 0.0) -> Corners:
        """Map units to pixels of a patch with that upper left corner; pixel rows go down."""
        g = self.grown(grow)
        return Corners((g.x0 - left) / resolution, (top - g.y1) / resolution, (g.x1 - left) / resolution, (top - g.y0) / resolution)

    def overlaps(self, o: Corners) -> Column:
        """Common points, edges included."""
        return (self.x0 <= o.x1) & (o.x0 <= self.x1) & (self.y0 <= o.y1) & (o.y0 <= self.y1)

    def common(self, o: Corners) -> Corners:
        return Corners(F.greatest(self.x0, o.x0), F.greatest(self.y0, o.y0), F.least(self.x1, o.x1), F.least(self.y1, o.y1))

    def ring(self) -> Column:
        """The box as a closed ring of five vertices."""
        p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        return F.array(p(self.x0, self.y0), p(self.x1, self.y0), p(self.x1, self.y1), p(self.x0, self.y1), p(self.x0, self.y0))


def area_between(area: Column, least: float | None, most: float | None) -> Column:
    """Strictly between the limits; None is no limit."""
    out = F.lit(True)
    if least is not None:
        out &= area > least
    if most is not None:
        out &= area < most
    return out


def edge_ratio_over(w: Column, h: Column, ratio: float) -> Column:
    """Whether both quotients of the edges exceed a ratio; an edge of length 0 fails."""
    return F.coalesce((F.try_divide(w, h) > ratio) & (F.try_divide(h, w) > ratio), F.lit(False))


def rescaled(c: Column, to: float, size: float) -> Column:
    """A prompt's coordinate on an image of another size; negative ones, which pad, are -1."""
    return F.when(c >= 0, c * F.lit(to) / F.lit(float(size))).otherwise(-1.0)
