"""Box geometry as column expressions. A box is a struct or four columns x0, y0, x1, y1, origin top-left."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{n}") for n in cls._fields])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(self, self._fields)])


def flip(b: Box, page_height: Column, scale: float = 1.0) -> Box:
    """From a bottom-left origin, with an optional resolution factor."""
    return Box(b.x0 * scale, (page_height - b.y1) * scale, b.x1 * scale, (page_height - b.y0) * scale)


def raw_area(b: Box) -> Column:
    return b.width * b.height


def area(b: Box) -> Column:
    return F.when((b.width > 0) & (b.height > 0), raw_area(b)).otherwise(0.0)


def intersection(a: Box, b: Box) -> Column:
    """Shared area; boxes that only touch share none."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def valid(b: Box) -> Column:
    return (b.x0 <= b.x1) & (b.y0 <= b.y1)


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def containment(a: Box, b: Box, threshold: float | None = None) -> Column:
    """The part of ``a`` inside ``b``; below the threshold, if one is given, it counts as 0."""
    part = F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)
    return part if threshold is None else F.when(part >= threshold, part).otherwise(0.0)


def subregion(a: Box, b: Box, least: float = 0.9) -> Column:
    return valid(a) & valid(b) & (area(a) > 0) & (containment(a, b) >= least)


def within(a: Box, b: Box, slack: float = 2.0) -> Column:
    return (a.x0 >= b.x0 - slack) & (a.y0 >= b.y0 - slack) & (a.x1 <= b.x1 + slack) & (a.y1 <= b.y1 + slack)


def near_within(a: Box, b: Box, across: float = 0.2, down: float = 0.3) -> Column:
    """Inside ``b`` but for a slack in proportion to its sides; sides may not touch the slack's edge."""
    dx, dy = b.width * across, b.height * down
    return (a.x0 > b.x0 - dx) & (a.x1 < b.x1 + dx) & (a.y0 > b.y0 - dy) & (a.y1 < b.y1 + dy)


def stacked(a: Box, b: Box, gap: float = 0.5, share: float = 0.5) -> Column:
    """Boxes that meet vertically and overlap horizontally by a share of the narrower one."""
    meet = F.abs(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)) <= gap
    narrow = F.least(a.width, b.width)
    overlap = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    return meet & (F.when(narrow > 0, overlap / narrow).otherwise(0.0) >= share)


def merged(*boxes: Box) -> Box:
    """The least box around all of them."""
    lo = [F.least(*c) if len(c) > 1 else c[0] for c in (list(z) for z in zip(*[(b.x0, b.y0) for b in boxes]))]
    hi = [F.greatest(*c) if len(c) > 1 else c[0] for c in (list(z) for z in zip(*[(b.x1, b.y1) for b in boxes]))]
    return Box(*lo, *hi)


def bounds() -> list[Column]:
    """Aggregates for the least box around the rows of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def corners(b: Box, clockwise: bool = True) -> Column:
    tour = [(b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1)] if clockwise else [(b.x0, b.y0), (b.x0, b.y1), (b.x1, b.y1), (b.x1, b.y0)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in tour])


def normalised(b: Box, width: Column, height: Column) -> Box:
    return Box(b.x0 / width, b.y0 / height, b.x1 / width, b.y1 / height)


def denormalised(b: Box, width: Column, height: Column) -> Box:
    return Box(b.x0 * width, b.y0 * height, b.x1 * width, b.y1 * height)


def position(b: Box, width: Column, height: Column) -> Column:
    """Margins, size and centre relative to the page."""
    n = normalised(b, width, height)
    named = {"top_margin": n.y0, "bottom_margin": 1 - n.y1, "left_margin": n.x0, "right_margin": 1 - n.x1, "width": n.width, "height": n.height, "center_x": (n.x0 + n.x1) / 2, "center_y": (n.y0 + n.y1) / 2}
    return F.struct(*[c.alias(k) for k, c in named.items()])


def relative(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """relative_x, relative_y and indent_ratio; null where the page has no size."""
    sized = (width > 0) & (height > 0)
    return {"relative_x": F.when(sized, b.x0 / width), "relative_y": F.when(sized, b.y0 / height), "indent_ratio": F.when(sized, b.x0 / width)}


def expanded(b: Box, width: Column, height: Column, by: float = 8.0) -> Box:
    """Grown on all sides, but not beyond the page."""
    zero = F.lit(0.0)
    return Box(F.greatest(zero, b.x0 - by), F.greatest(zero, b.y0 - by), F.least(width, b.x1 + by), F.least(height, b.y1 + by))


def columns_order(b: Box) -> list[Column]:
    """Lower edge first, then left to right: the order for boxes with a bottom-left origin."""
    return [b.y0.desc(), b.x0.asc()]
