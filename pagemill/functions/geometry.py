"""Bounding boxes as Columns: no UDF, so every expression stays in generated code.

A box is a :class:`Box` of four Columns.  Its origin is TOPLEFT unless stated; BOTTOMLEFT boxes
have t > b.  Where an input has no defined result the functions give null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP, BOTTOM = "TOPLEFT", "BOTTOMLEFT"


class Box(NamedTuple):
    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for n, c in self._asdict().items()]


def box(prefix: str = "") -> Box:
    """The box in the columns l, t, r, b, all with a prefix."""
    return Box(*(F.col(f"{prefix}{n}") for n in "ltrb"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def width(x: Box) -> Column:
    return x.r - x.l


def height(x: Box) -> Column:
    return F.abs(x.t - x.b)


def half_extent(x: Box) -> tuple[Column, Column]:
    return (x.r - x.l) / 2, (x.b - x.t) / 2


def center(x: Box) -> tuple[Column, Column]:
    return (x.l + x.r) / 2, (x.t + x.b) / 2


def area(x: Box, origin: str = TOP) -> Column:
    a = (x.r - x.l) * (x.b - x.t)
    return a if origin == TOP else -a


def valid(x: Box, origin: str = TOP) -> Column:
    """No negative edge, some width, and top and bottom on the sides that the origin asks for."""
    upright = x.t < x.b if origin == TOP else x.t > x.b
    return (x.l >= 0) & (x.t >= 0) & (x.r >= 0) & (x.b >= 0) & (x.l < x.r) & upright


def scaled(x: Box, by: Column | float) -> Box:
    return Box(*(c * by for c in x))


def normalized(x: Box, w: Column | float, h: Column | float) -> Box:
    return Box(x.l / w, x.t / h, x.r / w, x.b / h)


def unnormalized(x: Box, w: Column | float, h: Column | float) -> Box:
    return Box(x.l * w, x.t * h, x.r * w, x.b * h)


def _clamp(c: Column, high: Column | float) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(high) if not isinstance(high, Column) else high))


def clipped(x: Box, w: Column | float, h: Column | float) -> Box:
    return Box(_clamp(x.l, w), _clamp(x.t, h), _clamp(x.r, w), _clamp(x.b, h))


def relative_to(x: Box, ref: Box, origin: str = TOP) -> Box:
    """The box as seen from a corner of ``ref``, floored at 0."""
    floor = lambda c: F.greatest(F.lit(0), c)
    if origin == TOP:
        return Box(floor(x.l - ref.l), floor(x.t - ref.t), floor(x.r - ref.l), floor(x.b - ref.t))
    return Box(floor(x.l - ref.l), floor(x.t - ref.b), floor(x.r - ref.l), floor(x.b - ref.b))


def from_tuple(a: Column, b: Column, c: Column, d: Column, origin: str = TOP) -> Box:
    """Two corners in any order; equal edges stay and make the box invalid."""
    low, high = F.least(b, d), F.greatest(b, d)
    return Box(F.least(a, c), low if origin == TOP else high, F.greatest(a, c), high if origin == TOP else low)


def intersection(x: Box, y: Box) -> Column:
    """Common area; 0 where the boxes only touch."""
    w = F.least(x.r, y.r) - F.greatest(x.l, y.l)
    h = F.least(x.b, y.b) - F.greatest(x.t, y.t)
    return F.when((w <= 0) | (h <= 0), 0).otherwise(w * h)


def over_self(x: Box, y: Box) -> Column:
    return _ratio(intersection(x, y), area(x))


def over_union(x: Box, y: Box) -> Column:
    i = intersection(x, y)
    return _ratio(i, area(x) + area(y) - i)


def over_minimum(x: Box, y: Box) -> Column:
    return _ratio(intersection(x, y), F.least(area(x), area(y)))


def overlaps(x: Box, y: Box) -> Column:
    """Open rectangles meet."""
    return (x.r > y.l) & (x.l < y.r) & (x.b > y.t) & (x.t < y.b)


def contains_center(outer: Box, inner: Box) -> Column:
    """The middle of ``inner`` lies in the closed ``outer``."""
    cx, cy = center(inner)
    return (outer.l <= cx) & (cx <= outer.r) & (outer.t <= cy) & (cy <= outer.b)


def vertical_distance(x: Box, y: Box) -> Column:
    return F.least(F.abs(y.t - x.b), F.abs(x.t - y.b))


#: Known quirk kept for equal results: this is the vertical formula as well.
horizontal_distance = vertical_distance


def not_too_low(x: Box, y: Box, limit: float = 0.01) -> Column:
    return F.greatest(x.b - y.b, F.lit(0)) <= limit * height(x)


def not_too_high(x: Box, y: Box, limit: float = 0.01) -> Column:
    return F.greatest(y.t - x.t, F.lit(0)) <= limit * height(x)


def inside(x: Box, y: Box, limit: float = 0.2) -> Column:
    left = F.when(x.l >= y.l, F.abs(x.t - y.t) <= limit * height(x)).otherwise(True)
    right = F.when(x.r <= y.r, F.abs(x.r - y.r) <= limit * height(x)).otherwise(True)
    return left & right


def flipped(x: Box, page_height: Column | float) -> Box:
    """From one origin to the other."""
    return Box(x.l, page_height - x.t, x.r, page_height - x.b)


def rotated(x: Box, angle: Column, w: Column | float, h: Column | float) -> Box:
    """The box of the corners turned by 90, 180 or 270 degrees; others give null."""
    turned = {90: (x.t, w - x.r, x.b, w - x.l), 180: (w - x.r, h - x.b, w - x.l, h - x.t), 270: (h - x.b, x.l, h - x.t, x.r)}
    return Box(*(F.when(angle == 90, a).when(angle == 180, b).when(angle == 270, c) for a, b, c in zip(*turned.values(), strict=True)))


def union_of(x: Box) -> Box:
    """Aggregates: the bounding rectangle of a group."""
    return Box(F.min(x.l), F.min(x.t), F.max(x.r), F.max(x.b))


def truncated(c: Column) -> Column:
    return c.cast("int")


def from_grid(ymin: Column, xmin: Column, ymax: Column, xmax: Column, w: Column, h: Column, grid: float = 1000.0) -> Box:
    """Row-first grid coordinates to pixels."""
    return Box(xmin / grid * w, ymin / grid * h, xmax / grid * w, ymax / grid * h)


def from_grid_ordered(x: Box, w: Column, h: Column, grid: int = 999) -> Box:
    """Column-first grid coordinates to pixels, each pair in order."""
    ordered = from_tuple(*x)
    return Box(ordered.l * w / grid, ordered.t * h / grid, ordered.r * w / grid, ordered.b * h / grid)


def from_grid_truncated(x: Box, w: Column, h: Column, grid: int = 1024) -> Box:
    """Column-first grid coordinates to whole pixels within the image."""
    sx, sy = w / grid, h / grid
    return Box(F.greatest(F.lit(0), truncated(x.l * sx)), F.greatest(F.lit(0), truncated(x.t * sy)), F.least(truncated(x.r * sx), w), F.least(truncated(x.b * sy), h))


def unresized(x: Box, sx: Column, sy: Column) -> Box:
    """Pixels of a resized image to whole pixels of the first one."""
    return Box(truncated(x.l / sx), truncated(x.t / sy), truncated(x.r / sx), truncated(x.b / sy))


def from_bottom_left(x: Box, page_height: Column) -> Box:
    """To a TOPLEFT box, floored at 0; null where that is no valid box."""
    floor = lambda c: F.greatest(F.lit(0), c)
    y = Box(floor(x.l), floor(page_height - x.t), floor(x.r), floor(page_height - x.b))
    return Box(*(F.when(valid(y), c) for c in y))


def crop(x: Box, w: Column, h: Column) -> Box:
    """Whole pixels to cut from an image of w x h."""
    return Box(*(truncated(c) for c in clipped(x, w, h)))
