"""Axis-aligned boxes as four DOUBLE columns x0, y0, x1, y1; touching boxes don't overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The four sides of a box as columns."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        """The box in the columns of that prefix."""
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def sides(self) -> tuple[Column, ...]:
        return self.x0, self.y0, self.x1, self.y1

    def named(self, prefix: str = "") -> list[Column]:
        """The sides as output columns."""
        return [c.alias(f"{prefix}{n}") for c, n in zip(self.sides, ("x0", "y0", "x1", "y1"), strict=True)]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid(b: Box) -> Column:
    """Four finite numbers with positive extent on both axes."""
    checks = [finite(c) for c in b.sides]
    return checks[0] & checks[1] & checks[2] & checks[3] & (b.x1 > b.x0) & (b.y1 > b.y0)


def error_code(b: Box, width: Column, height: Column) -> Column:
    """The first fault of a box on its page, or null: missing sides, non-finite sides, no extent, beyond the page."""
    missing = b.x0.isNull() | b.y0.isNull() | b.x1.isNull() | b.y1.isNull()
    odd = ~(finite(b.x0) & finite(b.y0) & finite(b.x1) & finite(b.y1))
    outside = (b.x0 < 0) | (b.y0 < 0) | (b.x1 > width) | (b.y1 > height)
    cascade = F.when(missing, "INVALID_BBOX_SHAPE").when(odd, "NONFINITE_BBOX")
    return cascade.when((b.x0 >= b.x1) | (b.y0 >= b.y1), "NONPOSITIVE_BBOX").when(outside, "OUT_OF_BOUNDS_BBOX")


def scaled(b: Box, sx: Column | float, sy: Column | float) -> Box:
    """The box in another unit; null where it is invalid or a scale isn't positive."""
    sx, sy = (F.lit(s) if isinstance(s, int | float) else s for s in (sx, sy))
    fine = valid(b) & (sx > 0) & (sy > 0)
    return Box(*(F.when(fine, c * s) for c, s in zip(b.sides, (sx, sy, sx, sy), strict=True)))


def extent(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(b: Box) -> Column:
    return extent(b.x0, b.x1) * extent(b.y0, b.y1)


def overlap(a: Box, b: Box) -> Column:
    """The area that two boxes share."""
    return extent(F.greatest(a.x0, b.x0), F.least(a.x1, b.x1)) * extent(F.greatest(a.y0, b.y0), F.least(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Shared over joint area; 0 where there is no joint area."""
    shared = overlap(a, b)
    joint = area(a) + area(b) - shared
    return F.when(joint > 0, shared / joint).otherwise(F.lit(0.0))


def clamped(b: Box, width: Column, height: Column) -> Box:
    """The part of the box on the page."""
    on = lambda c, most: F.greatest(F.lit(0.0), F.least(c, most))
    return Box(on(b.x0, width), on(b.y0, height), on(b.x1, width), on(b.y1, height))


def envelope_of(xs: list[Column], ys: list[Column]) -> Box:
    """The box around some points."""
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def choose(rotation: Column, *cases: Column) -> Column:
    """One of four cases, by a rotation of 0, 90, 180 or 270 degrees; null for any other."""
    out = None
    for angle, case in zip((0, 90, 180, 270), cases, strict=True):
        out = F.when(rotation == angle, case) if out is None else out.when(rotation == angle, case)
    return out


def rotated(b: Box, rotation: Column, visible: Box) -> Box:
    """From PDF space, y upwards, to the visible frame, y downwards, of a page that is shown turned: the envelope of the corners."""
    turn = lambda x, y: (
        choose(rotation, x - visible.x0, y - visible.y0, visible.x1 - x, visible.y1 - y),
        choose(rotation, visible.y1 - y, x - visible.x0, y - visible.y0, visible.x1 - x),
    )
    points = [turn(x, y) for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    return envelope_of([p[0] for p in points], [p[1] for p in points])


def unrotated(b: Box, rotation: Column, visible: Box) -> Box:
    """The inverse of :func:`rotated`."""
    back = lambda u, v: (
        choose(rotation, visible.x0 + u, visible.x0 + v, visible.x1 - u, visible.x1 - v),
        choose(rotation, visible.y1 - v, visible.y0 + u, visible.y0 + v, visible.y1 - u),
    )
    points = [back(x, y) for x in (b.x0, b.x1) for y in (b.y0, b.y1)]
    return envelope_of([p[0] for p in points], [p[1] for p in points])


def normalized(b: Box, width: Column, height: Column) -> Box:
    """Shares of the page's sides, not clipped; null where the box is invalid or leaves the page."""
    fine = valid(b) & (b.x0 >= 0) & (b.y0 >= 0) & (b.x1 <= width) & (b.y1 <= height)
    return Box(*(F.when(fine, c / s) for c, s in zip(b.sides, (width, height, width, height), strict=True)))


def crop_pixels(b: Box, scale: Column | float, padding: int, width: Column, height: Column) -> Box:
    """The whole pixels around a box with some padding, within the image."""
    scale = F.lit(float(scale)) if isinstance(scale, int | float) else scale
    low = lambda c: F.greatest(F.lit(0.0), F.floor(c * scale).cast("double") - padding)
    high = lambda c, most: F.least(most, F.ceil(c * scale).cast("double") + padding)
    return Box(low(b.x0), low(b.y0), high(b.x1, width), high(b.y1, height))
