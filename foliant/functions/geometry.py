"""Rectangles and intervals as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT, BOTTOM, UP, UNKNOWN = 1, 2, 3, 4, 5


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Rect:
    """The four columns of a rectangle under a prefix."""

    def __init__(self, prefix: str = ""):
        self.x, self.y, self.width, self.height = (F.col(prefix + n) for n in ("x", "y", "width", "height"))
        self.right, self.bottom = self.x + self.width, self.y + self.height
        self.cx, self.cy = self.x + self.width / 2.0, self.y + self.height / 2.0

    def half_corner(self) -> tuple[Column, Column]:
        """Half of the right and of the bottom edge, whole numbers: the points that clusters are made of."""
        return F.floor(self.right / 2), F.floor(self.bottom / 2)


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def touch(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Closed overlap: a shared end counts."""
    return (a_low <= b_high) & (b_low <= a_high)


def rect_touch(a: Rect, b: Rect) -> Column:
    return touch(a.x, a.right, b.x, b.right) & touch(a.y, a.bottom, b.y, b.bottom)


def inside(inner: Rect, outer: Rect) -> Column:
    return (outer.x <= inner.x) & (outer.y <= inner.y) & (outer.right >= inner.right) & (outer.bottom >= inner.bottom)


def rect_dist(a: Rect, b: Rect) -> Column:
    """Distance of two rectangles: between corners if they are apart on both axes, else between edges, 0 if they meet."""
    return F.sqrt(_square(_apart(a.x, a.right, b.x, b.right)) + _square(_apart(a.y, a.bottom, b.y, b.bottom)))


def _square(x: Column) -> Column:
    return x.cast("double") * x


def _apart(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0), b_low - a_high, a_low - b_high)


def position(a: Rect, b: Rect) -> Column:
    """Where a lies seen from b; unknown if the boxes are apart on both axes or on none."""
    no_x, no_y = ~touch(a.x, a.right, b.x, b.right), ~touch(a.y, a.bottom, b.y, b.bottom)
    across = F.when(a.x < b.x, LEFT).otherwise(RIGHT)
    along = F.when(a.y < b.y, UP).otherwise(BOTTOM)
    return F.when(no_x & ~no_y, across).when(~no_x & no_y, along).otherwise(UNKNOWN)


# Intervals


def overlaps(a_low, a_high, b_low, b_high) -> Column:
    return touch(_c(a_low), _c(a_high), _c(b_low), _c(b_high))


def overlaps_exclusive(a_low, a_high, b_low, b_high) -> Column:
    return (_c(a_low) < _c(b_high)) & (_c(b_low) < _c(a_high))


def within(value, low, high, kind: str = "closed") -> Column:
    """Whether a value lies in an interval that is closed, open, left_open or right_open."""
    value, low, high = _c(value), _c(low), _c(high)
    above = value > low if kind in ("open", "left_open") else value >= low
    below = value < high if kind in ("open", "right_open") else value <= high
    return above & below


def gap(a_low, a_high, b_low, b_high) -> Column:
    """The distance of two intervals, 0 if they overlap."""
    return F.when(overlaps(a_low, a_high, b_low, b_high), F.lit(0)).when(_c(a_high) < _c(b_low), _c(b_low) - _c(a_high)).otherwise(_c(a_low) - _c(b_high))


def join(a_low, a_high, b_low, b_high) -> tuple[Column, Column]:
    return F.least(_c(a_low), _c(b_low)), F.greatest(_c(a_high), _c(b_high))


def safe(low, high) -> tuple[Column, Column]:
    """The ends in order."""
    return F.least(_c(low), _c(high)), F.greatest(_c(low), _c(high))


# Single rectangles


def scale(c, zoom: float) -> Column:
    return (_c(c) * F.lit(float(zoom))).cast("int")


def baseline_shift(lower, y="y", height="height") -> Column:
    return _c(lower).cast("int") - (_c(y) + _c(height))


def dominance(r: Rect) -> tuple[Column, ...]:
    """The point whose component-wise order is containment."""
    return -r.x, -r.y, r.right, r.bottom


#: From how many times as high as wide a component is a rule that doesn't count among the heights of a page.
TALL_TIMES = 50


def tall_rect(width: Column | str = "width", height: Column | str = "height") -> Column:
    """Whether a rectangle is at least fifty times as high as wide, in whole numbers."""
    w, h = (F.col(c) if isinstance(c, str) else c for c in (width, height))
    return F.floor(h / w) >= TALL_TIMES


def elongated(width="width", height="height", times: int = 25) -> Column:
    return (_c(width) > times * _c(height)) | (_c(height) > times * _c(width))


def band_area(r: Rect, low: Column, high: Column) -> Column:
    """The area that a rectangle shares with a vertical band."""
    return F.greatest(F.lit(0), F.least(r.right, high) - F.greatest(r.x, low)) * r.height


def utf16_length(c) -> Column:
    """Code units of a string in UTF-16."""
    return (F.octet_length(F.encode(_c(c), "UTF-16LE")) / 2).cast("int")
