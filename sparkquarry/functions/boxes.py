"""Boxes as four columns x0, y0, x1, y1; vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The four columns of a box, as doubles."""
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def center_inside(a: Box, b: Box) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return (x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])


def inside(a: Box, b: Box, share: float = 0.5) -> Column:
    """The centre of ``a`` is in ``b``, or ``share`` of its area."""
    return center_inside(a, b) | F.coalesce(F.try_divide(overlap(a, b), area(a)) >= share, F.lit(False))


def padded(b: Box, width: Column, height: Column) -> list[Column]:
    """A crop with a margin of 0.4 % of the page's shorter side, 6 at least, within the page."""
    pad = F.greatest(F.lit(6.0), F.round(F.least(width, height) * 0.004))
    return [F.greatest(F.lit(0.0), b[0] - pad), F.greatest(F.lit(0.0), b[1] - pad), F.least(width, b[2] + pad), F.least(height, b[3] + pad)]


def to_pixels(b: Box, dpi: Column, page_height: Column) -> list[Column]:
    """From points with the origin below to pixels with the origin above."""
    s = dpi / 72.0
    return [b[0] * s, page_height - b[3] * s, b[2] * s, page_height - b[1] * s]


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; null vectors and those of length 0 stay as they are."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
