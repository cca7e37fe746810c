"""Box algebra on columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def contains(b: Box, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x < b[2]) & (b[1] <= y) & (y < b[3])


def overlaps(a: Box, b: Box, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """Whether the boxes meet when `b` is widened by dx and dy."""
    return (a[0] < b[2] + dx) & (a[2] > b[0] - dx) & (a[1] < b[3] + dy) & (a[3] > b[1] - dy)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; a union under 1 counts as 1."""
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / F.greatest(union, F.lit(1.0))
