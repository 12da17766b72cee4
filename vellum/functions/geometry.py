"""Rectangles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_share(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Share of rectangle ``a`` that lies inside ``b``; 0 where they do not meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1e-9))
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(F.lit(0.0))


def horizontal_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common width of two spans as a share of the smaller one."""
    common = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return common / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-9))
