"""Expressions over half-open spans [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(start: Column, end: Column) -> Column:
    return end - start


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length; 0 when the spans only touch or lie apart."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    return F.greatest(shared, shared * 0)


def intersects(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) > F.greatest(s1, s2)


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at < end)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The gap between two spans; 0 if they meet."""
    gap = F.greatest(s1 - e2, s2 - e1)
    return F.greatest(gap, gap * 0)
