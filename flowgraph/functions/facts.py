"""Sets of facts as array columns: meet and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def facts_meet(a: Column, b: Column, mode: str = "union") -> Column:
    """The meet of two sets: their union, or their intersection, sorted."""
    return F.array_sort(F.array_union(a, b) if mode == "union" else F.array_intersect(a, b))


def facts_compare(a: Column, b: Column) -> Column:
    """0 for equal sets, -1 if a is a proper subset of b, 1 if it is the other way, null if neither holds."""
    inside, around = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return F.when(inside & around, 0).when(inside, -1).when(around, 1)


def comparable(a: Column, b: Column) -> Column:
    return facts_compare(a, b).isNotNull()


def less(a: Column, b: Column, or_equal: bool = False) -> Column:
    """Whether a is below b (a subset); false for sets that do not compare."""
    below = facts_compare(a, b)
    return F.coalesce(below <= 0 if or_equal else below < 0, F.lit(False))


def greater(a: Column, b: Column, or_equal: bool = False) -> Column:
    return less(b, a, or_equal)
