"""Ranges of sorted values, so that one large group can be worked on in parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_of(c: Column, cuts: list) -> Column:
    """The number of ``cuts`` (sorted) that are less than c, found by bisection; null for null."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c > F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(c.isNotNull(), search(0, len(cuts)))
