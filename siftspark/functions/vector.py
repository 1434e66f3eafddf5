"""Vector functions on arrays of float, as Columns. Sums are of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def dot(a: Column, b: Column) -> Column:
    """Over the length of the shorter one."""
    a, b = _same(a, b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    a, b = _same(a, b)
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    # The length is bound once, as the only element of an array; a transform would take it anew for each coordinate.
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n)))
    return F.element_at(scaled, 1)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: Euclid for l2, else 1 - dot (of unit vectors)."""
    return l2(a, b) if metric == "l2" else 1 - dot(a, b)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer: 1 / (1 + distance) for l2, else dot."""
    return 1 / (1 + l2(a, b)) if metric == "l2" else dot(a, b)


def valid(a: Column, dim: int) -> Column:
    """Not null, of length dim, all finite."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(a.isNotNull() & (F.size(a) == dim) & ~bad, F.lit(False))


def pad_or_trim(a: Column, dim: int) -> Column:
    """To length dim: cut, or padded with 0.15 of the values from the start again; then unit length. Empty or null: the first axis."""
    n = F.size(a)
    item = lambda i: F.when(i < n, F.element_at(a, F.least(i + 1, n)).cast("double")).otherwise(F.element_at(a, (i % n) + 1).cast("double") * 0.15)
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), item)
    axis = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), dim - 1))
    return F.when(a.isNull() | (n <= 0), axis).otherwise(normalize(filled))
