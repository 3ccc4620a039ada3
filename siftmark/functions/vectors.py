"""Vector expressions on arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first entry on. Null or unequal lengths give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector divided by its length; a zero vector is an error. The length stands outside of the
    element's function, so that it is computed once for each vector."""
    n = norm(a)
    n = F.when(n == 0, F.raise_error(F.lit("vector of length zero")).cast("double")).otherwise(n)
    return F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x.cast("double") / y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: int) -> Column:
    """Not null, ``dim`` finite entries, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)
