"""Dense vector functions, in double precision inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def normalised(a: Column) -> Column:
    """Norm 1; a norm of 0 stays. The norm is bound once, as an expression within a lambda is evaluated for each element."""
    over = lambda n: F.transform(a, lambda x: x.cast("double") / n)
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(over(n))), F.lit(0))


def quantised(x: Column, scale: int = 1_000_000) -> Column:
    return F.floor(x * scale + F.lit(0.5)).cast("long")
