"""Vector columns as arrays: dot products, lengths, distances, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a length is 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def printed(a: Column, digits: int = 6) -> Column:
    """The numbers with so many significant digits, joined by commas."""
    return F.concat_ws(",", F.transform(a, lambda x: F.format_string(f"%.{digits}g", x.cast("double"))))
