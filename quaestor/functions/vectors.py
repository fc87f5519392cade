"""Dense-vector column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a zero vector, an error when the widths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.format_string("vector widths differ: %d and %d", F.size(a), F.size(b))).cast("double")
    )


def width_ok(v: Column, width: int) -> Column:
    return F.coalesce(F.size(v) == width, F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
