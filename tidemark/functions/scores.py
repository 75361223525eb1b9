"""Arrays of numbers: products, norms, softmax, best classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(F.transform(v, lambda x: x.cast("double")), lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def softmax(logits: Column, scale: float = 100.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(scale * (x - top)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def best_of(p: Column, first: int = 0) -> Column:
    """The largest value from position ``first`` on."""
    return F.array_max(F.slice(p, first + 1, 1 << 20))


def argmax(p: Column) -> Column:
    """The first position of the largest value, from 0."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
