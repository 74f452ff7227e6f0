"""Vector expressions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from borelight.functions.scalars import col


def dot(a, b) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine01(a, b) -> Column:
    """Cosine mapped to [0, 1]; 0 for a vector of zeros."""
    length = norm(a) * norm(b)
    mapped = (dot(a, b) / length + 1.0) / 2.0
    return F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mapped))).otherwise(0.0)


def unit(a) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: (x / n).cast("float")))


def check_dimension(vec, n: int) -> Column:
    """The vector itself, or an error when its width is not `n`. NULL passes."""
    v = col(vec)
    wrong = F.concat(F.lit(f"expected {n} values, got "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == n), v).otherwise(F.raise_error(wrong))
