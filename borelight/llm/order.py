"""Cut a table into ordered pieces of roughly equal size without sorting it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOTS = 256  # quantile ranges of the key; inside a range pieces are of equal width


def piece_of(df: DataFrame, key: str, piece_rows: int) -> tuple[Column, int]:
    """A column that never falls as the whole number `key` rises, 0 .. n - 1, with about `piece_rows` rows a piece; and n.

    One pass over `key` finds approximate quantiles; equal keys share a piece and null keys go to piece 0. The bounds only
    balance the work: whatever they are, pieces follow the order of the key.
    """
    probs = [i / KNOTS for i in range(KNOTS + 1)]
    got = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(key).cast("long"), probs, 10_000).alias("q")).first()
    knots = sorted(set(got["q"] or []))
    if len(knots) < 2:
        return F.lit(0), 1
    parts = max(1, math.ceil(got["n"] / piece_rows / (len(knots) - 1)))
    merge = max(1, math.floor(piece_rows * (len(knots) - 1) / max(1, got["n"])))
    knots = knots[:-1:merge] + knots[-1:]
    value = F.col(key).cast("long")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(value >= knots[mid], search(mid, hi)).otherwise(search(lo, mid - 1))

    at = search(0, len(knots) - 2)
    low = F.element_at(F.array(*map(F.lit, knots)), at + 1).cast("double")
    high = F.element_at(F.array(*map(F.lit, knots)), at + 2).cast("double")
    inside = F.floor((value.cast("double") - low) / (high - low) * parts)
    inside = F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)) if parts > 1 else F.lit(0)
    return F.coalesce((at * parts + inside).cast("int"), F.lit(0)), (len(knots) - 1) * parts
