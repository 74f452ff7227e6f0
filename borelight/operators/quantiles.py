"""Exact interpolated quantiles per key that stay distributed for very large keys.

Ordinary keys use Spark's `percentile`. For keys above `max_rows` the values are counted in monotone
cells, the one or two cells holding the wanted ranks are found from the counts, and only those cells'
values are looked at again. Many columns of a whole table are selected together by the bits of their values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borelight.operators.skew import (
    HOT_ROWS,
    broadcast_within,
    cells_per_knot,
    hot_keys,
    knot_array,
    null_safe,
    with_cell,
)


LEVEL_BITS = 16
CELLS = 256  # histograms of 2**16 counts that a task holds at once


def _clean(c):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    probs: list[float],
    max_rows: int = HOT_ROWS,
    approx: bool = False,
) -> DataFrame:
    """One row per key; each column in `cols` becomes an array with one value per probability."""
    if approx:
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(_clean(c), list(probs), 10000).alias(c) for c in cols]
        )
    if not keys:
        n = df.count()
        if n * len(cols) > max_rows:
            found = column_quantiles(df, cols, probs)
            return df.sparkSession.createDataFrame([tuple(found[c] for c in cols)], ", ".join(f"`{c}` array<double>" for c in cols))
    plain = [F.percentile(_clean(c), F.array(*[F.lit(float(p)) for p in probs])).alias(c) for c in cols]
    hot = hot_keys(df, keys, max_rows)
    n_hot = hot.count()
    if n_hot == 0:
        return df.groupBy(*keys).agg(*plain)
    hot = broadcast_within(hot.select(*[F.col(k).alias(k + "_h") for k in keys], "_n"), n_hot)
    cond = null_safe(df, hot, keys, "_h")
    big = _hot_quantiles(df.join(hot, cond, "left_semi") if keys else df, keys, cols, probs, max_rows, n_hot)
    if not keys:
        return big
    return df.join(hot, cond, "left_anti").groupBy(*keys).agg(*plain).unionByName(big)


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; the two zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _from_bits(key: int) -> float:
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _cell_counts(df: DataFrame, cols: list[str], wanted: list[tuple[int, int]], level: int) -> DataFrame:
    """(col, cell, sub, n): of the values of column `col` whose leading level x 16 bits are `cell`, how many have the next 16 bits `sub`.

    A task adds up one histogram for each wanted cell and sends only what is not zero."""
    shift = np.uint64(64 - LEVEL_BITS * (level + 1))

    def count(batches):
        hist = {w: np.zeros(1 << LEVEL_BITS, dtype=np.int64) for w in wanted}
        of_col: dict = {}
        for c, cell in wanted:
            of_col.setdefault(c, []).append(cell)
        for b in batches:
            for c, cells in of_col.items():
                column = b.column(c).drop_null()
                key = _ordered_bits(column.to_numpy(zero_copy_only=False)) >> shift
                for cell in cells:
                    some = key if level == 0 else key[key >> np.uint64(LEVEL_BITS) == np.uint64(cell)]
                    sub, n = np.unique((some & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.uint16), return_counts=True)
                    hist[c, cell][sub] += n
        for (c, cell), h in hist.items():
            at = np.flatnonzero(h)
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, c, np.int32)), pa.array([str(cell)] * k, pa.string()), pa.array(at.astype(np.int32)), pa.array(h[at])],
                names=["col", "cell", "sub", "n"])

    rows = df.select(*[_clean(c).alias(f"c{i}") for i, c in enumerate(cols)])
    return rows.mapInArrow(count, "col int, cell string, sub int, n long").groupBy("col", "cell", "sub").agg(F.sum("n").alias("n"))


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact interpolated quantiles of many columns of a whole table, None for a column without values; NaN counts as unknown.

    Selection by radix: the first scan counts every column's values by their leading 16 bits, each of the three that follow only the
    cells that hold a wanted rank by the next 16. A task holds at most CELLS histograms (more cells: more scans), whatever the rows; per
    column and cell at most 65,536 counts are shuffled, and the driver gets one row for each wanted rank.
    """
    spark = df.sparkSession
    sizes = df.agg(*[F.count(_clean(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    ranks = {(i, r): (0, r) for i in range(len(cols)) if sizes[i] for p in probs for x in [p * (sizes[i] - 1)] for r in (math.floor(x), math.ceil(x))}
    for level in range(64 // LEVEL_BITS):
        cells = sorted({(i, cell) for (i, _), (cell, _) in ranks.items()})
        found = {}
        for lo in range(0, len(cells), CELLS):
            some = cells[lo : lo + CELLS]
            here = set(some)
            asked = [(i, str(cell), r, left) for (i, r), (cell, left) in ranks.items() if (i, cell) in here]
            counts = _cell_counts(df, cols, some, level)
            upto = Window.partitionBy("col", "cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
            counts = counts.withColumn("end", F.sum("n").over(upto))
            ask = F.broadcast(spark.createDataFrame(asked, "col int, cell string, rank long, left long"))  # two rows a column and probability
            hit = counts.join(ask, ["col", "cell"]).where((F.col("left") < F.col("end")) & (F.col("left") >= F.col("end") - F.col("n")))
            for x in hit.select("col", "rank", "cell", "sub", (F.col("left") - F.col("end") + F.col("n")).alias("left")).collect():
                found[x["col"], x["rank"]] = ((int(x["cell"]) << LEVEL_BITS) | x["sub"], x["left"])
        ranks = found
    out: dict = {}
    for i, c in enumerate(cols):
        values = []
        for p in probs if sizes[i] else ():
            x = p * (sizes[i] - 1)
            a, b = (_from_bits(ranks[i, r][0]) for r in (math.floor(x), math.ceil(x)))
            values.append(a if a == b else a * (1 - (x - math.floor(x))) + b * (x - math.floor(x)))
        out[c] = values or None
    return out


def _hot_quantiles(df, keys, cols, probs, max_rows, n_hot):
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("_col"), _clean(c).alias("_v")) for c in cols])
        ).alias("_e"),
    ).select(*keys, "_e._col", "_e._v").where(F.col("_v").isNotNull())
    ck = [*keys, "_col"]
    stats = long.groupBy(*ck).agg(
        F.count(F.lit(1)).alias("_n"), knot_array(F.col("_v")).alias("_knots")
    )
    small = broadcast_within(
        stats.select(
            *[F.col(k).alias(k + "_s") for k in ck],
            "_n",
            "_knots",
            cells_per_knot(F.col("_n"), max_rows).alias("_per"),
        ),
        n_hot * len(cols),
    )
    cells = with_cell(long.join(small, null_safe(long, small, ck, "_s")), "_v", "_knots", "_per").select(
        *ck, "_v", "_n", "_cell"
    )
    counts = cells.groupBy(*ck, "_cell").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")
    )
    upto = Window.partitionBy(*ck).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("r"))
            for i, p in enumerate(probs)
        ]
    )
    need = (
        counts.withColumn("_end", F.sum("_c").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn(
            "_ranks",
            F.filter(
                ranks,
                lambda x: (F.ceil(x["r"]) >= F.col("_start")) & (F.floor(x["r"]) < F.col("_end")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .select(*[F.col(k).alias(k + "_t") for k in ck], F.col("_cell").alias("_cell_t"), "_start", "_ranks")
    )
    need = broadcast_within(need, n_hot * len(cols) * len(probs) * 2)
    near = cells.join(need, null_safe(cells, need, [*ck, "_cell"], "_t"))
    vals = near.groupBy(*ck, "_cell", "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_start").alias("_start"), F.first("_ranks").alias("_ranks")
    )
    inside = Window.partitionBy(*ck, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vals = (
        vals.withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .withColumn("_x", F.explode("_ranks"))
        .select(*ck, "_v", "_lo", "_hi", F.col("_x.i").alias("_i"), F.col("_x.r").alias("_r"))
    )

    def at(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    r = F.col("_r")
    picked = vals.groupBy(*ck, "_i", "_r").agg(at(F.floor(r)).alias("_a"), at(F.ceil(r)).alias("_b"))
    frac = F.col("_r") - F.floor("_r")
    picked = picked.withColumn("_q", F.col("_a") * (1 - frac) + F.col("_b") * frac)
    wide = picked.groupBy(*keys).agg(
        *[
            F.array(
                *[
                    F.max(F.when((F.col("_col") == c) & (F.col("_i") == i), F.col("_q")))
                    for i in range(len(probs))
                ]
            ).alias(c)
            for c in cols
        ]
    )
    none = lambda c: F.forall(F.col(c), lambda x: x.isNull())
    wide = wide.select(*keys, *[F.when(~none(c), F.col(c)).alias(c) for c in cols])
    if not keys:
        return wide
    every = df.select(*keys).distinct()
    back = wide.select(*[F.col(k).alias(k + "_w") for k in keys], *cols)
    return every.join(back, null_safe(every, back, keys, "_w"), "left").select(*keys, *cols)


def group_median(
    df: DataFrame, keys: list[str], cols: dict[str, str], max_rows: int = HOT_ROWS, approx: bool = False
) -> DataFrame:
    """Exact median per key; `cols` maps source column -> result column."""
    q = group_quantiles(df, keys, list(cols), [0.5], max_rows, approx)
    return q.select(*keys, *[F.col(c)[0].alias(a) for c, a in cols.items()])
