"""Helpers that keep one very large key from landing in one task.

Window functions need all rows of a key together. `framed` leaves ordinary keys as they are and cuts
keys above `max_rows` into pieces along the ordering column; each piece gets copies of the rows its
window frame reaches into, so row frames give the same values as on the whole key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.operators.materialise import materialised

HOT_ROWS = 5_000_000
TASK_ROWS = 500_000  # of a window's task, where keys are small enough
BROADCAST_ROWS = 200_000
KNOTS = 16


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows (reads no more than it must)."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after counting; larger frames are left to a shuffle join with AQE skew splits."""
    return F.broadcast(df) if fits(df, max_rows) else df


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast when a known upper bound on the rows of `df` is small; otherwise leave it as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Give a file scan with fewer than `per_core` partitions a core so many before costly per-row work.

    Large tables have more partitions and pass through; so do plans with a shuffle of their own. A file with few row groups
    leaves most of its partitions without rows: several a core are asked for where that matters.
    """
    run = df._jdf.queryExecution()
    if df.isStreaming or run.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    tasks = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if run.toRdd().getNumPartitions() >= tasks else df.repartition(tasks, *keys)


def position(df: DataFrame, name: str) -> Column:
    """The ordering column as a double (timestamps as microseconds)."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    return F.col(name).cast("double")


def knot_array(pos: Column) -> Column:
    return F.percentile_approx(pos, [i / KNOTS for i in range(KNOTS + 1)], 2000)


def cells_per_knot(n: Column, max_rows: int) -> Column:
    return (F.ceil(n / (max_rows * KNOTS)) * 8).cast("long")


def with_cell(df: DataFrame, pos: str, knots: str, per_knot: str, name: str = "_cell") -> DataFrame:
    """Add the monotone cell number of column `pos`: equal-width cells between neighbouring knots.

    NULL without knots; unknown positions get -1. The knot number is its own projection, so it is
    computed once per row.
    """
    below = F.size(F.filter(knots, lambda k: k <= F.col(pos)))
    df = df.withColumn("_knot", F.greatest(F.lit(1), F.least(F.size(knots) - 1, below)))
    lo, hi = F.element_at(knots, F.col("_knot")), F.element_at(knots, F.col("_knot") + 1)
    part = F.when(hi > lo, F.least(F.greatest((F.col(pos) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))
    per = F.col(per_knot)
    step = F.least(F.floor(F.coalesce(part, F.lit(0.0)) * per), per - 1)
    cell = F.when(F.col(pos).isNull(), F.lit(-1).cast("long")).otherwise(
        ((F.col("_knot") - 1) * per + step).cast("long")
    )
    return df.withColumn(name, F.when(per.isNotNull(), cell)).drop("_knot")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"{k}{suffix}"])
    return cond


@dataclass
class Framed:
    """`df` with window keys `keys`; rows with `_halo` true are copies and must be dropped after use."""

    df: DataFrame
    keys: list[str]
    split: bool

    def drop_halo(self, df: DataFrame, keep_chunk: bool = False) -> DataFrame:
        if not self.split:
            return df
        df = df.where(~F.col("_halo")).drop("_halo")
        return df if keep_chunk else df.drop("_chunk")


def hot_keys(df: DataFrame, keys: list[str], max_rows: int) -> DataFrame:
    """Keys above `max_rows` with their row count `_n` (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df` of `rows` rows shuffled by `keys` into so many tasks that one holds about TASK_ROWS; a table for one task is left as it is.

    Left to itself a shuffle has a fixed number of tasks, or merges them by compressed size, and what a task holds grows with the table.
    """
    tasks = -(-rows // TASK_ROWS)
    return df if tasks < 2 else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


def framed(
    df: DataFrame,
    keys: list[str],
    order: str,
    before: int = 0,
    after: int = 0,
    max_rows: int = HOT_ROWS,
) -> Framed:
    """Prepare `df` for row-frame windows reaching `before` rows back and `after` rows ahead.

    One counting pass over the key columns decides; without a key above `max_rows` nothing changes.
    """
    pos = position(df, order)
    big = hot_keys(df, keys, max_rows)
    hot = F.col("_n") > max_rows
    size = hot_keys(df, keys, 0).agg(
        F.count_if(hot).alias("keys"), F.sum(F.when(hot, cells_per_knot(F.col("_n"), max_rows) * KNOTS + 1)).alias("cells"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    ).first()
    n_hot = size["keys"]
    if n_hot == 0:
        return Framed(dealt(df, keys, size["rows"]), list(keys), False)

    sfx = "_h"
    big = broadcast_within(big.select(*[F.col(k).alias(k + sfx) for k in keys], "_n"), n_hot)
    hot_rows = df.join(big, null_safe(df, big, keys, sfx)).select(
        *keys, pos.alias("_pos"), "_n"
    )
    knots = hot_rows.groupBy(*keys).agg(
        F.max("_n").alias("_n"), knot_array(F.col("_pos")).alias("_knots")
    )
    knots = broadcast_within(
        knots.select(
            *[F.col(k).alias(k + sfx) for k in keys],
            "_knots",
            cells_per_knot(F.col("_n"), max_rows).alias("_per"),
        ),
        n_hot,
    )
    tagged = df.join(knots, null_safe(df, knots, keys, sfx), "left").withColumn("_pos", pos)
    tagged = with_cell(tagged, "_pos", "_knots", "_per").drop(
        *[k + sfx for k in keys], "_knots", "_per", "_pos"
    )

    cells = (
        tagged.where(F.col("_cell").isNotNull())
        .groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumn(
        "_b", F.sum("_n").over(by_cell.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_a", F.col("_b") - F.col("_n"))
    cells = cells.withColumn("_own", F.floor(F.col("_a") / max_rows).cast("long"))
    dest = [F.array("_own")]
    if before:
        reach = Window.partitionBy(*keys).orderBy("_a").rangeBetween(0, before - 1)
        cells = cells.withColumn("_next", F.collect_set("_own").over(reach))
        dest.append(F.coalesce(F.lead("_next").over(by_cell), F.array().cast("array<bigint>")))
    if after:
        reach = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(after - 1), 0)
        cells = cells.withColumn("_prev", F.collect_set("_own").over(reach))
        dest.append(F.coalesce(F.lag("_prev").over(by_cell), F.array().cast("array<bigint>")))
    cells = cells.select(
        *[F.col(k).alias(k + sfx) for k in keys],
        F.col("_cell").alias("_cell" + sfx),
        "_own",
        F.array_distinct(F.concat(*dest)).alias("_dest"),
    )
    cells = broadcast_within(cells, size["cells"])
    out = tagged.join(cells, null_safe(tagged, cells, keys + ["_cell"], sfx), "left")
    out = (
        out.drop(*[k + sfx for k in keys], "_cell" + sfx)
        .withColumn("_own", F.coalesce("_own", F.lit(0).cast("long")))
        .withColumn("_dest", F.coalesce("_dest", F.array(F.lit(0).cast("long"))))
        .withColumn("_chunk", F.explode("_dest"))
        .withColumn("_halo", F.col("_chunk") != F.col("_own"))
        .drop("_dest", "_own", "_cell")
    )
    return Framed(dealt(out, [*keys, "_chunk"], size["rows"]), list(keys) + ["_chunk"], True)


def run_starts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    is_start,
    name: str = "run_start",
    max_rows: int = HOT_ROWS,
    lag_cols: dict[str, str] | None = None,
) -> DataFrame:
    """Give every row the ordering value of the latest row at or before it where a run starts.

    `is_start` maps the lagged frame to a boolean column; `lag_cols` names the columns whose previous
    value it needs (old name -> new name).
    """
    fr = framed(df, keys, order[0], before=1, max_rows=max_rows)
    w = Window.partitionBy(*fr.keys).orderBy(*order)
    rows = fr.df
    rows = rows.select(
        "*",
        *[F.lag(c).over(w).alias(a) for c, a in (lag_cols or {}).items()],
        F.row_number().over(w).alias("_rn"),
    )
    rows = fr.drop_halo(rows, keep_chunk=True)
    mark = F.when(is_start, F.struct(*order))
    cum = Window.partitionBy(*fr.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_mark", mark).withColumn(name, F.max("_mark").over(cum))
    if fr.split:
        per_chunk = rows.groupBy(*fr.keys).agg(F.max("_mark").alias("_last"))
        back = (
            Window.partitionBy(*keys)
            .orderBy("_chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_chunk.select(
            *[F.col(k).alias(k + "_c") for k in fr.keys], F.max("_last").over(back).alias("_carry")
        )
        rows = rows.join(carry, null_safe(rows, carry, fr.keys, "_c"), "left")
        rows = rows.withColumn(name, F.coalesce(name, "_carry"))
        rows = rows.drop("_carry", "_chunk", *[k + "_c" for k in fr.keys])
    return rows.drop("_mark", "_rn", *(lag_cols or {}).values())


def with_one_row(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Attach a one-row summary to every row as struct column `name` (scalar subquery, no join)."""
    return df.withColumn(name, one.select(F.struct(*one.columns)).scalar())


def global_rank(df: DataFrame, order: list[str], name: str = "rank", buckets: int = 4096) -> DataFrame:
    """Rank all rows from 1 in the order of a hash of `order` (ties by the columns themselves).

    Rows are counted per hash bucket first, so no task sorts more than one bucket.
    """
    h = F.xxhash64(*order)
    rows = df.withColumn("_hash", h).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    n = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_bucket").orderBy("_hash", *order)
    return (
        rows.join(F.broadcast(n), "_bucket")
        .withColumn(name, F.col("_before") + F.row_number().over(w))
        .drop("_hash", "_bucket", "_before")
    )


def ordered_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with the rank of every row from 0 by `order`, which should tell all rows apart.

    A range sort deals the rows; the tasks' row counts, one row a task, say at which rank each begins. Written once.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialised(dealt.withColumn("_at", F.monotonically_increasing_id()))  # the task's number above 33 bits of row number
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")
