"""Interleave sources by target weights: proportionate-fair (Pfair) scheduling of blocks of rows."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENT_SOURCES = 4096  # more are joined by shuffle
BUCKET_ROWS = 2000  # rows of a hash bucket in which a source is ranked, about


def whole_shares(weights: dict, period: int) -> dict:
    """Weights as whole numbers of slots that sum to `period`, each at least 1, by largest remainder."""
    total = sum(Fraction(w) for w in weights.values())
    if not weights or any(Fraction(w) <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    exact = {s: Fraction(w) / total * (period - len(weights)) for s, w in weights.items()}
    share = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: period - sum(share.values())]:
        share[s] += 1
    return share


def whole_weights(weights: dict) -> dict:
    """Weights as whole numbers in exactly the given proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def slots(shares: dict, blocks: dict) -> Iterator[tuple]:
    """Rows (source, j, release, deadline, slot) by slot: block j of a source with share n of P is released at floor(j P / n) and
    due at ceil((j + 1) P / n); every slot takes the released block with the earliest deadline. Each source has `blocks` blocks;
    a slot for which no block is left stays empty."""
    period = sum(shares.values())
    waiting = [(0, str(s), n, s, 0) for n, s in enumerate(shares) if blocks.get(s, 0)]
    heapq.heapify(waiting)
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, name, n, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[s]), name, n, j, release, s))
        due, name, n, j, release, s = heapq.heappop(ready)
        yield s, j, release, due, slot
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // shares[s], name, n, s, j + 1))
        slot += 1


def schedule(shares: dict) -> list[tuple]:
    """One period of `slots`, in which every source has as many blocks as its share; it repeats."""
    return list(slots(shares, shares))


def scheduled(spark: SparkSession, shares: dict, blocks: dict) -> DataFrame:
    """`slots` as a table (_i, mix_block, mix_release, mix_deadline, mix_slot); _i is the number of the source in `shares`."""
    number = {s: i for i, s in enumerate(shares)}
    columns = [array("q") for _ in range(5)]
    for s, *row in slots(shares, blocks):
        for c, x in zip(columns, (number[s], *row), strict=True):
            c.append(x)
    names = ["_i", "mix_block", "mix_release", "mix_deadline", "mix_slot"]
    return spark.createDataFrame(pa.table({n: np.frombuffer(c, dtype=np.int64) for n, c in zip(names, columns, strict=True)}))


def source_rows(docs: DataFrame, source: str, max_sources: int | None = None) -> dict:
    """Rows of each source. More than `max_sources` sources, if given: an error."""
    counts = docs.groupBy(source).count()
    rows = (counts if max_sources is None else counts.limit(max_sources + 1)).collect()
    if max_sources is not None and len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return {r[0]: r[1] for r in rows}


def natural_weights(sizes: dict, power: float) -> dict:
    """Rows of each source to the `power` (1: as they are; 0: all alike)."""
    return {s: max(1, round(n**power * 1000)) for s, n in sizes.items()}


def mix(
    docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", block_rows: int = 16, period: int = 4096,
    power: float = 0.7, max_sources: int | None = None, seed: int = 7,
) -> DataFrame:
    """`docs` with mix_block, mix_release, mix_deadline, mix_slot and mix_position (unique; the order to read in).

    Rows of a source are dealt into blocks of `block_rows` in the order of a hash of `key`. Blocks are scheduled by earliest
    deadline first, so that after any number of slots every source has less than one block more or less than its weight asks,
    for as long as it has blocks left; the others go on in their own windows, and slots that none of them can take stay empty.
    All rows stay. `weights` maps every source to its target (default: rows to the power 0.7); releases and deadlines are those
    of the exact fractions for every block, so nothing adds up over time. `period` is no longer needed and changes nothing. The
    schedule is made on the driver, 40 bytes and one heap step a block, from one count a source; any number of sources will do.

    A null source is a source of its own; a source without weight is an error. Null and equal keys are ordered by the other columns.
    A source is ranked in hash buckets of about 2000 rows, so one that holds a third of all rows is spread over as many tasks as it
    needs at any size; only counts of buckets are summed along a source. Columns of these names are replaced.
    """
    docs = docs.drop("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")
    sizes = source_rows(docs, source, max_sources)
    names = natural_weights(sizes, power) if weights is None else weights
    spark = docs.sparkSession
    if not names or not sizes:
        extra = [F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")]
        return docs.select("*", *extra)
    shares = whole_weights(names)
    kind = docs.schema[source].dataType.simpleString()
    number = {s: i for i, s in enumerate(shares)}
    if any(s not in shares for s in sizes):
        raise ValueError("a source has no weight")
    one = scheduled(spark, shares, {s: -(-n // block_rows) for s, n in sizes.items()})
    about = [(s, number[s], -(-n // BUCKET_ROWS)) for s, n in sizes.items()]
    if kind == "string":  # Spark takes Arrow data as they are and starts no Python workers for them
        columns = zip(("_s", "_i", "_buckets"), zip(*about, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)
        about = spark.createDataFrame(pa.table({c: pa.array(x, t) for c, x, t in columns}))  # a row a source
    else:
        about = spark.createDataFrame(about, f"_s {kind}, _i long, _buckets long")
    if len(sizes) <= SENT_SOURCES:
        about = F.broadcast(about)
    # the caller's row goes along as one struct, so no name of its columns can clash
    ties = F.struct(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ties.alias("_ties"), F.col(source).alias("_source"), F.xxhash64(F.lit(seed), key).alias("_h"))
    rows = rows.join(about, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_source")
    rows = rows.withColumn("_b", F.pmod(F.shiftrightunsigned("_h", 8), F.col("_buckets"))).drop("_buckets")
    counts = rows.groupBy("_i", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_i", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_i", "_b").orderBy("_h", "_ties"))).drop("_ties").join(counts, ["_i", "_b"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_k") - 1).withColumn("mix_block", F.floor(F.col("_rank") / block_rows))
    rows = rows.join(one, ["_i", "mix_block"])
    position = (F.col("mix_slot") * block_rows + F.col("_rank") % block_rows).alias("mix_position")
    return rows.select("_row.*", "mix_block", "mix_release", "mix_deadline", "mix_slot", position)
