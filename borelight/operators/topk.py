"""Paging, top-k and ordered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelight.params import DEFAULTS


def paginate(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page in order, and the total before paging (one row). Equal rows of `order` go by the other columns."""
    if not 1 <= limit <= DEFAULTS.page_limit:
        raise ValueError(f"limit must be between 1 and {DEFAULTS.page_limit}")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    order = [*order, *[c for c, t in df.dtypes if c not in order and not t.startswith("map")]]
    return df.orderBy(*order).offset(max(0, offset)).limit(limit), total


def top_k_per_query(df: DataFrame, k: int, query: str, score: str, tie: str) -> DataFrame:
    """Best `k` rows per query. Spark limits every input partition to k rows per query before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_deviations(pairs: list[tuple[str, Column]], n: int = DEFAULTS.attribution_top) -> Column:
    """Largest finite deviations of a row as an array of (feature, contribution)."""
    entries = F.array(
        *[
            F.struct((-d).alias("key"), F.lit(i).alias("pos"), F.lit(name).alias("feature"), d.alias("dev"))
            for i, (name, d) in enumerate(pairs)
        ]
    )
    known = F.filter(
        entries,
        lambda e: e["dev"].isNotNull() & ~F.isnan(e["dev"]) & (F.abs(e["dev"]) < F.lit(float("inf"))),
    )
    return F.transform(
        F.slice(F.array_sort(known), 1, n),
        lambda e: F.struct(
            e["feature"].alias("feature"),
            F.round(e["dev"], 3).alias("contribution"),
            F.lit("sigma from the active-row median").alias("unit"),
        ),
    )


def sort_evidence(df: DataFrame) -> DataFrame:
    return df.orderBy(
        F.desc("similarity_score"), F.abs(F.coalesce("offset_m", F.lit(0.0))), "well_id", "event_id"
    )


def evidence_radar(evidence: DataFrame, markers: int = 7, query: str = "query_id", offset: str = "offset_m") -> DataFrame:
    """Per query: the nearest record ahead, the placed records and how many lie beyond the markers."""
    placed = F.col(offset).isNotNull()
    ahead = F.when(F.col(offset) > 0, F.struct(F.col(offset), F.col("event_id")))
    return evidence.groupBy(query).agg(
        F.min(ahead).alias("_a"), F.count_if(placed).alias("placed"), F.count_if(~placed).alias("unplaced")
    ).select(
        query,
        F.col(f"_a.{offset}").alias("nearest_ahead_m"),
        F.col("_a.event_id").alias("nearest_ahead_event"),
        "placed",
        "unplaced",
        F.greatest(F.col("placed") - markers, F.lit(0)).alias("not_drawn"),
    )


def nearest_markers(evidence: DataFrame, n: int = 7, query: str = "query_id", offset: str = "offset_m") -> DataFrame:
    """The `n` placed records nearest to the bit per query."""
    w = Window.partitionBy(query).orderBy(F.abs(offset), "event_id")
    rows = evidence.where(F.col(offset).isNotNull())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in order with unknown values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])
