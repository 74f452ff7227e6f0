"""Segment vectors, analogue ranking and passage search.

Vectors are compared by matrix product: the large table is read once and packed into rows of some thousand vectors, the queries are
a second side of blocks of bounded size, and a task that sees both keeps the best of each query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.functions import scalars as S
from borelight.operators.joins import formations_in_window
from borelight.operators.materialise import materialised
from borelight.operators.profile import corpus_status
from borelight.operators.quantiles import group_median
from borelight.operators.skew import (
    HOT_ROWS,
    broadcast_if_small,
    broadcast_within,
    spread,
)
from borelight.operators.topk import top_k_per_query
from borelight.operators.windows import segment_rows
from borelight.params import ANALOGUE_WEIGHTS, BEHAVIOUR_SCALES, DEFAULTS

QUERY_BLOCK = 2048
QUERY_ROWS = 32 * QUERY_BLOCK  # queries whose blocks are broadcast
PACK_ROWS = 4096


class SearchUnavailable(RuntimeError):
    """The passage index is not there or not built."""


def packed(df: DataFrame, rows: int = PACK_ROWS) -> DataFrame:
    """One row `_items` (array of structs) for up to `rows` consecutive rows of each partition."""
    inner = df.schema

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                values = pa.StructArray.from_arrays(part.columns, names=part.schema.names)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), values)], names=["_items"])

    return df.mapInArrow(pack, T.StructType([T.StructField("_items", T.ArrayType(inner))]))


def against_queries(items: DataFrame, queries: DataFrame, n_queries: int, kernel: Callable, schema) -> tuple[DataFrame, bool]:
    """`kernel` over every pack of items and every block of queries, and whether a task sees its packs in order.

    Queries are dealt into blocks of about QUERY_BLOCK rows by tasks. Up to QUERY_ROWS of them the blocks are broadcast; more are joined by
    shuffle on the block number, so neither side passes through the driver as rows and the items are read once.
    `kernel` gets an iterator of (block, items, queries) as struct arrays and gives record batches.
    """
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    dealt = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(*queries.columns)).alias("_queries"))
    few = n_queries <= QUERY_ROWS
    both = items.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(dealt) if few else dealt, "_block")

    def run(batches):
        def each():
            for b in batches:
                block, rows, asked = b.column("_block"), b.column("_items"), b.column("_queries")
                for i in range(b.num_rows):
                    yield block[i].as_py(), rows[i].values, asked[i].values

        yield from kernel(each())

    return both.select("_block", "_items", "_queries").mapInArrow(run, schema), few


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _best_rows(query: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best values of each query, smaller id first among equals."""
    place = np.empty(len(ids), dtype=np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((place, -sims, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def nearest_vectors(
    items: DataFrame, queries: DataFrame, k: int, item_id: str = "chunk_id", vector: str = "embedding", n_queries: int | None = None,
) -> DataFrame:
    """Exact top-k items per query by dot product: (query_id, item id, similarity, rank).

    A task keeps k items a query over all it sees, so k rows per query and task are shuffled. Queries without a vector find nothing.
    """
    queries = queries.where(F.col(vector).isNotNull()).select("query_id", vector)
    n_queries = queries.count() if n_queries is None else n_queries
    kinds = (queries.schema["query_id"].dataType, items.schema[item_id].dataType)
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField(item_id, kinds[1]), T.StructField("similarity", T.DoubleType())])

    def best(pairs):
        kept: dict = {}
        for block, rows, asked in pairs:
            names, x = rows.field(0), _matrix(rows.field(1))
            if block not in kept:
                kept[block] = (asked.field(0), _matrix(asked.field(1)), None)
            ids, q, old = kept[block]
            sims = q @ x.T
            edge = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k] if sims.shape[1] > k else np.full((len(q), 1), -np.inf)
            if old is not None and len(old[0]) == len(q) * k:  # what is below a query's k-th so far cannot come in
                edge = np.maximum(edge, old[1].reshape(len(q), k)[:, -1:])
            at_q, at_x = np.nonzero((sims >= edge) | np.isnan(sims))
            found = at_q, sims[at_q, at_x], names.to_numpy(zero_copy_only=False)[at_x]
            if old is not None:
                found = tuple(np.concatenate(c) for c in zip(old, found, strict=True))
            rows_kept = _best_rows(*found, k)
            kept[block] = (ids, q, tuple(c[rows_kept] for c in found))
        for ids, _, (at_q, sims, names) in kept.values():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at_q)), pa.array(names), pa.array(sims)], names=["query_id", item_id, "similarity"])

    rows = packed(spread(items.where(F.col(vector).isNotNull()).select(item_id, vector)))
    found, _ = against_queries(rows, queries, n_queries, best, schema)
    return top_k_per_query(found, k, "query_id", "similarity", item_id)


def search_passages(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    wells: DataFrame,
    k: int | None = None,
    min_similarity: float | None = None,
    well_id=None,
) -> DataFrame:
    """Best passages per query vector: top k first, then the threshold, then titles and wells.

    `queries`: query_id, text, embedding. A blank text is an input error; an index without vectors is
    reported as unavailable.
    """
    k = DEFAULTS.search_results if k is None else k
    floor = DEFAULTS.search_min_similarity if min_similarity is None else min_similarity
    if queries.where(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).limit(1).count():
        raise ValueError("a blank text cannot be searched for")
    pool = chunks.where(F.col("embedding").isNotNull())
    if well_id is not None:
        docs = documents.where(F.col("well_id") == well_id)
        pool = pool.join(broadcast_if_small(docs.select("document_id")), "document_id", "left_semi")
    if not pool.limit(1).count():
        some = chunks.limit(1).count()
        raise SearchUnavailable(
            "The passages there are have no vector; embed them first." if some
            else "There is no passage to search."
        )
    n_queries = queries.count()
    hits = nearest_vectors(pool, queries, k, n_queries=n_queries).where(F.col("similarity") >= floor)
    hits = hits.withColumn("similarity", F.round("similarity", 4))
    text = chunks.select("chunk_id", "document_id", "page_number", F.col("text").alias("passage"))
    return (
        text.join(broadcast_within(hits, n_queries * k), "chunk_id")
        .join(broadcast_if_small(documents.select("document_id", "title", "well_id")), "document_id", "left")
        .join(broadcast_if_small(wells.select("well_id", "well_name")), "well_id", "left")
    )


def search_provenance(chunks: DataFrame, model: str, min_similarity: float = DEFAULTS.search_min_similarity) -> DataFrame:
    """One row telling what was searched."""
    s = corpus_status(chunks)
    rest = F.col("chunks_total") - F.col("chunks_embedded")
    note = F.when(
        rest > 0,
        F.concat(rest.cast("string"), F.lit(" stored passage(s) have no embedding and were not searched.")),
    )
    return s.select(
        F.col("chunks_embedded").alias("passages_searched"), "chunks_embedded", "chunks_total",
        F.lit(model).alias("model"), F.lit("cosine").alias("similarity_metric"),
        F.lit(min_similarity).alias("min_similarity"), note.alias("note"),
    )


# ---------------------------------------------------------------- segment vectors


def segment_features(
    df: DataFrame, curves: list[str], well: str = "well", depth: str = "depth",
    length: float = DEFAULTS.segment_length_m, stride: float = DEFAULTS.segment_stride_m,
    min_samples: int = DEFAULTS.segment_min_samples, depth_scale: float = DEFAULTS.depth_scale_m,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Unscaled features per depth segment: mean, deviation and median per curve, thickness, mid depth."""
    df = spread(df.select(well, depth, *curves), well, depth)
    ends = df.groupBy(well).agg(
        F.min(depth).alias("_d0"), F.max(depth).alias("_d1"), F.count(F.lit(1)).alias("_n")
    )
    size = ends.agg(F.count(F.lit(1)).alias("wells"), F.max("_n").alias("rows")).first()
    rows = segment_rows(df, well, depth, length, stride, broadcast_within(ends.drop("_n"), size["wells"]))
    aggs = [
        F.min(depth).alias("segment_top_m"),
        F.max(depth).alias("segment_base_m"),
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(c).alias(f"{c}_mean") for c in curves],
        *[F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)).alias(f"{c}_std") for c in curves],
    ]
    if (size["rows"] or 0) <= max_rows:
        # no well is too large, so no segment is: everything in one aggregation
        seg = rows.groupBy(well, "segment").agg(*aggs, *[F.median(c).alias(f"{c}_median") for c in curves])
    else:
        mids = group_median(rows, [well, "segment"], {c: f"{c}_median" for c in curves}, max_rows)
        seg = rows.groupBy(well, "segment").agg(*aggs).join(mids, [well, "segment"])
    top, base = F.col("segment_top_m"), F.col("segment_base_m")
    return (
        seg.where(F.col("sample_count") >= min_samples)
        .withColumn("segment_thickness_norm", (base - top) / depth_scale)
        .withColumn("segment_middepth_norm", (top + base) / 2.0 / depth_scale)
    )


def feature_names(curves: list[str]) -> list[str]:
    return [f"{c}_{s}" for c in curves for s in ("mean", "std", "median")] + [
        "segment_thickness_norm", "segment_middepth_norm",
    ]


def scaled_vectors(segments: DataFrame, names: list[str], clip: float = DEFAULTS.clip_sigma) -> DataFrame:
    """Features standardised over all segments as one array; unknown features sit at the mean."""
    st = segments.agg(
        *[F.avg(n).alias(f"{n}_c") for n in names], *[F.stddev_pop(n).alias(f"{n}_s") for n in names]
    ).first()

    def scaled(n):
        if st[f"{n}_c"] is None:
            return F.lit(None).cast("float")
        centre, spread = F.lit(st[f"{n}_c"]), F.lit(st[f"{n}_s"] or 1.0)
        z = (F.coalesce(F.col(n), centre) - centre) / spread
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).cast("float")

    return segments.withColumn("embedding", F.array(*[scaled(n) for n in names])).drop(*names)


def dominant_names(
    df: DataFrame, well: str = "well", depth: str = "depth", group: str = "group_name",
    formation: str = "formation_name", length: float = DEFAULTS.segment_length_m, stride: float = DEFAULTS.segment_stride_m,
) -> DataFrame:
    """Most frequent group and formation per segment (name order on ties)."""
    rows = segment_rows(df.select(well, depth, group, formation), well, depth, length, stride)
    pairs = F.array(
        F.struct(F.lit("g").alias("kind"), F.col(group).alias("name")),
        F.struct(F.lit("f").alias("kind"), F.col(formation).alias("name")),
    )
    n = (
        rows.select(well, "segment", F.explode(pairs).alias("_p"))
        .where(F.col("_p.name").isNotNull())
        .groupBy(well, "segment", "_p")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = lambda k: F.min(F.when(F.col("_p.kind") == k, F.struct(-F.col("_n"), F.col("_p.name").alias("name"))))
    return n.groupBy(well, "segment").agg(best("g").alias("_g"), best("f").alias("_f")).select(
        well, "segment", F.col("_g.name").alias("dominant_group"), F.col("_f.name").alias("dominant_formation")
    )


def segment_vectors(
    df: DataFrame, curves: list[str], well: str = "well", depth: str = "depth", group: str | None = None,
    formation: str | None = None, length: float = DEFAULTS.segment_length_m, stride: float = DEFAULTS.segment_stride_m,
    min_samples: int = DEFAULTS.segment_min_samples, depth_scale: float = DEFAULTS.depth_scale_m,
    clip: float = DEFAULTS.clip_sigma, max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Scaled segment vectors, with the dominant names when the name columns are given."""
    seg = segment_features(df, curves, well, depth, length, stride, min_samples, depth_scale, max_rows)
    # one row per segment, read by the corpus statistics and by the scaling
    out = scaled_vectors(materialised(seg), feature_names(curves), clip)
    if group and formation:
        out = out.join(dominant_names(df, well, depth, group, formation, length, stride), [well, "segment"], "left")
    return out


# ---------------------------------------------------------------- analogue ranking


def query_vectors(queries: DataFrame, segments: DataFrame, n_queries: int) -> DataFrame:
    """Vector of the query well's segment holding the depth (lowest top), else of the nearest segment."""
    q = broadcast_within(
        queries.select("query_id", F.col("well_id").alias("_well"), F.col("depth_m").alias("_depth")), n_queries
    )
    top, base = F.col("segment_top_m"), F.col("segment_base_m")
    inside = (top <= F.col("_depth")) & (F.coalesce(base, F.col("_depth")) >= F.col("_depth"))
    mid_gap = F.abs((top + base) / 2.0 - F.col("_depth"))
    order = F.struct(
        F.when(inside, 0).otherwise(1), F.when(inside, F.lit(0.0)).otherwise(mid_gap), top
    )
    return (
        segments.join(q, F.col("well_id") == F.col("_well"))
        .groupBy("query_id")
        .agg(F.min_by("embedding", order).alias("embedding"))
    )


def best_segments(queries: DataFrame, segments: DataFrame, n_queries: int, carried: list[str]) -> DataFrame:
    """Per (query, other well) the segment most similar to the query vector, or nearest in depth if the query has none; of equals the lowest top.

    `queries`: query_id, well_id, depth_m, embedding. `segments`: well_id, segment_top_m, segment_base_m, embedding and the columns
    `carried` along; a row without a top stands for a well without segments. A well's segments come to one task in order, so a pair is
    found there and is not shuffled; of a well that goes over several packs only the best segment of some query is held.
    """
    fields = ["well_id", "segment_top_m", "segment_base_m", *carried]
    kinds = {f.name: f for f in segments.schema.fields}
    schema = T.StructType([queries.schema["query_id"], *[kinds[c] for c in fields], T.StructField("geology", T.DoubleType()), T.StructField("metric", T.DoubleType())])
    rows = segments.select(*fields, "embedding").repartition("well_id").sortWithinPartitions("well_id", "segment_top_m")
    found, in_order = against_queries(packed(rows), queries.select("query_id", "well_id", "depth_m", "embedding"), n_queries, _segment_kernel(fields), schema)
    if in_order:
        return found.drop("metric")
    rest = [f.name for f in schema.fields if f.name not in ("query_id", "well_id", "metric")]
    order = F.struct(F.col("metric"), -F.col("segment_top_m"))
    return found.groupBy("query_id", "well_id").agg(F.max_by(F.struct(*rest), order).alias("_s")).select("query_id", "well_id", "_s.*")


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _segment_kernel(fields: list[str]):
    def asked_of(queries: pa.StructArray) -> tuple:
        ids, wells, depth, vectors = (queries.field(i) for i in range(4))
        has = np.asarray(vectors.is_valid())
        known = _matrix(vectors.filter(pa.array(has))) if has.any() else np.zeros((0, 1))
        matrix = np.zeros((len(has), known.shape[1]))
        matrix[has] = known
        return ids, wells.to_numpy(zero_copy_only=False), _numbers(depth), has, matrix, np.sqrt((matrix**2).sum(axis=1))

    def measured(rows: pa.StructArray, asked: tuple) -> tuple[np.ndarray, np.ndarray]:
        _, _, q_depth, has, q_mat, q_len = asked
        top, base = _numbers(rows.field(1)), _numbers(rows.field(2))
        vectors = rows.field(len(fields))
        full = np.asarray(vectors.is_valid())
        cosine = np.full((len(rows), len(has)), np.nan)
        if full.any() and has.any():
            s = _matrix(vectors.filter(pa.array(full)))
            if s.shape[1] != q_mat.shape[1]:
                raise ValueError(f"segment vectors have {s.shape[1]} values, queries {q_mat.shape[1]}")
            length = np.sqrt((s**2).sum(axis=1))[:, None] * q_len[None, :]
            raw = np.divide(s @ q_mat.T, length, out=np.full(length.shape, -1.0), where=length > 0)
            cosine[full] = np.clip((raw + 1.0) / 2.0, 0.0, 1.0)
            cosine[:, ~has] = np.nan
        metric = np.where(has[None, :], cosine, -np.abs(((top + base) / 2.0)[:, None] - q_depth[None, :]))
        return cosine, np.where(~np.isnan(top)[:, None] & ~np.isnan(metric), metric, -np.inf)

    def told(rows, cosine, metric, best, wells_at, asked):
        """One row for each query and well, but its own: `best` has the row of each well and query."""
        wells = rows.field(0).to_numpy(zero_copy_only=False)
        at_well, at_query = np.nonzero(wells[wells_at][:, None] != asked[1][None, :])
        pick = best[at_well, at_query]
        take = pa.array(pick)
        columns = [asked[0].take(pa.array(at_query)), *[rows.field(i).take(take) for i in range(len(fields))],
                   pa.array(cosine[pick, at_query], from_pandas=True), pa.array(metric[pick, at_query])]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", *fields, "geology", "metric"])

    def kernel(pairs):
        open_: dict = {}
        for block, rows, queries in pairs:
            if block in open_:
                rows = pa.concat_arrays([open_[block][0], rows])
                asked = open_[block][1]
            else:
                asked = asked_of(queries)
            cosine, metric = measured(rows, asked)
            wells = rows.field(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, wells[1:] != wells[:-1]])
            best = np.stack([a + metric[a:z].argmax(axis=0) for a, z in zip(starts, np.r_[starts[1:], len(wells)], strict=True)])
            if len(starts) > 1:
                yield told(rows, cosine, metric, best[:-1], starts[:-1], asked)
            open_[block] = rows.take(pa.array(np.unique(best[-1]))), asked  # in order, so the lowest top of equals stays first
        for rows, asked in open_.values():
            cosine, metric = measured(rows, asked)
            yield told(rows, cosine, metric, metric.argmax(axis=0)[None, :], np.zeros(1, dtype=np.int64), asked)

    return kernel


def rank_analogues(
    queries: DataFrame,
    wells: DataFrame,
    segments: DataFrame,
    intervals: DataFrame,
    profiles: DataFrame,
    k: int = DEFAULTS.analogue_k,
    weights: dict[str, float] = ANALOGUE_WEIGHTS,
    scales: dict[str, float] = BEHAVIOUR_SCALES,
    half_window: float = DEFAULTS.segment_length_m / 2,
    depth_tolerance: float = DEFAULTS.depth_tolerance_m,
    decay_km: float = DEFAULTS.distance_decay_km,
    bucket: float = DEFAULTS.segment_length_m,
) -> DataFrame:
    """Rank all other wells per query by the weighted mean of the dimensions that can be computed.

    `queries`: query_id, well_id, depth_m (NULL: the well's total depth). `wells`: well_id, well_name,
    latitude, longitude, total_depth_m. `segments`: well_id, segment_top_m, segment_base_m, embedding
    and optionally the dominant names. `profiles`: well_id, profile map.
    """
    n_queries, n_wells = queries.count(), wells.count()
    own = wells.select(
        "well_id", F.col("latitude").alias("_qlat"), F.col("longitude").alias("_qlon"),
        F.col("total_depth_m").alias("_qtd"),
    )
    q = own.join(broadcast_within(queries.select("query_id", "well_id", "depth_m"), n_queries), "well_id").select(
        "query_id", "well_id", F.coalesce("depth_m", "_qtd", F.lit(0.0)).alias("depth_m"), "_qlat", "_qlon"
    )
    # one row per query: written once, read by the vector scan and by every query-side join
    located = materialised(q.join(query_vectors(q, segments, n_queries), "query_id", "left"))
    q = located.drop("embedding")
    window = q.select(
        "query_id", "well_id",
        F.greatest(F.lit(0.0), F.col("depth_m") - half_window).alias("lo"),
        (F.col("depth_m") + half_window).alias("hi"),
    )
    q_names = formations_in_window(window, intervals, ["query_id"], width=bucket).select(
        "query_id", F.col("formations").alias("_qf"), F.col("groups").alias("_qg")
    )
    q_side = (
        q.join(q_names, "query_id", "left")
        .join(profiles.select("well_id", F.col("profile").alias("_qp")), "well_id", "left")
        .join(window.select("query_id", "lo", "hi"), "query_id")
        .drop("well_id")
    )

    def names_of(spans: DataFrame) -> DataFrame:
        found = formations_in_window(
            spans.distinct(), intervals.withColumnRenamed("well_id", "_sw"), ["_sw", "_slo", "_shi"], "_sw", "_slo", "_shi", bucket
        )
        return found.withColumnsRenamed({"formations": "_cf", "groups": "_cg"})

    def named(rows: DataFrame, lo: str, hi: str) -> DataFrame:
        spans = names_of(rows.select(F.col("well_id").alias("_sw"), F.col(lo).alias("_slo"), F.col(hi).alias("_shi")))
        same = (F.col("well_id") == F.col("_sw")) & (F.col(lo) == F.col("_slo")) & (F.col(hi) == F.col("_shi"))
        return rows.join(spans, same, "left").drop("_sw", "_slo", "_shi")

    # what is known of a segment and its well is attached before the pairs exist; pairs then go straight to the top k
    extra = [c for c in ("dominant_group", "dominant_formation") if c in segments.columns]
    seg = segments.select("well_id", "segment_top_m", "segment_base_m", *extra, "embedding")
    whole = seg.where("segment_top_m is not null and segment_base_m is null").isEmpty()
    if whole:
        seg = named(seg, "segment_top_m", "segment_base_m")
    carried = [*extra, *(["_cf", "_cg"] if whole else [])]
    parts = best_segments(located, seg, n_queries, carried).join(broadcast_within(q_side, n_queries), "query_id")
    if not whole:
        parts = parts.withColumn("_lo", F.coalesce("segment_top_m", "lo")).withColumn("_hi", F.coalesce("segment_base_m", "hi"))
        parts = named(materialised(parts), "_lo", "_hi").drop("_lo", "_hi")
    bare = wells.select("well_id").join(segments.select("well_id").distinct(), "well_id", "left_anti")
    bare = bare.select("well_id", *[F.lit(None).cast(seg.schema[c].dataType).alias(c) for c in seg.columns if c not in ("well_id", "_cf", "_cg")])
    rest = best_segments(located, bare, n_queries, extra).join(broadcast_within(q_side, n_queries), "query_id")
    rows = parts.unionByName(named(rest, "lo", "hi"))
    others = wells.select("well_id", "well_name", "latitude", "longitude", "total_depth_m")
    rows = rows.join(broadcast_within(others, n_wells), "well_id").join(
        broadcast_within(profiles.select("well_id", F.col("profile").alias("_cp")), n_wells), "well_id", "left"
    )

    def some(a, b):
        return (F.coalesce(F.size(a), F.lit(0)) > 0) | (F.coalesce(F.size(b), F.lit(0)) > 0)

    formation = F.when(
        some("_qf", "_qg") & some("_cf", "_cg"), F.greatest(S.jaccard("_qf", "_cf"), S.jaccard("_qg", "_cg"))
    )
    reference = F.coalesce((F.col("segment_top_m") + F.col("segment_base_m")) / 2.0, F.col("total_depth_m"))
    depth = F.when(
        F.col("total_depth_m").isNotNull(), S.exp_decay(F.abs(reference - F.col("depth_m")), depth_tolerance)
    )
    distance = F.when(
        F.col("_qlat").isNotNull() & F.col("_qlon").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        S.haversine_km("_qlat", "_qlon", "latitude", "longitude"),
    )
    alike = S.behaviour_similarity("_qp", "_cp", scales)
    rows = rows.select(
        "query_id", "well_id", "well_name", "depth_m", "segment_top_m", "segment_base_m",
        *[c for c in ("dominant_group", "dominant_formation") if c in rows.columns],
        "geology",
        formation.alias("formation"),
        depth.alias("depth"),
        F.when(alike["shared"] > 0, alike["value"]).alias("drilling_behaviour"),
        S.exp_decay(distance, decay_km).alias("geography"),
        distance.alias("distance_km"),
        F.when(some("_qf", "_qg") & some("_cf", "_cg"), S.shared_names("_qf", "_cf", "_qg", "_cg")).alias("shared_stratigraphy"),
    )
    dims = list(weights)
    parts = F.array(*[F.struct(F.col(d).alias("value"), F.lit(float(weights[d])).alias("weight")) for d in dims])

    def names(test):
        return F.filter(F.array(*[F.when(test(F.col(d)), F.lit(d)) for d in dims]), lambda x: x.isNotNull())

    scored = rows.select(
        "*",
        S.weighted_mean(parts).alias("score"),
        names(lambda c: c.isNotNull()).alias("dimensions_used"),
        names(lambda c: c.isNull()).alias("dimensions_unavailable"),
    ).where(F.col("score").isNotNull())
    return top_k_per_query(scored, k, "query_id", "score", "well_id")
