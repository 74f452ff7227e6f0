"""Nearest, as-of, interval, band and radius joins without pairing whole groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.functions import scalars as S
from borelight.operators.materialise import materialised
from borelight.operators.skew import HOT_ROWS, broadcast_if_small, broadcast_within, null_safe
from borelight.params import DEFAULTS, EARTH_RADIUS_KM

POINT_ROWS = 20_000  # points of a range join's task


def _pos(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.col(name).cast("double")


def nearest_join(
    queries: DataFrame,
    refs: DataFrame,
    on: list[str],
    q_at: str,
    r_at: str,
    payload: list[str],
    width: float,
    tolerance: float | None = None,
    prefer: Column | None = None,
    merge_repeats: bool = True,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach to every query row the reference row of the same key nearest in `r_at`.

    `width` is the size of the pieces a key is cut into (microseconds for timestamps). Within a piece
    two sorted passes find the neighbour on each side, so no pairs are formed. With a `tolerance`
    reference rows reach over piece borders by copies; without one the last and first reference of
    every piece are carried along. `prefer` decides ties (larger wins; default: the smaller position).
    The queries of a piece that more than `max_rows` of them ask for are dealt to copies of its references, so a place where most
    queries stand spreads over tasks. The result keeps all query columns and adds `payload` plus `gap` (NULL without a match).
    """
    q_cols = queries.columns
    if tolerance is not None:
        width = max(width, 2.0 * tolerance)
    r_pos, q_pos = _pos(refs, r_at), _pos(queries, q_at)
    pref = (-r_pos if prefer is None else prefer).alias("prefer")
    r = refs.where(F.col(r_at).isNotNull()).select(
        *on, r_pos.alias("_p"), F.struct(r_pos.alias("at"), pref, F.struct(*payload).alias("row")).alias("_r")
    )
    if merge_repeats:
        r = r.groupBy(*on, "_p").agg(F.max_by("_r", F.col("_r.prefer")).alias("_r"))
    if tolerance is None:
        r = r.withColumn("_b", F.floor(F.col("_p") / width).cast("long"))
    else:
        lo = F.floor((F.col("_p") - tolerance) / width).cast("long")
        hi = F.floor((F.col("_p") + tolerance) / width).cast("long")
        r = r.withColumn("_b", F.explode(F.sequence(lo, hi)))
    flat = [f.name for f in queries.schema.fields if not isinstance(f.dataType, T.MapType)]
    nowhere = F.lit(-(2**62)) + F.pmod(F.xxhash64(*flat), F.lit(4096))
    q = queries.select(
        *on,
        q_pos.alias("_p"),
        F.struct(*q_cols).alias("_q"),
        F.coalesce(F.floor(q_pos / width).cast("long"), nowhere).alias("_b"),
    )
    piece = [*on, "_b"]
    hot = q.groupBy(*piece).agg(F.ceil(F.count(F.lit(1)) / max_rows).cast("int").alias("_shares")).where("_shares > 1")
    n_hot = hot.count()
    if n_hot:  # at most one for every max_rows queries
        hot = broadcast_within(hot, n_hot)
        q = q.join(hot, piece, "left").withColumn("_share", F.pmod(F.xxhash64(*[F.col(f"_q.`{c}`") for c in flat]), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
        r = r.join(hot, piece, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    else:
        q, r = q.withColumn("_share", F.lit(0)), r.withColumn("_share", F.lit(0))
    both = q.withColumn("_is_q", F.lit(1)).unionByName(
        r.withColumn("_is_q", F.lit(0)), allowMissingColumns=True
    )
    ref_prefer = F.col("_r.prefer")
    fwd = Window.partitionBy(*piece, "_share").orderBy("_p", "_is_q", ref_prefer)
    bwd = Window.partitionBy(*piece, "_share").orderBy(F.desc("_p"), F.desc("_is_q"), ref_prefer)
    upto = (Window.unboundedPreceding, 0)
    found = both.select(
        *piece,
        "_p",
        "_q",
        F.last("_r", True).over(fwd.rowsBetween(*upto)).alias("_before"),
        F.last("_r", True).over(bwd.rowsBetween(*upto)).alias("_after"),
    ).where(F.col("_q").isNotNull())
    if tolerance is None:
        at_ref = F.col("_is_q") == 0
        edge = both.groupBy(*piece).agg(
            F.max_by("_r", F.when(at_ref, F.struct(F.col("_p"), ref_prefer))).alias("_hi"),
            F.min_by("_r", F.when(at_ref, F.struct(F.col("_p"), -ref_prefer))).alias("_lo"),
        )
        prev = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        nxt = Window.partitionBy(*on).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select(
            *[F.col(c).alias(c + "_e") for c in piece],
            F.last("_hi", True).over(prev).alias("_carry_lo"),
            F.last("_lo", True).over(nxt).alias("_carry_hi"),
        )
        cond = F.lit(True)
        for c in piece:
            cond = cond & (F.col(c) == F.col(c + "_e"))
        found = found.join(edge, cond, "left").select(
            "_p",
            "_q",
            F.coalesce("_before", "_carry_lo").alias("_before"),
            F.coalesce("_after", "_carry_hi").alias("_after"),
        )
    gap_b, gap_a = F.col("_p") - F.col("_before.at"), F.col("_after.at") - F.col("_p")
    take_before = F.col("_after").isNull() | (gap_b < gap_a) | (
        (gap_b == gap_a) & (F.col("_before.prefer") >= F.col("_after.prefer"))
    )
    pick = F.when(F.col("_before").isNotNull() & take_before, F.col("_before")).otherwise(F.col("_after"))
    pick = F.when(F.col("_p").isNotNull(), pick)
    out = found.select("_q", "_p", pick.alias("_m")).withColumn("gap", F.abs(F.col("_p") - F.col("_m.at")))
    if tolerance is not None:
        near = F.col("gap") <= tolerance
        out = out.withColumn("_m", F.when(near, F.col("_m"))).withColumn("gap", F.when(near, F.col("gap")))
    return out.select("_q.*", *[F.col(f"_m.row.{c}").alias(c) for c in payload], "gap")


def recover_depths(
    messages: DataFrame,
    telemetry: DataFrame,
    well: str = "well_name",
    m_time: str = "recorded_at",
    t_time: str = "timestamp",
    bit: str = "bit_depth_m",
    hole: str = "hole_depth_m",
    reported: str | None = None,
    tolerance_s: float = 600.0,
    piece_s: float = 14400.0,
) -> DataFrame:
    """Give each message the depth of the telemetry row nearest in time, within the tolerance.

    Equal gaps go to the earlier row. A depth the message reports itself is kept.
    """
    refs = telemetry.where(F.coalesce(bit, hole).isNotNull()).select(
        well, F.col(t_time).alias("_t"), F.coalesce(bit, hole).alias("_joined_depth")
    )
    out = nearest_join(
        messages, refs, [well], m_time, "_t", ["_joined_depth"], piece_s * 1e6, tolerance_s * 1e6,
        merge_repeats=False,
    )
    own = F.col(reported) if reported else F.lit(None).cast("double")
    source = (
        F.when(own.isNotNull(), "reported")
        .when(F.col("_joined_depth").isNotNull(), "telemetry_time_join")
        .otherwise("unresolved")
    )
    return (
        out.withColumn("depth_m", F.coalesce(own, F.col("_joined_depth")))
        .withColumn("depth_source", source)
        .drop("_joined_depth", "gap")
    )


def telemetry_near_depth(
    queries: DataFrame,
    telemetry: DataFrame,
    payload: list[str],
    well: str = "well_id",
    q_depth: str = "depth_m",
    t_depth: str = "bit_depth_m",
    at: str = "recorded_at",
    width: float = 100.0,
) -> DataFrame:
    """Telemetry row nearest in bit depth, latest on ties; the latest row when the depth is unknown.

    Adds `payload` and `gap`; `gap` stays NULL for rows found by time.
    """
    prefer = F.unix_micros(F.col(at)).cast("double")
    near = nearest_join(queries, telemetry, [well], q_depth, t_depth, payload, width, prefer=prefer)
    last = telemetry.groupBy(F.col(well).alias("_lw")).agg(F.max_by(F.struct(*payload), at).alias("_last"))
    out = near.join(last, F.col(well) == F.col("_lw"), "left")
    none = F.col(q_depth).isNull()
    return out.select(
        *queries.columns,
        *[F.when(none, F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        "gap",
    )


def near_within(
    queries: DataFrame,
    refs: DataFrame,
    payload: list[str],
    tolerance: float,
    well: str = "well_id",
    q_depth: str = "depth_m",
    r_depth: str = "depth_m",
    prefer: Column | None = None,
    width: float = 100.0,
) -> DataFrame:
    """Nearest reference row by depth, NULL beyond `tolerance` (anomaly scores, lithology)."""
    return nearest_join(queries, refs, [well], q_depth, r_depth, payload, width, tolerance, prefer)


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    at: str,
    lo: str,
    hi: str,
    width: float,
    how: str = "inner",
    max_rows: int = POINT_ROWS,
) -> DataFrame:
    """Join points to the closed intervals that contain them; equi join on key and depth bucket.

    Column names of the two sides must differ apart from `on`. More than `max_rows` points are counted per bucket, dealt by it into
    tasks of about so many and joined in its order, so that pairs of neighbouring points lie together (they name nearly the same intervals and are
    stored in little room); points of a larger bucket are dealt to copies of its intervals.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    i = intervals.where(F.col(hi) >= F.col(lo)).withColumn(
        "_b", F.explode(_buckets(F.col(lo), F.col(hi), width))
    )
    keys = [*on, "_b"]
    each = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > max_rows).alias("hot")).first()
    tasks = -(-size["rows"] // max_rows)
    if size["hot"]:
        parts = F.ceil(F.col("_n") / max_rows).cast("int").alias("_parts")
        hot = broadcast_within(each.where(F.col("_n") > max_rows).select(*[F.col(k).alias(k + "_h") for k in keys], parts), size["hot"])
        part = F.pmod(F.xxhash64(*points.columns), F.coalesce("_parts", F.lit(1)))
        p = p.join(hot, null_safe(p, hot, keys, "_h"), "left").withColumn("_s", part).select(*points.columns, "_b", "_s")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))
        i = i.join(hot, null_safe(i, hot, keys, "_h"), "left").withColumn("_s", copies).select(*intervals.columns, "_b", "_s")
        keys = [*keys, "_s"]
    if tasks > 1:
        tasks = max(tasks, points.sparkSession.sparkContext.defaultParallelism)
        p = p.repartition(tasks, *keys)
        i = i.repartition(tasks, *keys)
    i = i.select(*[F.col(c).alias(c + "_i") for c in keys], *[c for c in i.columns if c not in keys])
    i = i.hint("merge") if tasks > 1 else i
    cond = (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    for c in keys:
        cond = cond & (F.col(c) == F.col(c + "_i"))
    return p.join(i, cond, how).drop(*[c for c in keys if c not in on], *[c + "_i" for c in keys])


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    l_lo: str,
    l_hi: str,
    r_lo: str,
    r_hi: str,
    width: float,
) -> DataFrame:
    """Pairs of overlapping closed intervals, each pair once (in the first bucket both share)."""
    a = left.withColumn("_b", F.explode(_buckets(F.col(l_lo), F.col(l_hi), width)))
    b = right.where(F.col(r_hi) >= F.col(r_lo)).withColumn(
        "_b", F.explode(_buckets(F.col(r_lo), F.col(r_hi), width))
    )
    b = b.select(*[F.col(c).alias(c + "_i") for c in [*on, "_b"]], *[c for c in b.columns if c not in [*on, "_b"]])
    first = F.floor(F.greatest(F.col(l_lo), F.col(r_lo)) / width).cast("long")
    cond = (F.col(r_hi) >= F.col(l_lo)) & (F.col(r_lo) <= F.col(l_hi)) & (F.col("_b") == first)
    for c in [*on, "_b"]:
        cond = cond & (F.col(c) == F.col(c + "_i"))
    return a.join(b, cond).drop("_b", *[c + "_i" for c in [*on, "_b"]])


def formation_at(
    queries: DataFrame,
    intervals: DataFrame,
    well: str = "well_id",
    depth: str = "depth_m",
    query_id: str = "query_id",
    width: float = 100.0,
) -> DataFrame:
    """Formation and group at each query depth; touching intervals give the one with the smaller top."""
    iv = intervals.select(
        well, "group_name", "formation_name", F.col("depth_top_m").alias("_top"), F.col("depth_base_m").alias("_base")
    )
    hit = range_join(queries.select(query_id, well, depth), iv, [well], depth, "_top", "_base", width)
    best = hit.groupBy(query_id).agg(
        F.min(F.struct("_top", "_base", "formation_name", "group_name")).alias("_iv")
    )
    return queries.join(best, query_id, "left").select(
        *queries.columns,
        F.col("_iv.group_name").alias("group_name"),
        F.col("_iv.formation_name").alias("formation_name"),
        F.col("_iv._top").alias("depth_top_m"),
        F.col("_iv._base").alias("depth_base_m"),
    )


def formations_in_window(
    windows: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    well: str = "well_id",
    lo: str = "lo",
    hi: str = "hi",
    width: float = 100.0,
) -> DataFrame:
    """Sets of formation and group names overlapping each window; unknown and blank names left out."""
    iv = intervals.select(
        well, "group_name", "formation_name", F.col("depth_top_m").alias("_top"), F.col("depth_base_m").alias("_base")
    )
    hit = overlap_join(windows, iv, [well], lo, hi, "_top", "_base", width)

    def names(c):
        return F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))

    return hit.groupBy(*keys).agg(
        names("formation_name").alias("formations"), names("group_name").alias("groups")
    )


def historical_evidence(
    matches: DataFrame,
    events: DataFrame,
    lookahead_m: float = DEFAULTS.lookahead_m,
    min_similarity: float = DEFAULTS.min_similarity,
) -> DataFrame:
    """Categorised events of matched wells within ±lookahead of the query depth, one row per event.

    `matches`: query_id, depth_m, well_id (the matched well), well_name, score.
    """
    m = matches.where((F.col("score") >= min_similarity) & F.col("depth_m").isNotNull()).select(
        "query_id",
        "well_id",
        "well_name",
        F.col("depth_m").alias("query_depth_m"),
        F.col("score").alias("similarity"),
        (F.col("depth_m") - lookahead_m).alias("_lo"),
        (F.col("depth_m") + lookahead_m).alias("_hi"),
    )
    e = events.where(F.col("category").isNotNull() & F.col("depth_start_m").isNotNull())
    keep = ["well_id", "event_id", "category", "depth_start_m"]
    keep += [c for c in ("event_type", "description", "provenance", "formation_name") if c in e.columns]
    hit = range_join(e.select(*keep), m, ["well_id"], "depth_start_m", "_lo", "_hi", 2.0 * lookahead_m)
    return (
        hit.withColumn("similarity_score", F.round("similarity", 4))
        .withColumn("offset_m", F.round(F.col("depth_start_m") - F.col("query_depth_m"), 1))
        .drop("_lo", "_hi", "similarity")
    )


def event_mitigations(events: DataFrame, mitigations: DataFrame, key: str = "event_id") -> DataFrame:
    """Every event with its mitigations, one row each; events without any keep one row of NULLs."""
    return events.join(mitigations, key, "left")


def _band_width(band: Column, d: float | Column) -> Column:
    d = F.lit(d) if isinstance(d, float) else d
    far = F.least(F.greatest(F.abs(band * d), F.abs((band + 1) * d)), F.lit(90.0))
    raw = d / F.greatest(F.cos(F.radians(far)), F.lit(1e-6))
    return F.lit(360.0) / F.greatest(F.lit(1.0), F.floor(F.lit(360.0) / raw))


def wells_within(
    queries: DataFrame,
    wells: DataFrame,
    radius_km: float = DEFAULTS.radius_km,
    limit: int | None = None,
    query_id: str = "query_id",
    well: str = "well_id",
    exclude: str | None = "query_well_id",
) -> DataFrame:
    """Wells within a radius of each query position, nearest first.

    Positions go into latitude bands cut into longitude cells at least one radius wide; a query looks
    into the cells its circle touches, so the join is an equi join with a distance filter. With a `limit` a query looks no further
    than it takes to hold so many wells, on a grid that fits that reach, so pairs grow with the queries also where wells lie close.
    """
    d = math.degrees(radius_km / EARTH_RADIUS_KM) * 1.000001
    w = wells.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    q = queries.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        query_id, *([exclude] if exclude else []), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
    )
    if limit is None:
        w, q = w.withColumn("_level", F.lit(0)), q.withColumn("_level", F.lit(0)).withColumn("_deg", F.lit(d))
    else:
        w = materialised(_first_per_position(w, well, limit))
        q = materialised(_reach(q, w, d, limit, well))
        w = w.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    size = F.lit(d) / F.pow(F.lit(2.0), F.col("_level"))
    w = _cells(w, "latitude", "longitude", size)
    q = q.withColumn("_size", size).withColumn(
        "_qband", F.explode(F.sequence(F.floor((F.col("_lat") - F.col("_deg")) / F.col("_size")).cast("long"), F.floor((F.col("_lat") + F.col("_deg")) / F.col("_size")).cast("long")))
    )
    ratio = F.sin(F.radians("_deg")) / F.greatest(F.cos(F.radians("_lat")), F.lit(1e-9))
    reach = F.when(
        (F.abs(F.col("_lat")) + F.col("_deg") < 90.0) & (ratio < 1.0), F.degrees(F.asin(F.least(ratio, F.lit(1.0))))
    ).otherwise(F.lit(180.0))
    q = q.withColumn("_w", _band_width(F.col("_qband"), F.col("_size"))).withColumn("_reach", reach)
    x = F.col("_lon") + 180.0
    cells = F.sequence(
        F.floor((x - F.col("_reach")) / F.col("_w")).cast("long"),
        F.floor((x + F.col("_reach")) / F.col("_w")).cast("long"),
    )
    n = F.round(F.lit(360.0) / F.col("_w")).cast("long")
    q = q.withColumn("_n", n).withColumn("_cells", cells)
    q = q.withColumn(
        "_qcell", F.explode(F.array_distinct(F.transform("_cells", lambda c: F.pmod(c, F.col("_n")))))
    ).drop("_cells", "_n", "_w", "_reach", "_size", "_deg").withColumnRenamed("_level", "_qlevel")
    q = broadcast_if_small(q)
    cond = (F.col("_level") == F.col("_qlevel")) & (F.col("_band") == F.col("_qband")) & (F.col("_cell") == F.col("_qcell"))
    if exclude:
        cond = cond & ~F.col(well).eqNullSafe(F.col(exclude))
    dist = S.great_circle_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    out = (
        w.join(q, cond)
        .withColumn("distance_km", dist)
        .where(F.col("distance_km") <= radius_km)
        .drop("_level", "_qlevel", "_band", "_cell", "_qband", "_qcell", "_lat", "_lon")
    )
    if limit is None:
        return out
    nearest = Window.partitionBy(query_id).orderBy("distance_km", well)
    return out.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= limit)


LEVELS = 14  # times the cells of a search for the nearest wells are halved


def _cells(df: DataFrame, lat: str, lon: str, size: Column) -> DataFrame:
    """Latitude band and longitude cell of a position for cells of `size` degrees."""
    band = F.floor(F.col(lat) / size)
    return df.withColumn("_band", band.cast("long")).withColumn(
        "_cell", F.floor(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) / _band_width(band, size)).cast("long")
    )


def _first_per_position(wells: DataFrame, well: str, limit: int) -> DataFrame:
    """The wells that can be among the `limit` nearest of any query, as far as wells at the very same position tell: these are equally
    far, so the first ids go ahead. One more id is kept, for the query's own well is left out."""
    at = ["latitude", "longitude"]
    ids = Window.partitionBy(*at).orderBy(well)
    same = Window.partitionBy(*at, well).orderBy(well)
    first = wells.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= limit)
    return first.withColumn("_id", F.dense_rank().over(ids)).where(F.col("_id") <= limit + 1).drop("_copy", "_id")


def _reach(queries: DataFrame, wells: DataFrame, d: float, limit: int, well: str) -> DataFrame:
    """Queries with the grid level to search (`_level`) and how far (`_deg`): the finest cell around the query with more than `limit` wells holds
    the nearest ones' distance below its own extent. Queries without such a cell search the whole radius."""
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    size = F.lit(d) / F.pow(F.lit(2.0), F.col("_level"))
    key = ["_level", "_band", "_cell"]
    full = _cells(wells.select(well, "latitude", "longitude", level.alias("_level")), "latitude", "longitude", size)
    full = full.groupBy(*key, well).agg(F.lit(1).alias("_one")).groupBy(*key).agg(F.count(well).alias("_wells")).where(F.col("_wells") > limit).select(*key)
    at = queries.select("_lat", "_lon").distinct()
    found = _cells(at.withColumn("_level", level), "_lat", "_lon", size).join(full, key)
    inner = F.least(F.abs(F.col("_band") * size), F.abs((F.col("_band") + 1) * size))
    extent = size + _band_width(F.col("_band"), size) * F.cos(F.radians(inner))
    found = found.groupBy("_lat", "_lon").agg(F.max(F.struct("_level", F.least(extent * 1.000001 + 1e-6, F.lit(d)).alias("_deg"))).alias("_f"))
    found = found.select(F.col("_lat").alias("_lat_f"), F.col("_lon").alias("_lon_f"), "_f")
    out = queries.join(found, (F.col("_lat") == F.col("_lat_f")) & (F.col("_lon") == F.col("_lon_f")), "left").drop("_lat_f", "_lon_f")
    return out.select(*queries.columns, F.coalesce("_f._level", F.lit(0)).alias("_level"), F.coalesce("_f._deg", F.lit(d)).alias("_deg"))


def passages(chunks: DataFrame, documents: DataFrame, wells: DataFrame, well_id=None) -> DataFrame:
    """Chunks that have a vector, with their document and (if known) well."""
    d = broadcast_if_small(documents)
    w = broadcast_if_small(wells.select("well_id", "well_name"))
    out = chunks.where(F.col("embedding").isNotNull()).join(d, "document_id").join(w, "well_id", "left")
    return out if well_id is None else out.where(F.col("well_id") == well_id)


def attach_ids(df: DataFrame, wells: DataFrame, name: str = "well_name") -> tuple[DataFrame, DataFrame]:
    """Rows with the id of their well, and the names that no well carries with their row count."""
    w = broadcast_if_small(wells.select("well_id", name))
    missing = df.join(w, name, "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
    return df.join(w, name), missing


def attach_positions(wells: DataFrame, positions: DataFrame, on: str = "join_name") -> tuple[DataFrame, DataFrame]:
    """Wells with their position where one is known, and the wells left unmapped."""
    out = wells.join(broadcast_if_small(positions), on, "left")
    return out, out.where(F.col("latitude").isNull() | F.col("longitude").isNull())


def new_rows_only(candidates: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Candidates whose key is not stored yet; repeats inside the candidates count once."""
    rest = [c for c in candidates.columns if c not in key]
    have = existing.select(*[F.col(k).alias(k + "_x") for k in key]).distinct()
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(k + "_x"))
    fresh = candidates.join(have, cond, "left_anti")
    if not rest:
        return fresh.distinct()
    return fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*candidates.columns)


def known_wells_only(df: DataFrame, wells: DataFrame, name: str = "well_name") -> DataFrame:
    return df.join(broadcast_if_small(wells.select(name)), name, "left_semi")
