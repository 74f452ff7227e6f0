"""Depth and time windows per well. Every operator here is safe for a very large well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelight.operators.quantiles import group_median
from borelight.operators.skew import HOT_ROWS, broadcast_if_small, framed, run_starts, with_one_row
from borelight.operators.sliding import rolled
from borelight.params import DEFAULTS


def depth_spacing(
    df: DataFrame, well: str = "well", depth: str = "depth", ties: list[str] | None = None, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Median positive step per well (`spacing`)."""
    fr = framed(df.select(well, depth, *(ties or [])), [well], depth, before=1, max_rows=max_rows)
    w = Window.partitionBy(*fr.keys).orderBy(depth, *(ties or []))
    step = fr.df.withColumn("_step", F.col(depth) - F.lag(depth).over(w))
    step = fr.drop_halo(step).where(F.col("_step") > 0)
    return group_median(step, [well], {"_step": "spacing"}, max_rows)


def overall_spacing(df: DataFrame, **kw) -> DataFrame:
    """Median of the wells' spacings, one row."""
    return group_median(depth_spacing(df, **kw), [], {"spacing": "spacing"})


def window_samples(window_m: float, spacing: float) -> int:
    """Rows in a window of `window_m` metres at the measured spacing (at least 3)."""
    return max(3, int(round(window_m / spacing)))


def _centred(n: int) -> tuple[int, int]:
    ahead = (n - 1) // 2
    return -(n - 1 - ahead), ahead


def rolling_depth_stats(
    df: DataFrame,
    curves: list[str],
    spacing: float,
    windows_m=DEFAULTS.rolling_windows_m,
    well: str = "well",
    depth: str = "depth",
    ties: list[str] | None = None,
    gradient: bool = False,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Centred rolling mean and deviation per curve, and optionally the depth gradient.

    All windows share one shuffle and one sort; a value needs two known samples in its window.
    """
    sizes = {w: window_samples(w, spacing) for w in windows_m}
    frames = {w: _centred(n) for w, n in sizes.items()}
    before = max([-lo for lo, _ in frames.values()] + [1])
    after = max(hi for _, hi in frames.values()) if frames else 0
    fr = framed(df, [well], depth, before, after, max_rows)
    base = Window.partitionBy(*fr.keys).orderBy(depth, *(ties or []))
    frames = {f"{c}_roll{w:g}m": (c, lo, hi) for w, (lo, hi) in frames.items() for c in curves}
    grads = [_gradient(c, depth, base).alias(f"{c}_grad") for c in curves] if gradient else []
    out = rolled(fr.df, base, frames, grads)
    made = [f"{n}_{kind}" for n in frames for kind in ("mean", "std")] + [f"{c}_grad" for c in curves if gradient]
    return fr.drop_halo(out.select(*fr.df.columns, *made))


def _gradient(curve: str, depth: str, win) -> Column:
    step = F.col(depth) - F.lag(depth).over(win)
    return (F.col(curve) - F.lag(curve).over(win)) / F.nullif(step, F.lit(0.0))


def depth_gradient(
    df: DataFrame, curves: list[str], well: str = "well", depth: str = "depth",
    ties: list[str] | None = None, max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Change per metre from the previous sample; NULL where the depth did not move."""
    fr = framed(df, [well], depth, before=1, max_rows=max_rows)
    win = Window.partitionBy(*fr.keys).orderBy(depth, *(ties or []))
    return fr.drop_halo(fr.df.select("*", *[_gradient(c, depth, win).alias(f"{c}_grad") for c in curves]))


def rolling_time_stats(
    df: DataFrame,
    channels: list[str],
    windows: dict[str, int] | None = None,
    well: str = "well_name",
    at: str = "timestamp",
    ties: list[str] | None = None,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Trailing mean, deviation and end-to-end slope per window, plus the step from the last sample."""
    windows = windows or DEFAULTS.telemetry_windows
    fr = framed(df, [well], at, before=max(windows.values()), max_rows=max_rows)
    base = Window.partitionBy(*fr.keys).orderBy(at, *(ties or []))
    frames = {f"{c}_{name}": (c, -(n - 1), 0) for name, n in windows.items() for c in channels}
    steps = [((F.col(c) - F.lag(c, n).over(base)) / F.lit(float(n))).alias(f"{c}_{name}_slope") for name, n in windows.items() for c in channels]
    steps += [(F.col(c) - F.lag(c).over(base)).alias(f"{c}_rate") for c in channels]
    made = [f"{n}_{kind}" for n in frames for kind in ("mean", "std", "slope")] + [f"{c}_rate" for c in channels]
    return fr.drop_halo(rolled(fr.df, base, frames, steps).select(*fr.df.columns, *made))


def time_feature_names(channels: list[str], windows: dict[str, int] | None = None) -> list[str]:
    windows = windows or DEFAULTS.telemetry_windows
    made = [f"{c}_{w}_{s}" for w in windows for c in channels for s in ("mean", "std", "slope")]
    return list(channels) + sorted(made + [f"{c}_rate" for c in channels])


def resample(
    df: DataFrame,
    channels: list[str],
    every: str = DEFAULTS.resample,
    well: str = "well_name",
    at: str = "timestamp",
    flags: list[str] | None = None,
    count_flags: list[str] | None = None,
) -> DataFrame:
    """Mean per tumbling bin; state flags by majority, quality flags as counts; all-NULL bins dropped."""
    aggs = [F.avg(c).alias(c) for c in channels]
    aggs += [(F.avg(F.col(f).cast("double")) >= 0.5).alias(f) for f in flags or []]
    aggs += [F.count_if(F.col(f)).alias(f"{f}_count") for f in count_flags or []]
    out = df.groupBy(well, F.window(at, every).alias("_w")).agg(*aggs)
    some = F.coalesce(*[F.col(c).cast("double") for c in channels]).isNotNull()
    kept = [c for c in out.columns if c not in (well, "_w")]
    return out.where(some).select(well, F.col("_w.start").alias(at), *kept)


def rig_state(
    df: DataFrame,
    well: str = "well_name",
    at: str = "timestamp",
    bit: str = "bit_depth_m",
    flow: str = "flow_in_lpm",
    rpm: str = "bit_rpm",
    ties: list[str] | None = None,
    min_flow: float = DEFAULTS.min_flow_lpm,
    min_rpm: float = DEFAULTS.min_rpm,
    min_speed: float = DEFAULTS.min_trip_speed,
    active_states=("circulating", "rotating", "tripping"),
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Trip speed from the previous sample and the state flags; a missing channel means false."""
    fr = framed(df, [well], at, before=1, max_rows=max_rows)
    win = Window.partitionBy(*fr.keys).orderBy(at, *(ties or []))

    def above(c, limit):
        return F.coalesce(F.col(c) > limit, F.lit(False)) if c in df.columns else F.lit(False)

    minutes = (F.unix_micros(at) - F.lag(F.unix_micros(at)).over(win)) / F.lit(60e6)
    if bit in df.columns:
        speed = F.abs((F.col(bit) - F.lag(bit).over(win)) / F.nullif(minutes, F.lit(0.0)))
    else:
        speed = F.lit(None).cast("double")
    out = fr.drop_halo(fr.df.withColumn("trip_speed_m_per_min", speed))
    out = out.select(
        "*",
        above(flow, min_flow).alias("circulating"),
        above(rpm, min_rpm).alias("rotating"),
        F.coalesce(F.col("trip_speed_m_per_min") > min_speed, F.lit(False)).alias("tripping"),
    )
    active = F.lit(False)
    for s in active_states:
        active = active | F.col(s)
    return out.withColumn("operations_active", active)


def formation_runs(
    df: DataFrame,
    well: str = "well",
    depth: str = "depth",
    group: str = "group_name",
    formation: str = "formation_name",
    ties: list[str] | None = None,
    max_gap: float | None = None,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Depth intervals over which group and formation stay the same."""
    rows = df.where(F.col(group).isNotNull() | F.col(formation).isNotNull())
    same = F.col("_pg").eqNullSafe(F.col(group)) & F.col("_pf").eqNullSafe(F.col(formation))
    start = (F.col("_rn") == 1) & F.col("_pd").isNull() | ~same
    if max_gap is not None:
        start = start | (F.col(depth) - F.col("_pd") > max_gap)
    rows = run_starts(
        rows.select(well, depth, group, formation, *(ties or [])),
        [well],
        [depth, *(ties or [])],
        start,
        max_rows=max_rows,
        lag_cols={depth: "_pd", group: "_pg", formation: "_pf"},
    )
    return (
        rows.groupBy(well, "run_start", group, formation)
        .agg(
            F.min(depth).alias("depth_top_m"),
            F.max(depth).alias("depth_base_m"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .drop("run_start")
    )


def non_monotonic_wells(
    df: DataFrame, well: str = "well", depth: str = "depth", row: str = "row_index", max_rows: int = HOT_ROWS
) -> DataFrame:
    """Wells whose depth goes back somewhere in file order, with the number of such rows."""
    fr = framed(df.select(well, depth, row), [well], row, before=1, max_rows=max_rows)
    win = Window.partitionBy(*fr.keys).orderBy(row)
    back = fr.df.withColumn("_back", F.col(depth) < F.lag(depth).over(win))
    return (
        fr.drop_halo(back).groupBy(well).agg(F.count_if("_back").alias("reversals")).where("reversals > 0")
    )


def segment_rows(
    df: DataFrame,
    well: str = "well",
    depth: str = "depth",
    length: float = DEFAULTS.segment_length_m,
    stride: float = DEFAULTS.segment_stride_m,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Rows repeated once per overlapping depth segment they fall in (`segment` numbers them per well).

    `ends` may give the depth range of every well (columns well, _d0, _d1) when it is known already.
    """
    if ends is None:
        ends = broadcast_if_small(df.groupBy(well).agg(F.min(depth).alias("_d0"), F.max(depth).alias("_d1")))
    ends = ends.withColumnRenamed(well, "_well")
    rel = F.col(depth) - F.col("_d0")
    lo = F.greatest(F.lit(0).cast("long"), F.floor((rel - length) / stride).cast("long") + 1)
    hi = F.floor(rel / stride).cast("long")
    rows = df.join(ends, F.col(well) == F.col("_well")).withColumn("segment", F.explode(F.sequence(lo, hi)))
    start = F.col("_d0") + F.col("segment") * F.lit(float(stride))
    inside = (F.col(depth) >= start) & (F.col(depth) < start + length) & (start < F.col("_d1"))
    return rows.where(inside).drop("_d0", "_d1", "_well")


def depth_segments(
    df: DataFrame,
    well: str = "well",
    depth: str = "depth",
    length: float = DEFAULTS.segment_length_m,
    stride: float = DEFAULTS.segment_stride_m,
    min_samples: int = DEFAULTS.segment_min_samples,
) -> DataFrame:
    """Overlapping depth segments with enough samples."""
    return (
        segment_rows(df, well, depth, length, stride)
        .groupBy(well, "segment")
        .agg(
            F.min(depth).alias("segment_top_m"),
            F.max(depth).alias("segment_base_m"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .where(F.col("sample_count") >= min_samples)
    )


def latest_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by the order columns (partial aggregation, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def latest_n(
    df: DataFrame, n: int = 300, well: str = "well_id", order: str = "index", ties: list[str] | None = None,
    max_rows: int = HOT_ROWS, index: str | None = None,
) -> DataFrame:
    """Last `n` rows per well; a row repeating the index of the row before it is ignored."""
    index = index or order
    fr = framed(df, [well], order, before=1, max_rows=max_rows)
    win = Window.partitionBy(*fr.keys).orderBy(order, *(ties or []))
    rows = fr.df.withColumn("_prev", F.lag(index).over(win))
    rows = fr.drop_halo(rows).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(index))).drop("_prev")
    last = Window.partitionBy(well).orderBy(F.desc(order), *[F.desc(t) for t in ties or []])
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)


def first_station_per_md(df: DataFrame, well: str = "well_id", md: str = "md_m", order: str = "source_order") -> DataFrame:
    """First trajectory station per well and measured depth; stations without one are dropped."""
    rest = [c for c in df.columns if c not in (well, md)]
    first = (
        df.where(F.col(md).isNotNull())
        .groupBy(well, md)
        .agg(F.min_by(F.struct(*rest), order).alias("_r"))
    )
    return first.select(well, md, "_r.*").select(*df.columns)


def score_range_normalise(df: DataFrame, score: str = "raw_score", name: str = "anomaly_score") -> DataFrame:
    """(highest - score) / (highest - lowest), 0 when all scores are equal."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    span = F.col("_ends.hi") - F.col("_ends.lo")
    value = F.when(span > 0, (F.col("_ends.hi") - F.col(score)) / span).otherwise(F.lit(0.0))
    return with_one_row(df, ends, "_ends").withColumn(name, value).drop("_ends")


def chunk_numbering(chunks: DataFrame, stored_max: DataFrame, document: str = "document_id") -> DataFrame:
    """Number new chunks per document after the largest stored index (which may be 0).

    `chunks` needs page_number and piece (position within the page). Pages are numbered from their
    chunk counts, so only one small row per page passes through the ordered window.
    """
    per_page = chunks.groupBy(document, "page_number").agg(F.count(F.lit(1)).alias("_n"))
    win = Window.partitionBy(document).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_page.select(
        document, "page_number", F.coalesce(F.sum("_n").over(win), F.lit(0)).alias("_offset")
    )
    in_page = Window.partitionBy(document, "page_number").orderBy("piece")
    have = stored_max.select(document, F.col("max_index").alias("_max"))
    return (
        chunks.withColumn("_i", F.row_number().over(in_page) - 1)
        .join(offset, [document, "page_number"])
        .join(broadcast_if_small(have), document, "left")
        .withColumn("chunk_index", F.coalesce("_max", F.lit(-1)) + 1 + F.col("_offset") + F.col("_i"))
        .drop("_i", "_offset", "_max")
    )


def replay_timeline(
    df: DataFrame,
    speed: float = 60.0,
    start_index: int = 0,
    well: str = "well_id",
    at: str = "recorded_at",
    cadence_s: float = 10.0,
    real_spacing: bool = False,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Emission time of every stored sample from `start_index` on, in seconds after the start.

    The index is counted in two steps (rows per day, then within the day), so a long record does not
    have to be sorted in one task. With `real_spacing` the recorded gaps are used instead of the cadence.
    """
    speed = max(DEFAULTS.replay_min_speed, min(float(speed), DEFAULTS.replay_max_speed))
    interval = max(0.01, cadence_s / max(speed, 1e-6))
    day = F.floor(F.unix_micros(at) / F.lit(86400e6)).cast("long")
    rows = df.withColumn("_day", day)
    per_day = rows.groupBy(well, "_day").agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first")
    )
    w = Window.partitionBy(well).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(well)
    per_day = per_day.select(
        well,
        "_day",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
        F.min("_first").over(whole).alias("_t0"),
        F.sum("_n").over(whole).alias("_total"),
    )
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(well, "_day").orderBy(at)) - 1)
    rows = rows.join(per_day, [well, "_day"]).withColumn("index", (F.col("_before") + F.col("_i")).cast("long"))
    first = F.least(F.greatest(F.lit(start_index), F.lit(0)), F.greatest(F.col("_total") - 1, F.lit(0)))
    rows = rows.where(F.col("index") >= first)
    if real_spacing:
        offset = (F.unix_micros(at) - F.unix_micros("_t0")) / F.lit(1e6) / F.lit(speed)
    else:
        offset = (F.col("index") - first) * F.lit(interval)
    return (
        rows.withColumn("emit_offset_s", offset)
        .withColumn("is_last", F.col("index") == F.col("_total") - 1)
        .drop("_day", "_before", "_i", "_t0", "_total")
    )
