"""Batch builds: prepared logs, prepared telemetry and the well tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelight.functions.scalars import join_name
from borelight.operators.clean import (
    decimate_by_depth,
    filter_logs,
    flag_implausible,
    null_sentinels,
    number_columns,
    pack_map,
    select_curves,
    validate_positions,
)
from borelight.operators.joins import attach_positions, recover_depths
from borelight.operators.positions import utm_to_wgs84
from borelight.operators.quantiles import group_median
from borelight.operators.skew import HOT_ROWS, broadcast_if_small
from borelight.operators.windows import (
    first_station_per_md,
    formation_runs,
    overall_spacing,
    resample,
    rig_state,
    rolling_depth_stats,
)
from borelight.params import CHANNEL_MAP, DEFAULTS, PLAUSIBLE_RANGES, SENTINELS, UNIT_RULES
from borelight.plans.lithology import well_splits


@dataclass
class PreparedLogs:
    features: DataFrame
    curves: list[str]
    rejected: list[str]
    spacing: float
    splits: DataFrame


def prepare_logs(
    raw: DataFrame, well: str = "WELL", depth: str = "DEPTH_MD", target: str | None = None, excluded=(),
    sentinels=SENTINELS, threshold: float = DEFAULTS.min_curve_coverage, windows_m=DEFAULTS.rolling_windows_m,
    ties: list[str] | None = None, curves: list[str] | None = None, spacing: float | None = None,
    max_rows: int = HOT_ROWS,
) -> PreparedLogs:
    """Sentinels out, curves chosen by measured coverage, depth windows and gradient, whole-well splits.

    Pass the training `curves` and `spacing` for held-out data.
    """
    numbers = [c for c in number_columns(raw) if c != target]
    clean = null_sentinels(raw, [c for c in numbers if c != depth], sentinels).where(F.col(depth).isNotNull())
    rejected: list[str] = []
    if curves is None:
        skip = {depth, *(excluded or ()), *([target] if target else []), *(ties or [])}
        curves, rejected = select_curves(clean, threshold, skip, numbers)
    if spacing is None:
        spacing = overall_spacing(clean, well=well, depth=depth, ties=ties, max_rows=max_rows).first()["spacing"]
    feats = rolling_depth_stats(clean, curves, spacing, windows_m, well, depth, ties, True, max_rows)
    splits = well_splits(clean, well, target) if target else None
    if splits is not None:
        feats = feats.join(broadcast_if_small(splits), well)
    return PreparedLogs(feats, curves, rejected, spacing, splits)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def channel_columns(logs: DataFrame, channel_map=CHANNEL_MAP, sentinels=SENTINELS, units=UNIT_RULES) -> DataFrame:
    """Log lines (`values`, `units` maps) to one canonical, converted column per channel.

    The first listed mnemonic the log has as a column is used, filled or not, so no shuffle is needed.
    """
    scale, shift = _lookup({u: r[1] for u, r in units.items()}), _lookup({u: r[2] for u, r in units.items()})
    at = F.trim(F.col("values")[F.coalesce("index_curve", F.lit("Time"))]).try_cast("timestamp")
    keep = ["well_name", "timestamp", "source_log", "source_file"]
    # the mnemonic, its number and the cleaned value are three projections, so nothing is worked out twice
    rows = logs.select(
        "well_name", at.alias("timestamp"), F.col("log_name").alias("source_log"), "source_file", "values", "units",
        F.col("null_value").try_cast("double").alias("_null"),
        *[
            F.coalesce(*[F.when(F.map_contains_key("values", m), F.lit(m)) for m in names]).alias(f"{c}#")
            for c, names in channel_map.items()
        ],
    ).where(F.col("timestamp").isNotNull())
    rows = rows.select(
        *keep, "_null",
        *[F.trim(F.col("values")[F.col(f"{c}#")]).try_cast("double").alias(c) for c in channel_map],
        *[F.col("units")[F.col(f"{c}#")].alias(f"{c}#") for c in channel_map],
    )

    def cleaned(c):
        v = F.col(c)
        bad = F.isnan(v) | v.isin(*[float(s) for s in sentinels]) | F.coalesce(v == F.col("_null"), F.lit(False))
        unit = F.col(f"{c}#")
        return F.when(~bad, F.coalesce(v * scale[unit] + shift[unit], v)).alias(c)

    return rows.select(*keep, *[cleaned(c) for c in channel_map])


@dataclass
class PreparedTelemetry:
    telemetry: DataFrame
    messages: DataFrame
    raw: DataFrame


def prepare_telemetry(
    logs: DataFrame, messages: DataFrame | None = None, channel_map=CHANNEL_MAP, ranges=PLAUSIBLE_RANGES,
    every: str = DEFAULTS.resample, max_rows: int = HOT_ROWS,
) -> PreparedTelemetry:
    """Parse and convert, null implausible values, resample, derive the rig state, place messages in depth.

    Implausible values are counted per bin; the range of the derived trip speed is applied after it exists.
    """
    wide = channel_columns(filter_logs(logs), channel_map)
    flagged = flag_implausible(wide, ranges)
    marks = [c for c in flagged.columns if c.endswith("_implausible")]
    bins = resample(flagged, list(channel_map), every, count_flags=marks)
    state = rig_state(bins, max_rows=max_rows)
    speed = {"trip_speed_m_per_min": ranges["trip_speed_m_per_min"]} if "trip_speed_m_per_min" in ranges else {}
    state = flag_implausible(state, speed)
    placed = None
    if messages is not None:
        placed = recover_depths(messages, state, reported="md_m")
    return PreparedTelemetry(state, placed, wide)


@dataclass
class WellTables:
    wells: DataFrame
    unmapped: DataFrame
    intervals: DataFrame
    log_samples: DataFrame
    telemetry: DataFrame | None
    stations: DataFrame | None


def build_wells(
    logs: DataFrame, positions: DataFrame, curves: list[str], headers: DataFrame | None = None,
    telemetry: DataFrame | None = None, stations: DataFrame | None = None, well: str = "WELL", depth: str = "DEPTH_MD",
    east: str = "X_LOC", north: str = "Y_LOC", group: str = "GROUP", formation: str = "FORMATION", zone: int = 31,
    step: float = 5.0, log_source: str = "logs", telemetry_source: str = "telemetry", ties: list[str] | None = None,
    max_rows: int = HOT_ROWS,
) -> WellTables:
    """Well table with capability flags and provenance, and the tables that hang off it."""
    mid = group_median(logs, [well], {east: "_east", north: "_north"}, max_rows)
    reach = logs.groupBy(well).agg(F.max(depth).alias("total_depth_md_m"))
    logged = utm_to_wgs84(reach.join(mid, well), "_east", "_north", zone).select(
        F.col(well).alias("well_name"), "total_depth_md_m", "latitude", "longitude", F.lit(True).alias("has_logs"), F.lit(False).alias("has_telemetry"),
        F.lit(False).alias("has_trajectory"), F.lit(log_source).alias("source_dataset"),
    )
    parts = [logged]
    if headers is not None:
        own = ["well_name", "field_name", "country", "region", "operator", "water_depth_m", "latitude", "longitude"]
        h = headers.select(*[c for c in own if c in headers.columns], join_name("well_name").alias("join_name"))
        pos = positions.select("join_name", F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon"),
                               *[c for c in ("kb_elevation_m", "total_depth_md_m") if c in positions.columns])
        h, _ = _placed(h, pos)
        live = telemetry.select("well_name").distinct().withColumn("_t", F.lit(True)) if telemetry is not None else None
        surv = stations.select("well_name").distinct().withColumn("_s", F.lit(True)) if stations is not None else None
        for extra, mark in ((live, "_t"), (surv, "_s")):
            h = h.join(broadcast_if_small(extra), "well_name", "left") if extra is not None else h.withColumn(mark, F.lit(False))
        parts.append(
            h.select(
                "*", F.lit(False).alias("has_logs"), F.coalesce("_t", F.lit(False)).alias("has_telemetry"),
                F.coalesce("_s", F.lit(False)).alias("has_trajectory"), F.lit(telemetry_source).alias("source_dataset"),
            ).drop("_t", "_s", "join_name")
        )
    wells = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wells = validate_positions(wells).withColumn("well_id", F.xxhash64("source_dataset", "well_name"))
    intervals = formation_runs(
        logs.select(F.col(well).alias("well_name"), F.col(depth).alias("depth"), F.col(group).alias("group_name"),
                    F.col(formation).alias("formation_name"), *(ties or [])),
        "well_name", "depth", ties=ties, max_rows=max_rows,
    ).withColumn("provenance", F.lit(log_source))
    samples = pack_map(
        decimate_by_depth(logs, step, depth).select(F.col(well).alias("well_name"), F.col(depth).alias("depth_md_m"), *curves),
        list(curves), "curves",
    )
    packed = None
    if telemetry is not None:
        flags = [c for c in ("circulating", "rotating", "tripping", "operations_active") if c in telemetry.columns]
        chans = [c for c in number_columns(telemetry) if c not in ("bit_depth_m", "hole_depth_m") and not c.endswith("_count")]
        keep = ["well_name", "timestamp", *[c for c in ("bit_depth_m", "hole_depth_m") if c in telemetry.columns], *flags]
        packed = pack_map(
            telemetry.select(*keep, *chans), chans, "channels", drop_null=True,
        )
    first = first_station_per_md(stations, "well_name") if stations is not None else None
    lost = wells.where(F.col("latitude").isNull() | F.col("longitude").isNull())
    return WellTables(wells, lost, intervals, samples, packed, first)


def _placed(headers: DataFrame, positions: DataFrame):
    out, lost = attach_positions(
        headers.withColumnsRenamed({"latitude": "_hlat", "longitude": "_hlon"}),
        positions.withColumnsRenamed({"_plat": "latitude", "_plon": "longitude"}),
    )
    source = F.when(F.col("_hlat").isNotNull(), "header").when(F.col("latitude").isNotNull(), "positions")
    return (
        out.withColumn("location_source", source)
        .withColumn("latitude", F.coalesce("_hlat", "latitude"))
        .withColumn("longitude", F.coalesce("_hlon", "longitude"))
        .drop("_hlat", "_hlon"),
        lost,
    )
