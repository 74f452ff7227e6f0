"""Cleaning, unit conversion, channel resolution and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.operators.skew import broadcast_if_small
from borelight.params import (
    CHANNEL_MAP,
    DEFAULTS,
    KNOWN_PLAIN_UNITS,
    PLAUSIBLE_RANGES,
    SENTINELS,
    UNIT_RULES,
)


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_as_null(df: DataFrame) -> DataFrame:
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in real else F.col(c) for c in df.columns]
    )


def null_sentinels(df: DataFrame, cols: list[str], sentinels=SENTINELS) -> DataFrame:
    """Replace exact sentinel values by NULL; no row is dropped."""
    hit = lambda c: F.col(c).isin(*[float(s) for s in sentinels])
    return df.select(*[F.when(~hit(c), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def unpivot_counts(df: DataFrame, counts: dict[str, Column], key: str, value: str) -> DataFrame:
    """One aggregate pass, then one row per entry."""
    one = df.agg(*[e.alias(f"_{i}") for i, e in enumerate(counts.values())])
    pairs = F.array(
        *[F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias(value)) for i, n in enumerate(counts)]
    )
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")


def sentinel_counts(df: DataFrame, cols: list[str], sentinels=SENTINELS) -> DataFrame:
    """Columns with sentinel hits and how many."""
    vals = [float(s) for s in sentinels]
    counts = {c: F.count_if(F.col(c).isin(*vals)) for c in cols}
    return unpivot_counts(df, counts, "column", "hits").where("hits > 0")


def parse_channels(
    long: DataFrame, value: str = "value", at: str = "time_text", null_value: str | None = "null_value",
    sentinels=SENTINELS, time_format: str | None = None,
) -> DataFrame:
    """Text samples to numbers and UTC times; the log's own null value and sentinels become NULL.

    Rows whose time cannot be read are dropped.
    """
    v = F.col(value).cast("string").try_cast("double")
    bad = F.isnan(v) | v.isin(*[float(s) for s in sentinels])
    if null_value and null_value in long.columns:
        own = F.col(null_value).cast("string").try_cast("double")
        bad = bad | F.coalesce(v == own, F.lit(False))
    ts = F.try_to_timestamp(F.col(at).cast("string"), F.lit(time_format)) if time_format else (
        F.col(at).cast("string").try_cast("timestamp")
    )
    return (
        long.withColumn(value, F.when(~bad, v)).withColumn("timestamp", ts).where(F.col("timestamp").isNotNull())
    )


def channel_table(spark: SparkSession, channel_map=CHANNEL_MAP) -> DataFrame:
    rows = [(c, m, i) for c, names in channel_map.items() for i, m in enumerate(names)]
    return spark.createDataFrame(rows, "channel string, mnemonic string, prio int")


def resolve_channels(
    long: DataFrame, channels: DataFrame, log: list[str], mnemonic: str = "mnemonic"
) -> DataFrame:
    """Per log object, the first listed mnemonic that is present for each channel."""
    present = long.select(*log, mnemonic).distinct()
    found = present.join(F.broadcast(channels), mnemonic)
    return found.groupBy(*log, "channel").agg(F.min_by(mnemonic, "prio").alias(mnemonic))


def missing_channels(resolved: DataFrame, channels: DataFrame) -> DataFrame:
    return channels.select("channel").distinct().join(resolved, "channel", "left_anti")


def wide_channels(
    long: DataFrame, resolved: DataFrame, log: list[str], keys: list[str], names: list[str],
    mnemonic: str = "mnemonic", value: str = "value",
) -> DataFrame:
    """One column per channel from the resolved mnemonics (conditional averages, one shuffle)."""
    r = broadcast_if_small(resolved)
    picked = long.join(r, [*log, mnemonic])
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("channel") == n, F.col(value))).alias(n) for n in names]
    )


def filter_logs(
    df: DataFrame, name: str = "log_name", index_type: str = "index_type",
    preferred=DEFAULTS.preferred_logs, wanted: str = DEFAULTS.index_type,
) -> DataFrame:
    return df.where(F.col(name).isin(*preferred) & (F.lower(F.col(index_type)) == wanted))


def skipped_logs(
    df: DataFrame, name: str = "log_name", index_type: str = "index_type",
    preferred=DEFAULTS.preferred_logs, wanted: str = DEFAULTS.index_type,
) -> DataFrame:
    """How many rows `filter_logs` keeps and leaves out, by reason."""
    by_name = F.col(name).isin(*preferred)
    by_type = F.lower(F.col(index_type)) == wanted
    return df.agg(
        F.count_if(by_name & by_type).alias("kept"),
        F.count_if(~by_name).alias("skipped_name"),
        F.count_if(by_name & ~by_type).alias("skipped_index_type"),
    )


def unit_table(spark: SparkSession, rules=UNIT_RULES) -> DataFrame:
    rows = [(u, *r) for u, r in rules.items()]
    return spark.createDataFrame(rows, "unit string, canonical string, scale double, shift double")


def convert_units(df: DataFrame, units: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Apply the linear unit rules; other values stay. Adds canonical_unit, converted, is_known."""
    u = F.broadcast(units.select(F.col("unit").alias("_u"), "canonical", "scale", "shift"))
    plain = F.coalesce(F.col(unit), F.lit("")).isin(*KNOWN_PLAIN_UNITS)
    hit = F.col("_u").isNotNull()
    return (
        df.join(u, F.col(unit) == F.col("_u"), "left")
        .withColumn(value, F.when(hit, F.col(value) * F.col("scale") + F.col("shift")).otherwise(F.col(value)))
        .withColumn("canonical_unit", F.coalesce("canonical", unit))
        .withColumn("converted", hit)
        .withColumn("is_known", hit | plain)
        .drop("_u", "canonical", "scale", "shift")
    )


def flag_implausible(df: DataFrame, ranges=PLAUSIBLE_RANGES) -> DataFrame:
    """Out-of-range values become NULL and are flagged; the row stays."""
    known = {c: r for c, r in ranges.items() if c in df.columns}
    out = {c: F.coalesce(~F.col(c).between(lo, hi), F.lit(False)) for c, (lo, hi) in known.items()}
    return df.select(
        *[F.when(~out[c], F.col(c)).alias(c) if c in out else F.col(c) for c in df.columns],
        *[out[c].alias(f"{c}_implausible") for c in out],
    )


def implausible_counts(df: DataFrame, ranges=PLAUSIBLE_RANGES) -> DataFrame:
    counts = {c: F.count_if(~F.col(c).between(*r)) for c, r in ranges.items() if c in df.columns}
    return unpivot_counts(df, counts, "channel", "implausible")


def select_curves(
    df: DataFrame, threshold: float = DEFAULTS.min_curve_coverage, excluded=(), candidates: list[str] | None = None
) -> tuple[list[str], list[str]]:
    """Names of curves covered well enough, and of the rejected ones (one aggregate row is read)."""
    names = [c for c in (candidates or number_columns(df)) if c not in excluded]
    row = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in names]).first()
    kept = sorted(c for c in names if row[c] is not None and row[c] >= threshold)
    return kept, sorted(set(names) - set(kept))


def curve_selection(
    df: DataFrame, names: list[str], threshold: float = DEFAULTS.min_curve_coverage
) -> DataFrame:
    """Coverage per curve and whether it is selected."""
    cover = {c: F.avg(F.col(c).isNotNull().cast("double")) for c in names}
    return unpivot_counts(df, cover, "curve", "coverage").withColumn(
        "selected", F.col("coverage") >= threshold
    )


def constant_channels(df: DataFrame, cols: list[str], tolerance: float = DEFAULTS.constant_tolerance) -> DataFrame:
    """Telemetry rule: more than one value and a spread within the tolerance."""
    spread = {
        c: (F.count(c) > 1) & (F.max(c) - F.min(c) <= tolerance) for c in cols
    }
    return unpivot_counts(df, spread, "channel", "constant").withColumn(
        "constant", F.coalesce("constant", F.lit(False))
    )


def uninformative_channels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Feature rule: at most one distinct value, columns without any value included."""
    flat = {c: F.coalesce(F.max(c) == F.min(c), F.lit(True)) for c in cols}
    return unpivot_counts(df, flat, "channel", "constant")


def decimate_by_depth(df: DataFrame, step: float, depth: str = "depth", eps: float = 0.08) -> DataFrame:
    """Rows just above a multiple of `step`, compared in single precision."""
    rest = F.col(depth).cast("float") % F.lit(step).cast("float")
    return df.where(rest < F.lit(eps).cast("float"))


def pack_map(df: DataFrame, cols: list[str], name: str, digits: int = 4, drop_null: bool = False) -> DataFrame:
    """Columns into one map column, rounded; optionally without the NULL entries."""
    entries = [x for c in cols for x in (F.lit(c), F.round(F.col(c).cast("double"), digits))]
    m = F.create_map(*entries)
    if drop_null:
        m = F.map_filter(m, lambda k, v: v.isNotNull())
    return df.select(*[c for c in df.columns if c not in cols], m.alias(name))


def unpack_map(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], *[F.col(name)[k].alias(k) for k in keys])


def validate_positions(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Positions outside the globe become NULL and are marked."""
    ok = F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)
    bad = F.coalesce(~ok, F.lit(False))
    return (
        df.withColumn("position_rejected", bad)
        .withColumn(lat, F.when(ok, F.col(lat)))
        .withColumn(lon, F.when(F.col(lat).isNotNull(), F.col(lon)))
    )


def filter_wells(
    df: DataFrame, field=None, dataset=None, has_telemetry=None, search=None, well_id=None, name=None
) -> DataFrame:
    """Wells meeting all given conditions."""
    tests = []
    if field is not None:
        tests.append(F.col("field_name") == field)
    if dataset is not None:
        tests.append(F.col("source_dataset") == dataset)
    if has_telemetry is not None:
        tests.append(F.col("has_telemetry") == has_telemetry)
    if search:
        tests.append(F.col("well_name").ilike(f"%{search}%"))
    if well_id is not None:
        tests.append(F.col("well_id") == well_id)
    if name is not None:
        tests.append(F.col("well_name") == name)
    for t in tests:
        df = df.where(t)
    return df


def depth_slice(
    df: DataFrame, depth: str, lo: float | None = None, hi: float | None = None,
    active_only: bool = False, order: list[str] | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Rows within closed depth bounds in order; rows without a depth drop out once a bound is given."""
    if lo is not None:
        df = df.where(F.col(depth) >= lo)
    if hi is not None:
        df = df.where(F.col(depth) <= hi)
    if active_only:
        df = df.where(F.col("operations_active"))
    df = df.orderBy(*[F.col(c).asc_nulls_last() for c in (order or [depth])])
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def filter_alerts(df: DataFrame, well=None, status=None, level=None, limit: int | None = None) -> DataFrame:
    """Alerts meeting all given conditions, latest first."""
    for c, v in (("well_id", well), ("status", status), ("level", level)):
        if v is not None:
            df = df.where(F.col(c) == v)
    df = df.orderBy(F.desc("raised_at"), "alert_id")
    return df if limit is None else df.limit(limit)


def absent_channels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Channels without a single value in the slice."""
    return unpivot_counts(df, {c: F.count(c) for c in cols}, "channel", "known").where("known = 0").select("channel")


def union_frames(*frames: DataFrame) -> DataFrame:
    """All rows of per-log, per-well or per-table frames; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
