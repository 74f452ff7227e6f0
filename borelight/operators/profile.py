"""Profiles, inventories, counts and quality reports. Wide reports take one aggregate pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borelight.functions.scalars import lithology_name
from borelight.operators.clean import number_columns, unpivot_counts
from borelight.operators.quantiles import group_median, group_quantiles
from borelight.operators.skew import HOT_ROWS, broadcast_if_small, with_one_row
from borelight.params import DEFAULTS, LITHOLOGY_NAMES


def profile_columns(df: DataFrame) -> DataFrame:
    """Type, known and unknown counts, NULL share and numeric summary of every column."""
    numbers = set(number_columns(df))
    kinds = dict(df.dtypes)
    null_double = F.lit(None).cast("double")
    one = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count(c).alias(f"{c}#n") for c in df.columns],
        *[
            f(F.col(c).cast("double")).alias(f"{c}#{n}")
            for c in numbers
            for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))
        ],
    )

    def entry(c):
        known = F.col(f"`{c}#n`")
        share = F.when(F.col("_all") > 0, F.round((F.col("_all") - known) / F.col("_all"), 6)).otherwise(1.0)
        stats = [
            (F.col(f"`{c}#{n}`") if c in numbers else null_double).alias(n) for n in ("min", "max", "mean", "std")
        ]
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("dtype"),
            known.alias("non_null"),
            (F.col("_all") - known).alias("null_count"),
            share.alias("null_fraction"),
            *stats,
        )

    return one.select(F.explode(F.array(*[entry(c) for c in df.columns])).alias("_e")).select("_e.*")


def _value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def profile_categories(df: DataFrame, cols: list[str], top_n: int = 10) -> DataFrame:
    """Most frequent values per column with the number of distinct ones."""
    counts = _value_counts(df, cols)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    w = Window.partitionBy("column").orderBy(F.desc("rows"), "value")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return top.join(F.broadcast(distinct), "column")


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct known values per column."""
    if approx:
        return unpivot_counts(df, {c: F.approx_count_distinct(c) for c in cols}, "column", "distinct_values")
    return _value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def top_values(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where(F.col(column).isNotNull())
        .orderBy(F.desc("rows"), column).limit(n)
    )


def well_depth_ranges(df: DataFrame, well: str = "well", depth: str = "depth") -> DataFrame:
    return df.groupBy(well).agg(
        F.count(F.lit(1)).alias("rows"), F.min(depth).alias("depth_min"), F.max(depth).alias("depth_max")
    )


def rows_per_well(df: DataFrame, well: str = "well") -> DataFrame:
    """Wells, and smallest, median and largest number of rows per well."""
    n = df.groupBy(well).agg(F.count(F.lit(1)).alias("rows"))
    ends = n.agg(F.count(F.lit(1)).alias("wells"), F.min("rows").alias("rows_min"), F.max("rows").alias("rows_max"))
    mid = group_median(n, [], {"rows": "rows_median"})
    return with_one_row(ends, mid, "_m").select("wells", "rows_min", "_m.rows_median", "rows_max")


def curve_coverage(df: DataFrame, curves: list[str]) -> DataFrame:
    cover = {c: F.avg(F.col(c).isNotNull().cast("double")) for c in curves}
    return unpivot_counts(df, cover, "curve", "coverage").orderBy(F.desc("coverage"), "curve")


def curve_well_presence(df: DataFrame, curves: list[str], well: str = "well") -> DataFrame:
    """Number of wells in which each curve has at least one value."""
    per_well = df.groupBy(well).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in curves])
    return unpivot_counts(per_well, {c: F.count_if(F.col(c)) for c in curves}, "curve", "wells")


def class_distribution(df: DataFrame, code: str, names: dict[int, str] = LITHOLOGY_NAMES) -> DataFrame:
    """Rows and share per class (NULL is a class), its name, and largest over smallest class."""
    n = df.groupBy(code).agg(F.count(F.lit(1)).alias("rows"))
    ends = n.agg(F.sum("rows").alias("all"), F.max("rows").alias("hi"), F.min("rows").alias("lo"))
    known = F.col(code).cast("int").isin(*names)
    name = F.when(known, lithology_name(code, names)).otherwise(F.lit("UNKNOWN_CODE"))
    return with_one_row(n, ends, "_t").select(
        code,
        "rows",
        F.round(F.col("rows") / F.col("_t.all"), 6).alias("fraction"),
        F.coalesce(name, F.lit("UNKNOWN_CODE")).alias("name"),
        (F.col("_t.hi") / F.col("_t.lo")).alias("imbalance"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, and their share."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("fraction", F.when(F.col("rows") > 0, F.col("duplicates") / F.col("rows")).otherwise(0.0))


def short_wells(df: DataFrame, well: str = "well", minimum: int = DEFAULTS.min_rows_per_well) -> DataFrame:
    return df.groupBy(well).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") < minimum)


def null_depth_rows(df: DataFrame, depth: str = "depth") -> DataFrame:
    return df.agg(F.count_if(F.col(depth).isNull()).alias("null_depth_rows"))


def value_range(df: DataFrame, cols: list[str]) -> DataFrame:
    p = profile_columns(df.select(*cols))
    return p.select("column", "min", "max", "null_fraction")


def channel_inventory(
    long: DataFrame, units: DataFrame, log: str = "log_id", mnemonic: str = "mnemonic",
    value: str = "value", unit: str = "unit",
) -> DataFrame:
    """Per mnemonic: logs, rows, populated share, declared and canonical units, whether all are known."""
    from borelight.operators.clean import convert_units

    rows = long.groupBy(mnemonic, log, unit).agg(
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_k")
    )
    named = convert_units(rows.withColumn("_x", F.lit(0.0)), units, "_x", unit)
    return named.groupBy(mnemonic).agg(
        F.count_distinct(log).alias("logs"),
        F.sum("_n").alias("rows"),
        F.round(F.sum("_k") / F.sum("_n"), 4).alias("populated"),
        F.array_sort(F.collect_set(unit)).alias("units"),
        F.array_sort(F.collect_set("canonical_unit")).alias("canonical_units"),
        F.min("is_known").alias("all_known"),
    )


def unknown_units(long: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    from borelight.operators.clean import convert_units

    seen = long.groupBy(unit).agg(F.count(F.lit(1)).alias("rows")).withColumn("_x", F.lit(0.0))
    return convert_units(seen, units, "_x", unit).where(~F.col("is_known")).select(unit, "rows")


def trajectory_summary(stations: DataFrame, well: str = "well_id") -> DataFrame:
    return stations.groupBy(well).agg(
        F.count(F.lit(1)).alias("stations"),
        F.min("md_m").alias("md_min"),
        F.max("md_m").alias("md_max"),
        F.max("tvd_m").alias("tvd_max"),
        F.max("inclination_deg").alias("inclination_max"),
        F.array_sort(F.collect_set("station_type")).alias("station_types"),
    )


def message_summary(
    messages: DataFrame, well: str = "well_name", at: str = "recorded_at", depth: str = "md_m",
    kind: str = "message_type", text: str = "text", max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Counts, depth and time range, types and median text length per well."""
    m = messages.withColumn("_len", F.length(text))
    mid = group_median(m, [well], {"_len": "median_text_length"}, max_rows)
    rest = m.groupBy(well).agg(
        F.count(F.lit(1)).alias("messages"),
        F.count(depth).alias("with_depth"),
        F.min(depth).alias("depth_min"),
        F.max(depth).alias("depth_max"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count_distinct(kind).alias("message_types"),
    )
    return rest.join(mid, well)


def message_types(messages: DataFrame, well: str = "well_name", kind: str = "message_type") -> DataFrame:
    return messages.groupBy(well, kind).agg(F.count(F.lit(1)).alias("rows"))


def behaviour_profile(
    telemetry: DataFrame, channels: list[str], well: str = "well_id", max_rows: int = HOT_ROWS, approx: bool = False
) -> DataFrame:
    """Median of each channel over active rows as a map; channels without values are left out."""
    active = telemetry.where(F.col("operations_active"))
    med = group_median(active, [well], {c: c for c in channels}, max_rows, approx)
    entries = [x for c in channels for x in (F.lit(c), F.col(c))]
    profile = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    return med.select(well, profile.alias("profile")).where(F.size("profile") > 0)


def status_counts(
    wells: DataFrame, telemetry: DataFrame, events: DataFrame, segments: DataFrame, alerts: DataFrame,
    actions: DataFrame,
) -> DataFrame:
    """The eight stock counts, one row each."""
    w = unpivot_counts(
        wells,
        {
            "wells": F.count(F.lit(1)),
            "wells_with_position": F.count("latitude"),
            "wells_with_telemetry": F.count_if(F.col("has_telemetry")),
        },
        "name",
        "count",
    )
    others = {
        "telemetry_samples": telemetry,
        "drilling_events": events,
        "well_embeddings": segments,
        "risk_alerts": alerts,
        "engineer_actions": actions,
    }
    parts = [d.agg(F.count(F.lit(1)).alias("count")).select(F.lit(n).alias("name"), "count") for n, d in others.items()]
    return reduce(DataFrame.unionByName, parts, w)


def status_warnings(counts: DataFrame, models: DataFrame) -> DataFrame:
    """Warnings for wells without a position and for an empty model registry."""
    wide = counts.agg(
        F.max(F.when(F.col("name") == "wells", F.col("count"))).alias("wells"),
        F.max(F.when(F.col("name") == "wells_with_position", F.col("count"))).alias("placed"),
    )
    lost = F.col("wells") - F.col("placed")
    a = wide.where(lost > 0).select(
        F.concat(
            lost.cast("string"),
            F.lit(" of the wells cannot be placed: no coordinates, so neither distances nor a map can use them."),
        ).alias("warning")
    )
    b = models.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("The registry holds no model, so nothing can be predicted yet.").alias("warning")
    )
    return a.unionByName(b)


def corpus_status(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.count("embedding").alias("chunks_embedded"),
        (F.count("embedding") > 0).alias("searchable"),
    )


def page_summary(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """Pages, pages with text, characters and confidence per document."""
    blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return pages.groupBy(document).agg(
        F.count(F.lit(1)).alias("pages_processed"),
        F.count_if(~blank).alias("pages_with_text"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"),
        F.round(F.avg("confidence"), 4).alias("confidence_mean"),
        F.round(F.min("confidence"), 4).alias("confidence_min"),
    )


def page_methods(pages: DataFrame, document: str = "document_id") -> DataFrame:
    """Pages per reading method of each document."""
    return pages.groupBy(document, "method").agg(F.count(F.lit(1)).alias("pages"))


def state_counts(telemetry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    states = ("circulating", "rotating", "tripping", "operations_active")
    return telemetry.groupBy(*(keys or [])).agg(*[F.count_if(F.col(s)).alias(s) for s in states])


def anomaly_rates(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, anomalies and rate, overall or per key."""
    return scores.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.round(F.avg(F.col("is_anomaly").cast("double")), 4).alias("rate"),
    )


def anomaly_rates_by_state(scores: DataFrame, states=("circulating", "rotating", "tripping")) -> DataFrame:
    on = F.filter(
        F.array(*[F.when(F.col(s), F.lit(s)) for s in states if s in scores.columns]), lambda x: x.isNotNull()
    )
    return anomaly_rates(scores.select("is_anomaly", F.explode(on).alias("state")), ["state"])


def score_distribution(scores: DataFrame, score: str = "anomaly_score", max_rows: int = HOT_ROWS) -> DataFrame:
    """Smallest, largest and interpolated 50th, 90th and 99th percentile score."""
    q = group_quantiles(scores, [], [score], [0.0, 0.5, 0.9, 0.99, 1.0], max_rows)
    names = ("min", "p50", "p90", "p99", "max")
    return q.select(*[F.round(F.col(score)[i], 4).alias(n) for i, n in enumerate(names)])


def split_coverage(df: DataFrame, assignment: DataFrame, well: str = "well", target: str = "lithology") -> DataFrame:
    """Wells, rows and rows per class of each split."""
    a = broadcast_if_small(assignment.select(well, "split"))
    return df.join(a, well).groupBy("split", target).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(well).alias("wells")
    )


def absent_from_split(df: DataFrame, assignment: DataFrame, well: str = "well", target: str = "lithology") -> DataFrame:
    """Classes that a split does not contain."""
    have = split_coverage(df, assignment, well, target).where(F.col(target).isNotNull())
    present = have.groupBy("split").agg(F.collect_set(target).alias("_has"))
    whole = have.agg(F.collect_set(target).alias("classes"))
    return with_one_row(present, whole, "_all").select(
        "split", F.explode(F.array_sort(F.array_except("_all.classes", "_has"))).alias(target)
    )


def exclusion_reasons(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "reason")


def risk_mode(events: DataFrame, threshold: int = DEFAULTS.supervised_threshold, forced: str | None = None) -> DataFrame:
    """One row: the risk mode the stored labelled events justify, and why."""
    n = events.agg(F.count("category").alias("labelled"))
    if forced in ("supervised", "hybrid_indicator"):
        return n.select(
            "labelled", F.lit(forced).alias("mode"),
            F.lit(f"mode forced to '{forced}' by configuration").alias("reason"),
        )
    enough = F.col("labelled") >= threshold
    count = F.col("labelled").cast("string")
    return n.select(
        "labelled",
        F.when(enough, "supervised").otherwise("hybrid_indicator").alias("mode"),
        F.when(enough, F.concat(count, F.lit(f" labelled events meet the threshold of {threshold}"))).otherwise(
            F.concat(
                count, F.lit(f" labelled events are too few to train on ({threshold} needed): scores are indicators from past events, without probabilities"),
            )
        ).alias("reason"),
    )


def embedding_report(chunks: DataFrame) -> DataFrame:
    done = F.col("embedding").isNotNull()
    return chunks.agg(
        F.count_if(done).alias("embedded"),
        F.count_distinct(F.when(done, F.col("document_id"))).alias("documents_covered"),
        F.avg(F.when(done, F.length("text"))).alias("mean_characters"),
    )


def unmapped_count(wells: DataFrame) -> DataFrame:
    return wells.agg(F.count_if(F.col("latitude").isNull()).alias("unmapped"))


def prepare_report(
    raw: DataFrame, prepared: DataFrame, channels: list[str], well: str = "well_name", at: str = "timestamp",
    bit: str = "bit_depth_m",
) -> DataFrame:
    """Per well: rows before and after resampling, time range, deepest bit, active rows, missing channels."""
    before = raw.groupBy(well).agg(F.count(F.lit(1)).alias("rows_before"))
    have = [c for c in channels if c in prepared.columns]
    lost = [c for c in channels if c not in prepared.columns]
    empty = F.filter(
        F.array(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in have], *[F.lit(c) for c in lost]),
        lambda x: x.isNotNull(),
    )
    after = prepared.groupBy(well).agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max(bit).alias("bit_depth_max"),
        F.count_if("operations_active").alias("active_rows"),
        *[F.count(c).alias(f"_{c}") for c in have],
    )
    after = after.withColumn("missing_channels", empty).drop(*[f"_{c}" for c in have])
    return before.join(after, well, "left")


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys stored more than once (uniqueness constraints become data checks)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def shared_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def assert_disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> None:
    """Raise when both frames hold a key in common."""
    first = shared_keys(a, b, key).limit(5).collect()
    if first:
        raise ValueError(f"shared keys: {[tuple(r) for r in first]}")
