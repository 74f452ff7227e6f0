"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from borelight.params import (
    BEHAVIOUR_SCALES,
    DEFAULTS,
    EARTH_RADIUS_KM,
    LITHOLOGY_NAMES,
    RISK_LEVELS,
    RISK_RULES,
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), 2
    )
    # least and greatest pass over NULL, so an unknown position is kept out of them
    return F.when(half.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half))))


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    cosine = F.cos(lat1) * F.cos(lat2) * F.cos(lon2 - lon1) + F.sin(lat1) * F.sin(lat2)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    return F.when(cosine.isNotNull(), F.lit(EARTH_RADIUS_KM) * angle)


def exp_decay(x, scale: float) -> Column:
    return F.exp(-col(x) / F.lit(float(scale)))


def jaccard(a, b) -> Column:
    """Shared over all names; 0 when either set is empty or unknown."""
    a, b = col(a), col(b)
    some = (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (
        F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0
    )
    return F.when(
        some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    ).otherwise(F.lit(0.0))


def shared_names(forms_a, forms_b, groups_a, groups_b) -> Column:
    """Sorted shared formations, or shared groups when no formation is shared."""
    f = F.array_sort(F.array_intersect(col(forms_a), col(forms_b)))
    g = F.array_sort(F.array_intersect(col(groups_a), col(groups_b)))
    return F.when(F.size(f) > 0, f).otherwise(g)


def absent_classes(all_classes, present) -> Column:
    return F.array_sort(F.array_except(col(all_classes), col(present)))


def behaviour_similarity(a, b, scales: dict[str, float] = BEHAVIOUR_SCALES) -> Column:
    """Struct (value, shared): mean of exp(-|difference|/scale) over channels both maps hold."""
    a, b = col(a), col(b)
    parts = F.filter(
        F.array(
            *[
                F.when(
                    a[k].isNotNull() & b[k].isNotNull(),
                    F.exp(-F.abs(a[k] - b[k]) / F.lit(float(s) or 1.0)),
                )
                for k, s in scales.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(parts)
    return F.struct(F.when(n > 0, total / n).otherwise(0.0).alias("value"), n.alias("shared"))


def risk_level(score, levels: dict[str, float] = RISK_LEVELS) -> Column:
    """Name of the greatest threshold not above the score; the lowest name otherwise."""
    ordered = sorted(levels.items(), key=lambda kv: kv[1], reverse=True)
    out = None
    for name, at in ordered:
        hit = col(score) >= F.lit(float(at))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(ordered[-1][0])


def level_rank(level, levels: dict[str, float] = RISK_LEVELS) -> Column:
    ordered = sorted(levels, key=levels.get)
    return F.array_position(F.array(*[F.lit(n) for n in ordered]), col(level))


def evaluate_rules(channels, rules=RISK_RULES) -> Column:
    """Struct (score, messages) of the configured bands broken by a channel map."""
    m = col(channels)
    found = []
    for name, (lo, hi) in rules.items():
        v = m[name].cast("double")
        if lo is not None:
            text = F.format_string(
                f"{name} = %.2f is below the configured minimum of {lo:.2f}", v
            )
            found.append(F.when(v < F.lit(float(lo)), text))
        if hi is not None:
            text = F.format_string(f"{name} = %.2f exceeds the configured maximum of {hi:.2f}", v)
            found.append(F.when(v > F.lit(float(hi)), text))
    messages = F.filter(F.array(*found), lambda x: x.isNotNull())
    score = F.least(F.lit(1.0), F.size(messages) / F.lit(float(max(1, len(rules)))))
    return F.struct(score.alias("score"), messages.alias("messages"))


def nearest_offset(offsets, lookahead: float = DEFAULTS.lookahead_m) -> Column:
    """Smallest absolute offset of an array; unknown offsets and no evidence count as the full window."""
    gaps = F.transform(col(offsets), lambda o: F.coalesce(F.abs(o), F.lit(float(lookahead))))
    return F.coalesce(F.array_min(gaps), F.lit(float(lookahead)))


def proximity(offset, lookahead: float = DEFAULTS.lookahead_m) -> Column:
    gap = F.coalesce(F.abs(col(offset)), F.lit(float(lookahead)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(float(lookahead)))


def weighted_mean(components) -> Column:
    """Weighted mean of an array of (value, weight) structs, leaving NULL values out; NULL if none."""
    have = F.filter(col(components), lambda c: c["value"].isNotNull())
    total = F.aggregate(have, F.lit(0.0), lambda acc, c: acc + c["weight"])
    summed = F.aggregate(have, F.lit(0.0), lambda acc, c: acc + c["value"] * c["weight"])
    return F.when(total > 0, summed / total)


def _relation(offset, zero: str, plus: str, minus: str) -> Column:
    r = F.floor(col(offset) + 0.5)
    n = F.abs(r).cast("string")
    return (
        F.when(r == 0, zero)
        .when(r > 0, F.concat(n, F.lit(f" m {plus}")))
        .when(r < 0, F.concat(n, F.lit(f" m {minus}")))
    )


def relation_to_bit(offset) -> Column:
    return _relation(offset, "at the bit", "ahead", "behind")


def relation_in_depth(offset) -> Column:
    return _relation(offset, "same depth", "deeper", "shallower")


def quantise_depth(depth, step: float = DEFAULTS.context_step_m) -> Column:
    return F.floor(col(depth) / F.lit(float(step)) + 0.5) * F.lit(float(step))


def next_context_depth(previous, bit, step: float = DEFAULTS.context_step_m) -> Column:
    """New context depth once the bit moved a full step from the previous one; else the previous."""
    p = col(previous)
    keep = p.isNotNull() & (F.abs(col(bit) - p) < F.lit(float(step)))
    return F.when(keep, p).otherwise(quantise_depth(bit, step))


def dedupe_key(well, level, depth, window: float = DEFAULTS.alert_depth_window_m) -> Column:
    bucket = F.floor(F.coalesce(col(depth), F.lit(0.0)) / F.lit(float(window)))
    return F.concat_ws(":", col(well).cast("string"), col(level), bucket.cast("string"))


def slugify(name) -> Column:
    return F.trim(F.regexp_replace(col(name), "[^A-Za-z0-9]+", "_"), F.lit("_"))


def citation_path(path, root: str) -> Column:
    """Path relative to a root; other paths stay as they are."""
    prefix = root.rstrip("/") + "/"
    p = col(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 2**31 - 1)).otherwise(p)


def decode_dir(name) -> Column:
    """Directory name to well name: `$N$` stands for the character with the decimal code N, `_/_` for a slash."""
    codes = F.array_distinct(F.regexp_extract_all(col(name), F.lit(r"\$(\d{1,5})\$"), F.lit(1)))

    def put(text, code):
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        return F.when(code.cast("long") < 65536, F.replace(text, F.concat(F.lit("$"), code, F.lit("$")), char)).otherwise(text)

    plain = F.aggregate(codes, col(name).cast("string"), put)
    return F.replace(plain, F.lit("_/_"), F.lit("/"))


def join_name(name) -> Column:
    return F.trim(F.replace(col(name), F.lit("NO "), F.lit("")))


def point_wkt(lon, lat) -> Column:
    both = col(lon).isNotNull() & col(lat).isNotNull()
    text = F.concat(
        F.lit("SRID=4326;POINT("), col(lon).cast("string"), F.lit(" "), col(lat).cast("string"), F.lit(")")
    )
    return F.when(both, text)


def lithology_name(code, names: dict[int, str] = LITHOLOGY_NAMES) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[col(code).cast("int")], col(code).cast("int").cast("string"))


def investigation_query(formation, event_type, description, length: int | None = None) -> Column:
    """The known parts as one search text; cut to `length` characters only if asked."""
    words = [F.when(col(c) != "", col(c)) for c in (formation, event_type, description)]
    text = F.concat_ws(" ", *words)
    return text if length is None else F.substring(text, 1, length)


def narrative(level, well, depth, components, evidence_count, evidence_wells, mode) -> Column:
    """What a reader should know first: level and place, up to three signs by weighted size, what earlier records say, and how to read it."""
    place = F.concat(col(well), F.when(col(depth).isNotNull(), F.format_string(", %.0f m MD", col(depth))).otherwise(""))
    signs = F.filter(col(components), lambda c: c["value"].isNotNull())
    by_size = F.array_sort(F.transform(signs, lambda c: F.struct((-(c["value"] * c["weight"])).alias("k"), c["name"].alias("n"), c["value"].alias("v"))))
    named = F.array_join(F.transform(F.slice(by_size, 1, 3), lambda c: F.format_string("%s %.2f", c["n"], c["v"])), ", ")
    wells = F.array_join(F.slice(F.array_sort(col(evidence_wells)), 1, 3), ", ")
    records = F.when(
        col(evidence_count) > 0, F.concat(F.lit("earlier records near this depth: "), col(evidence_count).cast("string"), F.lit(" ("), wells, F.lit(")"))
    ).otherwise("no earlier record near this depth in similar wells")
    reading = F.when(col(mode) == "hybrid_indicator", "to be read as an order of concern: unusual telemetry and earlier cases, without a fitted chance of an event")
    strongest = F.when(F.size(signs) > 0, F.concat(F.lit("strongest signs: "), named))
    return F.concat(col(level), F.lit(" at "), F.concat_ws("; ", place, strongest, records, reading), F.lit("."))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def round_half_even(x) -> Column:
    return F.bround(col(x), 0)
