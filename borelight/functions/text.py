"""Text extraction as column expressions over whole page texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from borelight.functions.scalars import col
from borelight.params import (
    ACTION_TERMS,
    DEFAULTS,
    NEGATION_TERMS,
    NEGATION_WINDOW_WORDS,
    OUTCOME_TERMS,
    PROBLEM_TERMS,
    ROUTINE_TERMS,
)

# Extraction patterns.
INTERVAL_PATTERN = (
    r"((?:[A-ZÅØÆ][A-Za-zÅØÆåøæ\-]{1,24}\s+){0,3}(?:FORMATION|Formation|GROUP|Group|Fm\.?|Gp\.?))"
    r"\s*[\(\[]?\s*(\d{1,5}(?:[.,]\d+)?)\s*(?:-|–|to)\s*(\d{1,5}(?:[.,]\d+)?)"
    r"\s*(m|meters|metres|ft|feet)\b"
)
DEPTH_PATTERN = (
    r"(?i)(?:at|@|depth of|from)?\s*(\d{2,5}(?:[.,]\d+)?)\s*(m|meters|metres|ft|feet)\s*(?:MD|KB|RKB|TVD|BRT)?\b"
)
SIZE_PATTERN = r"(?i)(\d{1,2}\s*(?:\d/\d)?)\s*(?:\"|''|inch|in\b)\s*(hole|casing|liner|bit)"
MUD_PATTERN = r"(?i)(?:mud\s*weight|MW)\s*(?:of|=|:)?\s*(\d\.\d{1,3})\s*(sg|s\.g\.|ppg|kg/m3)?"
SENTENCE_BREAK = r"(?<=[.;:\n])\s+"
MAX_DEPTH_M = 12000.0
FEET = 0.3048


def chunk_text(text, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Overlapping pieces as an array of (start, text); blank pieces are left out."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.length(t)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    )
    pieces = F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.substring(t, s + 1, F.lit(size)).alias("text"))
    )
    return F.filter(pieces, lambda p: F.length(F.regexp_replace(p["text"], r"\s+", "")) > 0)


def split_sentences(text) -> Column:
    parts = F.transform(F.split(col(text), SENTENCE_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > 0)


def number(raw) -> Column:
    """Comma before exactly three digits groups thousands; any other comma is a decimal mark."""
    r = col(raw)
    plain = F.when(r.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(r, F.lit(","), F.lit(""))).otherwise(
        F.replace(r, F.lit(","), F.lit("."))
    )
    return plain.try_cast("double")


def to_metres(value, unit) -> Column:
    return F.when(F.lower(col(unit)).rlike("^(ft|feet)"), col(value) * FEET).otherwise(col(value))


def _confidence(conf, factor: float) -> Column:
    return F.round(F.least(F.lit(1.0), F.coalesce(col(conf), F.lit(0.5)) * factor), 4)


def find_formation_intervals(text, confidence) -> Column:
    """Array of named depth intervals in metres; implausible and nameless ones are left out."""
    groups = [F.regexp_extract_all(col(text), F.lit(INTERVAL_PATTERN), F.lit(i)) for i in range(5)]
    rows = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("whole", "name", "top", "base", "unit"))])
    conf = _confidence(confidence, 0.95)
    shaped = F.transform(
        rows,
        lambda r: F.struct(
            F.trim(F.regexp_replace(r["name"], r"\s+", " ")).alias("formation_name"),
            F.round(to_metres(number(r["top"]), r["unit"]), 2).alias("depth_top_m"),
            F.round(to_metres(number(r["base"]), r["unit"]), 2).alias("depth_base_m"),
            r["unit"].alias("declared_unit"),
            F.trim(r["whole"]).alias("source_text"),
            conf.alias("confidence"),
        ),
    )
    bare = ["formation", "group", "fm", "gp"]
    return F.filter(
        shaped,
        lambda r: (r["depth_base_m"] > r["depth_top_m"])
        & (r["depth_base_m"] <= MAX_DEPTH_M)
        & ~F.rtrim(F.lower(r["formation_name"]), F.lit(".")).isin(bare),
    )


def find_measurements(text, confidence) -> Column:
    """Array of hole and casing sizes and mud weights."""
    conf = _confidence(confidence, 0.9)
    sizes = F.arrays_zip(
        *[
            F.regexp_extract_all(col(text), F.lit(SIZE_PATTERN), F.lit(i)).alias(n)
            for i, n in enumerate(("whole", "size", "kind"))
        ]
    )
    muds = F.arrays_zip(
        *[
            F.regexp_extract_all(col(text), F.lit(MUD_PATTERN), F.lit(i)).alias(n)
            for i, n in enumerate(("whole", "value", "unit"))
        ]
    )
    nothing = F.lit(None).cast("string")
    return F.concat(
        F.transform(
            sizes,
            lambda r: F.struct(
                F.lit("equipment_dimension").alias("record_type"),
                F.trim(F.regexp_replace(r["size"], r"\s+", " ")).alias("size_inches_text"),
                F.lower(r["kind"]).alias("component"),
                F.lit(None).cast("double").alias("value"),
                nothing.alias("unit"),
                F.trim(r["whole"]).alias("source_text"),
                conf.alias("confidence"),
            ),
        ),
        F.transform(
            muds,
            lambda r: F.struct(
                F.lit("mud_weight").alias("record_type"),
                nothing.alias("size_inches_text"),
                nothing.alias("component"),
                number(r["value"]).alias("value"),
                F.when(F.length(F.coalesce(r["unit"], F.lit(""))) > 0, F.lower(r["unit"])).otherwise("sg").alias("unit"),
                F.trim(r["whole"]).alias("source_text"),
                conf.alias("confidence"),
            ),
        ),
    )


def first_depth(sentence) -> Column:
    """First depth mentioned, in metres; NULL when that mention is not in (0, 12000]."""
    value = number(F.regexp_extract(col(sentence), DEPTH_PATTERN, 1))
    metres = to_metres(value, F.regexp_extract(col(sentence), DEPTH_PATTERN, 2))
    return F.when((metres > 0) & (metres <= MAX_DEPTH_M), F.round(metres, 2))


def _word_pattern(term: str) -> str:
    return rf"(?U)(?<!\w){re.escape(term)}(?!\w)"


def _named(text: Column, term: str, whole_words: bool) -> Column:
    """Term in the text; the plain search spares most texts the pattern."""
    there = F.contains(text, F.lit(term))
    return there & text.rlike(_word_pattern(term)) if whole_words else there


def positions_of(text, term: str) -> Column:
    """All 1-based start positions of a literal term."""
    t, n = col(text), len(term)
    pieces = F.split(t, rf"\Q{term}\E", -1)
    ends = F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + n).alias("at"),
            F.concat(acc["all"], F.array((acc["at"] + F.length(p)).cast("int"))).alias("all"),
        ),
    )
    return F.when(F.contains(t, F.lit(term)), ends["all"]).otherwise(F.array().cast("array<int>"))


def problem_term(lowered, lexicon: dict[str, str] = PROBLEM_TERMS) -> Column:
    """Struct (term, category) of the longest lexicon entry in the text; the earlier one on ties."""
    ranked = sorted(lexicon.items(), key=lambda kv: -len(kv[0]))
    out = None
    for term, category in ranked:
        value = F.struct(F.lit(term).alias("term"), F.lit(category).alias("category"))
        hit = F.contains(col(lowered), F.lit(term))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_negated(prefix, cues=NEGATION_TERMS, window: int = NEGATION_WINDOW_WORDS) -> Column:
    """A denial cue within a few words before the end of `prefix`."""
    alt = "|".join(re.escape(c).replace(r"\ ", " ") for c in sorted(cues, key=len, reverse=True))
    return col(prefix).rlike(rf"(?iU)\b(?:{alt})\b(?:\W+\w+){{0,{window}}}\W*$")


def routine_span(sentence, start, length, phrases=ROUTINE_TERMS) -> Column:
    """First routine phrase one of whose occurrences overlaps [start, start+length); else NULL."""
    s, end = col(start), col(start) + col(length)

    def overlaps(phrase):
        return F.exists(positions_of(sentence, phrase), lambda at: (at < end) & (s < at + len(phrase)))

    return F.coalesce(*[F.when(overlaps(p), F.lit(p)) for p in phrases])


def actions_in(window, verbs=ACTION_TERMS, whole_words: bool = True) -> Column:
    """Sorted distinct action verbs named in the text."""
    w = col(window)

    def seen(v):
        return _named(w, v, whole_words)

    return F.filter(
        F.array(*[F.when(seen(v), F.lit(v)) for v in sorted(set(verbs))]), lambda x: x.isNotNull()
    )


def outcome_in(window, outcomes: dict[str, str] = OUTCOME_TERMS, whole_words: bool = True) -> Column:
    """Struct (outcome, status) of the first listed outcome word in the text; NULL if none."""
    w, out = col(window), None
    for word, status in outcomes.items():
        hit = _named(w, word, whole_words)
        value = F.struct(F.lit(word).alias("outcome"), F.lit(status).alias("status"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def event_confidence(confidence, has_action, has_outcome) -> Column:
    base = F.coalesce(col(confidence), F.lit(0.5)) * 0.6
    more = F.when(col(has_action), 0.15).otherwise(0.0) + F.when(col(has_outcome), 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + more), 4)
