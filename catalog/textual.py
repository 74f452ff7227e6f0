"""Text extraction and knowledge queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.functions import text as X
from borelight.operators import windows as W
from borelight.plans import knowledge as K
from catalog.base import query, table

LEXICON = K.Lexicon(
    problems={"the": "well_control", "that the": "stuck_pipe", "of the": "tight_hole", "and the": "overpull", "ring": "fishing", "tion": "losses", "with": "pack_off"},
    actions=("for", "is", "was", "this", "are"),
    outcomes={"from": "resolved", "on": "not_resolved", "it": "resolved"},
    negations=("in", "as", "to"),
    routines=("of the", "is tion"),
)


def _pages(s, d):
    doc = F.col("doc_id")
    return table(s, d, "documents").select(
        doc.alias("document_id"), F.lit(1).alias("page_number"), "text", F.when(doc % 4 != 0, doc % 10 / 10.0).alias("confidence")
    )


@query(
    "WITH p AS (SELECT doc_id, text, length(text) AS n FROM documents), c AS (SELECT doc_id, unnest(CASE WHEN n <= 1200 THEN [0] ELSE range(0, n, 1050) END) AS st, text FROM p), k AS (SELECT doc_id, "
    "CAST(st AS INT) AS start, substr(text, st + 1, 1200) AS piece FROM c) SELECT doc_id, start, length(piece)::INT AS n, md5(piece) AS hash FROM k WHERE regexp_replace(piece, '\\s+', '', 'g') <> ''"
)
def q_chunk_text(s, d):
    c = table(s, d, "documents").select("doc_id", F.explode(X.chunk_text("text")).alias("c"))
    return c.select("doc_id", F.col("c.start").alias("start"), F.length("c.text").alias("n"), F.md5(F.encode("c.text", "UTF-8")).alias("hash"))


SENTENCES = (
    "cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.;:\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 10 / 10.0::DOUBLE END AS conf FROM documents), "
    "tr AS (SELECT doc_id, conf, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in a if length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 0] AS a FROM cut), "
    "st AS (SELECT doc_id, conf, unnest(range(0, len(a))) AS i, a FROM tr), "
    "sent AS (SELECT doc_id, conf, i, a[i + 1] AS s, lower(a[i + 1]) AS low, lower(a[i + 1] || CASE WHEN i + 2 <= len(a) THEN ' ' || a[i + 2] ELSE '' END) AS win FROM st)"
)


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INT) AS sentence_no, md5(s) AS hash FROM sent")
def q_split_sentences(s, d):
    rows = K.sentence_rows(_pages(s, d).select("document_id", "text"))
    return rows.select(F.col("document_id").alias("doc_id"), "sentence_no", F.md5(F.encode("sentence", "UTF-8")).alias("hash"))


TERMS = sorted(LEXICON.problems.items(), key=lambda kv: -len(kv[0]))
TERM_SQL = "CASE " + " ".join(f"WHEN contains(low, '{t}') THEN '{t}'" for t, _ in TERMS) + " END"
CATEGORY_SQL = "CASE term " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in TERMS) + " END"
W_ = "[^\\pL\\pN_]"
@query()
def q_mentions(s, d):
    """Reason per mention; checked against brute force in the tests."""
    m = K.mentions(_pages(s, d), LEXICON)
    return m.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("sentence_no").alias("numbers"))


@query(
    f"WITH {SENTENCES}, tm AS (SELECT *, {TERM_SQL} AS term FROM sent) SELECT doc_id, CAST(i AS INT) AS sentence_no, term, {CATEGORY_SQL} AS category FROM tm WHERE term IS NOT NULL"
)
def q_problem_term(s, d):
    rows = K.sentence_rows(_pages(s, d).select("document_id", "text")).withColumn("t", X.problem_term(F.lower("sentence"), LEXICON.problems))
    return rows.where(F.col("t").isNotNull()).select(F.col("document_id").alias("doc_id"), "sentence_no", "t.term", "t.category")


def _words(terms, col="win"):
    return [f"CASE WHEN regexp_matches({col}, '(^|{W_}){t}($|{W_})') THEN '{t}' END" for t in terms]


ACTION_SQL = "concat_ws(',', " + ", ".join(_words(sorted(LEXICON.actions))) + ")"
OUTCOME_SQL = "coalesce(" + ", ".join(_words(LEXICON.outcomes)) + ")"


@query(
    f"WITH {SENTENCES}, x AS (SELECT doc_id, CAST(i AS INT) AS sentence_no, conf, {ACTION_SQL} AS actions, {OUTCOME_SQL} AS outcome FROM sent) SELECT doc_id, sentence_no, actions, outcome, "
    "round(least(1, coalesce(conf, 0.5) * 0.6 + CASE WHEN actions <> '' THEN 0.15 ELSE 0 END + CASE WHEN outcome IS NOT NULL THEN 0.15 ELSE 0 END), 4) AS confidence FROM x"
)
def q_actions_and_outcomes(s, d):
    rows = K.sentence_rows(_pages(s, d)).withColumn("a", X.actions_in("window", LEXICON.actions)).withColumn("o", X.outcome_in("window", LEXICON.outcomes))
    return rows.select(
        F.col("document_id").alias("doc_id"), "sentence_no", F.array_join("a", ",").alias("actions"), F.col("o.outcome").alias("outcome"),
        X.event_confidence("confidence", F.size("a") > 0, F.col("o").isNotNull()).alias("confidence"),
    )


CUES = "no|not|von|de"


@query(
    f"WITH {SENTENCES} SELECT doc_id, CAST(i AS INT) AS sentence_no, regexp_matches(low, '(^|{W_})({CUES})({W_}+[\\pL\\pN_]+){{0,3}}{W_}*$') AS negated FROM sent"
)
def q_is_negated(s, d):
    rows = K.sentence_rows(_pages(s, d).select("document_id", "text"))
    return rows.select(F.col("document_id").alias("doc_id"), "sentence_no", X.is_negated(F.lower("sentence"), tuple(CUES.split("|"))).alias("negated"))


DEPTHS = "(?i)(?:at|@|depth of|from)?\\s*(\\d{2,5}(?:[.,]\\d+)?)\\s*(m|meters|metres|ft|feet)\\s*(?:MD|KB|RKB|TVD|BRT)?\\b"


@query(
    "WITH e AS (SELECT event_id, 'at ' || CASE WHEN event_id % 5 = 0 THEN replace(CAST(value AS VARCHAR), '.', ',') ELSE CAST(event_id AS VARCHAR) END || CASE WHEN event_id % 3 = 0 THEN ' ft' ELSE ' m' END || ' KB' AS t FROM "
    f"events), m AS (SELECT event_id, regexp_extract(t, '{DEPTHS}', 1) AS v, regexp_extract(t, '{DEPTHS}', 2) AS u FROM e), n AS (SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(v, "
    "'\\d{1,3}(,\\d{3})+') THEN replace(v, ',', '') ELSE replace(v, ',', '.') END AS DOUBLE) * CASE WHEN u = 'ft' THEN 0.3048::DOUBLE ELSE 1.0::DOUBLE END AS z FROM m) SELECT event_id, round(CASE WHEN z > 0 AND z <= "
    "12000 THEN z END, 2) AS depth_m FROM n"
)
def q_first_depth(s, d):
    k = F.col("event_id")
    v = F.when(k % 5 == 0, F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).otherwise(k.cast("string"))
    t = F.concat(F.lit("at "), v, F.when(k % 3 == 0, " ft").otherwise(" m"), F.lit(" KB"))
    return table(s, d, "events").select("event_id", X.first_depth(t).alias("depth_m"))


@query(
    "WITH t AS (SELECT p_partkey, p_partkey % 4000 AS top, p_partkey % 4000 + p_size - 10 AS base, p_partkey % 5 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'Utsira Formation' WHEN 1 THEN 'HORDALAND GROUP' WHEN 2 THEN "
    "'Heimdal Fm.' WHEN 3 THEN 'Rogaland Gp' END AS formation_name, round(top * CASE WHEN k = 1 THEN 0.3048::DOUBLE ELSE 1 END, 2) AS depth_top_m, round(base * CASE WHEN k = 1 THEN 0.3048::DOUBLE ELSE 1 END, 2) AS depth_base_m, "
    "CASE WHEN k = 1 THEN 'ft' ELSE 'm' END AS declared_unit, 0.475::DOUBLE AS confidence FROM t WHERE k < 4 AND base > top"
)
def q_find_formation_intervals(s, d):
    k = F.col("p_partkey") % 5
    top = F.col("p_partkey") % 4000
    name = (
        F.when(k == 0, "Drilled the Utsira Formation").when(k == 1, "HORDALAND GROUP").when(k == 2, "in Heimdal Fm.").when(k == 3, "seen Rogaland  Gp").otherwise("some formation")
    )
    text = F.concat(
        name, F.lit(" ("), top.cast("string"), F.lit(" - "), (top + F.col("p_size") - 10).cast("string"), F.when(k == 1, " ft").otherwise(" m"), F.lit(" KB)")
    )
    rows = table(s, d, "part").select("p_partkey", F.explode(X.find_formation_intervals(text, F.lit(None).cast("double"))).alias("r"))
    return rows.select("p_partkey", "r.formation_name", "r.depth_top_m", "r.depth_base_m", "r.declared_unit", "r.confidence")


@query(
    "SELECT p_partkey, unnest(['equipment_dimension', 'mud_weight']) AS record_type, unnest([p_size || ' 1/4', NULL]) AS size, unnest(['casing', NULL]) AS component, unnest([NULL, round(1 + p_size / 100, 2)::DOUBLE]) AS value, "
    "unnest([NULL, CASE WHEN p_partkey % 2 = 0 THEN 'ppg' ELSE 'sg' END]) AS unit FROM part"
)
def q_find_measurements(s, d):
    text = F.concat(
        F.lit("Ran "), F.col("p_size").cast("string"), F.lit(" 1/4\" casing. Mud weight "), F.format_string("%.2f", 1 + F.col("p_size") / 100),
        F.when(F.col("p_partkey") % 2 == 0, " ppg").otherwise(" heavy"),
    )
    rows = table(s, d, "part").select("p_partkey", F.explode(X.find_measurements(text, F.lit(0.9))).alias("r"))
    return rows.select("p_partkey", "r.record_type", F.col("r.size_inches_text").alias("size"), "r.component", "r.value", "r.unit")


@query(
    "WITH c AS (SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS i FROM documents), m AS (SELECT s_suppkey, s_suppkey AS mx FROM supplier) SELECT source, doc_id AS "
    "page_number, i + 1 + CASE WHEN source = 'src3' THEN 0 WHEN source = 'src5' THEN 7 ELSE -1 END AS chunk_index FROM c"
)
def q_chunk_numbering(s, d):
    c = table(s, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.lit(0).alias("piece"))
    have = s.createDataFrame([("src3", 0), ("src5", 7)], "document_id string, max_index int")
    out = W.chunk_numbering(c, have)
    return out.select(F.col("document_id").alias("source"), "page_number", F.col("chunk_index").cast("long").alias("chunk_index"))


@query()
def q_extract_knowledge(s, d):
    """Events with actions, outcome and confidence; checked against brute force in the tests."""
    e = K.extract_knowledge(_pages(s, d), LEXICON).events
    return e.select(
        "document_id", "page_number", "sentence_no", "event_type", F.array_join("actions", ",").alias("actions"), "outcome", "outcome_status", "confidence"
    )


@query()
def q_ingest_documents(s, d):
    """New passages, events and mitigations per document when a tenth of the documents is stored already."""
    pages = _pages(s, d).withColumn("method", F.lit("pdf_text_layer"))
    docs = pages.select("document_id", F.concat(F.lit("doc "), F.col("document_id").cast("string")).alias("title"), (F.col("document_id") % 100).alias("well_id"))
    stored = pages.where(F.col("document_id") % 10 == 0).select("document_id", "page_number", F.lit(0).alias("chunk_index"))
    none = s.createDataFrame([], "document_id long, raw_text string, event_type string")
    noiv = s.createDataFrame([], "well_id long, formation_name string, depth_top_m double")
    got = K.ingest_documents(pages, docs, stored, none, noiv, LEXICON, 0.3)
    a = got.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").cast("long").alias("last_chunk"))
    b = got.events.groupBy("document_id").agg(F.count(F.lit(1)).alias("events"))
    return a.join(b, "document_id", "left").fillna(0, ["events"])
