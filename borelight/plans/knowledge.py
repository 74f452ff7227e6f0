"""Events, records and passages from report pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borelight.functions import text as X
from borelight.functions.vectors import check_dimension
from borelight.operators.joins import new_rows_only
from borelight.operators.materialise import materialised
from borelight.operators.skew import broadcast_if_small, spread
from borelight.operators.windows import chunk_numbering
from borelight.params import (
    ACTION_TERMS,
    DEFAULTS,
    NEGATION_TERMS,
    OUTCOME_TERMS,
    PROBLEM_TERMS,
    ROUTINE_TERMS,
)
from borelight.sources.writers import write_table

METHOD = "nlp_document_extraction"
PAGE_TASKS = 4  # a core, over pages of few row groups


@dataclass(frozen=True)
class Lexicon:
    """Word lists the extraction works with."""

    problems: dict = None
    actions: tuple = ACTION_TERMS
    outcomes: dict = None
    negations: tuple = NEGATION_TERMS
    routines: tuple = ROUTINE_TERMS

    def __post_init__(self):
        object.__setattr__(self, "problems", self.problems or PROBLEM_TERMS)
        object.__setattr__(self, "outcomes", self.outcomes or OUTCOME_TERMS)


LEXICON = Lexicon()


@dataclass
class Knowledge:
    records: DataFrame
    events: DataFrame
    excluded: DataFrame


def _readable(pages: DataFrame) -> DataFrame:
    pages = spread(pages, "document_id", "page_number", per_core=PAGE_TASKS)
    return pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def sentence_rows(pages: DataFrame) -> DataFrame:
    """One row per sentence with the lower-cased text of it and the next one."""
    return _lowered_sentences(pages).drop("_low")


def _lowered_sentences(pages: DataFrame) -> DataFrame:
    """`sentence_rows` with each sentence in lower case (`_low`), which the rows are made with: a filter on it does not lower it anew for every term."""
    keep = [c for c in pages.columns if c != "text"]
    arrays = pages.select(*keep, X.split_sentences("text").alias("_s"))
    pairs = F.transform(
        "_s", lambda s, i: F.struct(s.alias("sentence"), F.lower(s).alias("low"), F.concat_ws(" ", F.slice("_s", i + 1, F.lit(2))).alias("window"))
    )
    rows = arrays.select(*keep, F.posexplode(pairs).alias("sentence_no", "_p"))
    return rows.select(
        *keep, "sentence_no", F.col("_p.sentence").alias("sentence"), F.lower("_p.window").alias("window"), F.col("_p.low").alias("_low")
    )


def _occurrences(text: Column, term: Column) -> Column:
    """1-based positions of all occurrences of `term` (a column) in `text`."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
    return F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + F.length(term)).alias("at"),
            F.concat(acc["all"], F.array((acc["at"] + F.length(p)).cast("int"))).alias("all"),
        ),
    )["all"]


def mentions(pages: DataFrame, lexicon: Lexicon = LEXICON, every_occurrence: bool = True) -> DataFrame:
    """Sentences naming a problem, with the reason when the mention does not count.

    A mention counts when at least one occurrence of its term is neither denied nor part of a routine
    phrase; with `every_occurrence` off only the first occurrence is looked at.
    """
    rows = _lowered_sentences(_readable(pages))
    rows = rows.withColumn("_term", X.problem_term("_low", lexicon.problems)).where(F.col("_term").isNotNull())
    rows = rows.withColumn("_at", _occurrences(F.col("_low"), F.col("_term.term")))
    if not every_occurrence:
        rows = rows.withColumn("_at", F.slice("_at", 1, 1))

    def reason(at):
        denied = X.is_negated(F.substring(F.col("_low"), F.lit(1), at - 1), lexicon.negations)
        routine = X.routine_span("_low", at, F.length("_term.term"), lexicon.routines)
        return F.when(denied, F.lit("denied_by_report")).otherwise(F.concat(F.lit("routine:"), routine))

    rows = rows.withColumn("_why", F.transform("_at", reason))
    counts = F.exists("_why", lambda r: r.isNull())
    return rows.withColumn("reason", F.when(~counts, F.col("_why")[0])).withColumn("category", F.col("_term.category")).drop(
        "_why", "_at", "_low", "_term"
    )


def extract_events(found: DataFrame, lexicon: Lexicon = LEXICON, whole_words: bool = True) -> DataFrame:
    """Events from counted mentions: depth, actions, outcome and confidence."""
    e = found.where(F.col("reason").isNull())
    e = e.withColumn("actions", X.actions_in("window", lexicon.actions, whole_words)).withColumn(
        "_out", X.outcome_in("window", lexicon.outcomes, whole_words)
    )
    conf = X.event_confidence("confidence", F.size("actions") > 0, F.col("_out").isNotNull())
    keep = [c for c in found.columns if c not in ("confidence", "window", "reason", "category", "sentence")]
    return e.select(
        *keep,
        F.col("category").alias("event_type"),
        "category",
        F.col("sentence").alias("description"),
        F.col("sentence").alias("raw_text"),
        X.first_depth("sentence").alias("depth_m"),
        "actions",
        F.col("_out.outcome").alias("outcome"),
        F.col("_out.status").alias("outcome_status"),
        conf.alias("confidence"),
    )


def formation_records(pages: DataFrame) -> DataFrame:
    keep = [c for c in pages.columns if c not in ("text", "confidence")]
    rows = _readable(pages).select(
        *keep, F.posexplode(X.find_formation_intervals("text", "confidence")).alias("record_no", "_r")
    )
    return rows.select(*keep, "record_no", "_r.*")


def measurement_records(pages: DataFrame) -> DataFrame:
    keep = [c for c in pages.columns if c not in ("text", "confidence")]
    rows = _readable(pages).select(
        *keep, F.posexplode(X.find_measurements("text", "confidence")).alias("record_no", "_r")
    )
    return rows.select(*keep, "record_no", "_r.*")


def extract_knowledge(pages: DataFrame, lexicon: Lexicon = LEXICON, whole_words: bool = True) -> Knowledge:
    """All extractors over page text. `pages`: document_id, page_number, text, confidence."""
    p = pages.select("document_id", "page_number", "text", "confidence")
    found = mentions(p, lexicon)
    f = formation_records(p).select(
        "document_id", "page_number", F.lit("formation_interval").alias("record_type"), "source_text", "confidence",
        "formation_name", "depth_top_m", "depth_base_m",
    )
    m = measurement_records(p).select(
        "document_id", "page_number", "record_type", "source_text", "confidence", "size_inches_text", "component",
        "value", "unit",
    )
    excluded = found.where(F.col("reason").isNotNull()).select(
        "document_id", "page_number", "sentence_no", "sentence", "category", "reason"
    )
    return Knowledge(
        f.unionByName(m, allowMissingColumns=True), extract_events(found, lexicon, whole_words), excluded
    )


def passage_rows(pages: DataFrame, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Overlapping passages of every page, whole text covered."""
    keep = [c for c in pages.columns if c not in ("text", "confidence")]
    rows = pages.select(*keep, F.posexplode(X.chunk_text("text", size, overlap)).alias("piece", "_c"))
    return rows.select(*keep, "piece", F.col("_c.text").alias("text"))


@dataclass
class Ingested:
    chunks: DataFrame
    events: DataFrame
    mitigations: DataFrame
    intervals: DataFrame
    documents: DataFrame


def _event_rows(events: DataFrame, titles: DataFrame) -> DataFrame:
    cite = F.concat("title", F.lit(" p."), F.col("page_number").cast("string"))
    return events.join(broadcast_if_small(titles), "document_id").select(
        "document_id", "raw_text", "event_type",
        F.xxhash64("document_id", "raw_text", "event_type").alias("event_id"),
        "well_id", "category", F.col("depth_m").alias("depth_start_m"), F.col("depth_m").alias("depth_end_m"),
        F.when(F.col("depth_m").isNotNull(), "document_text").alias("depth_source"),
        "description", F.col("confidence").alias("extraction_confidence"), F.lit(METHOD).alias("extraction_method"),
        cite.alias("provenance"), F.array_join("actions", "; ").alias("action_taken"), "outcome", "outcome_status",
    )


def _split_mitigations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    acts = rows.where(F.length("action_taken") > 0).select(
        "event_id", "action_taken", "outcome", "outcome_status", "raw_text", "extraction_confidence", "provenance"
    )
    return rows.drop("action_taken", "outcome", "outcome_status"), acts


def ingest_documents(
    pages: DataFrame, documents: DataFrame, chunks: DataFrame, events: DataFrame, intervals: DataFrame,
    lexicon: Lexicon = LEXICON, min_confidence: float = DEFAULTS.min_confidence,
) -> Ingested:
    """New rows for every table from newly read pages; nothing already stored is stored again.

    `pages`: document_id, page_number, text, method, confidence. `documents`: document_id, title,
    well_id. A document grows past its deepest stored page; earlier pages are passed over.
    """
    stored = chunks.groupBy("document_id").agg(
        F.max("page_number").alias("_deepest"), F.max("chunk_index").alias("max_index")
    )
    fresh = spread(pages, "document_id", "page_number", per_core=PAGE_TASKS).join(
        broadcast_if_small(stored.select("document_id", "_deepest")), "document_id", "left"
    ).where(F.col("page_number") > F.coalesce("_deepest", F.lit(0))).drop("_deepest")
    new_chunks = chunk_numbering(
        passage_rows(fresh.select("document_id", "page_number", "text")), stored.select("document_id", "max_index")
    ).select("document_id", "chunk_index", "page_number", "text")
    found = extract_knowledge(fresh, lexicon)
    titles = documents.select("document_id", "title", "well_id")
    sure = found.events.where(F.col("confidence") >= min_confidence)
    # the pages are gone through once; events and mitigations are two views of the rows written
    rows = materialised(new_rows_only(_event_rows(sure, titles), events, ["document_id", "raw_text", "event_type"]))
    new_events, new_acts = _split_mitigations(rows)
    f = found.records.where((F.col("record_type") == "formation_interval") & (F.col("confidence") >= min_confidence))
    f = f.join(broadcast_if_small(titles), "document_id").select(
        "well_id", "formation_name", "depth_top_m", "depth_base_m", F.lit(None).cast("string").alias("group_name"),
        F.concat("title", F.lit(" p."), F.col("page_number").cast("string"), F.lit(" (confidence "),
                 F.col("confidence").cast("string"), F.lit(")")).alias("provenance"),
    )
    new_intervals = new_rows_only(f, intervals, ["well_id", "formation_name", "depth_top_m"])
    totals = fresh.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("new_pages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("new_characters"),
        F.max(F.col("method") != "pdf_text_layer").alias("ocr_applied"),
    )
    return Ingested(new_chunks, new_events, new_acts, new_intervals, totals)


TABLES = {
    "chunks": "document_id long, chunk_index int, page_number int",
    "events": "document_id long, raw_text string, event_type string",
    "mitigations": "event_id long",
    "intervals": "well_id long, formation_name string, depth_top_m double",
}


def ingest_batch(
    folder: str, batch_id: int, pages: DataFrame, documents: DataFrame, lexicon: Lexicon = LEXICON,
    min_confidence: float = DEFAULTS.min_confidence,
) -> None:
    """One batch of pages into the tables under `folder` (chunks, events, mitigations, intervals), each partitioned by `batch_id`.

    What earlier batches stored is not stored again, and a batch that is run once more replaces what it wrote, so it may be the body of
    `foreachBatch` with the batch's own number. Numbers must not fall from one new batch to the next.
    """
    spark = pages.sparkSession
    # later batches know what this one wrote, but it must not know itself
    stored = {name: read_batches(spark, folder, name).where(F.col("batch_id") < batch_id).drop("batch_id") for name in TABLES}
    pages = materialised(pages)
    got = ingest_documents(pages, documents, stored["chunks"], stored["events"], stored["intervals"], lexicon, min_confidence)
    for name in TABLES:
        rows = materialised(getattr(got, name).withColumn("batch_id", F.lit(batch_id).cast("long")))
        write_table(rows, f"{folder}/{name}", "replace_partitions", "batch_id")


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of `ingest_batch` with its `batch_id`; without rows if no batch has written it."""
    empty = spark.createDataFrame([], TABLES[name] + ", batch_id long")
    try:
        found = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException:  # not written yet
        return empty
    return found.withColumn("batch_id", F.col("batch_id").cast("long"))


def reextract(
    pages: DataFrame, documents: DataFrame, events: DataFrame, mitigations: DataFrame, lexicon: Lexicon = LEXICON,
    min_confidence: float = DEFAULTS.min_confidence,
) -> tuple[DataFrame, DataFrame]:
    """Event and mitigation tables with the extracted rows of these documents replaced.

    Events of other methods and other documents stay, and so do passages and their vectors.
    """
    docs = broadcast_if_small(pages.select("document_id").distinct())
    old = events.where(F.col("extraction_method") == METHOD).join(docs, "document_id", "left_semi")
    old_ids = old.select("event_id").distinct()
    kept = events.join(old_ids, "event_id", "left_anti")
    kept_acts = mitigations.join(old_ids, "event_id", "left_anti")
    sure = extract_knowledge(pages, lexicon).events.where(F.col("confidence") >= min_confidence)
    rows = _event_rows(sure, documents.select("document_id", "title", "well_id"))
    rows = materialised(new_rows_only(rows, kept, ["document_id", "raw_text", "event_type"]))
    new_events, new_acts = _split_mitigations(rows)
    return (
        kept.unionByName(new_events, allowMissingColumns=True),
        kept_acts.unionByName(new_acts, allowMissingColumns=True),
    )


def embed_passages(
    chunks: DataFrame, encoder, dims: int = DEFAULTS.text_dims, model: str = "", rebuild: bool = False,
) -> DataFrame:
    """Chunks with unit vectors from a caller's encoder (`encoder(list of texts) -> rows of numbers`).

    Only chunks without a vector are encoded unless `rebuild`. Without an encoder this is an error; no
    stand-in vectors are made.
    """
    if encoder is None:
        raise ValueError("an encoder is required to embed passages")
    keep = [c for c in chunks.columns if c not in ("embedding", "embedding_model")]
    has = "embedding" in chunks.columns and not rebuild
    done = chunks.where(F.col("embedding").isNotNull()) if has else None
    todo = chunks.where(F.col("embedding").isNull()) if has else chunks
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keep).schema.fields)

    def run(batches):
        import numpy as np

        for pdf in batches:
            vecs = np.asarray(encoder(pdf["text"].tolist()), dtype="float64").reshape(len(pdf), -1)
            length = np.sqrt((vecs**2).sum(axis=1, keepdims=True))
            vecs = np.divide(vecs, length, out=vecs.copy(), where=length > 0).astype("float32")
            yield pdf.assign(embedding=list(vecs))

    made = todo.select(*keep).mapInPandas(run, schema + ", embedding array<float>")
    made = made.withColumn("embedding", check_dimension("embedding", dims)).withColumn("embedding_model", F.lit(model))
    return made if done is None else done.unionByName(made, allowMissingColumns=True)
