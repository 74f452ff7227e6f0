"""From raw documents to token files: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelight.llm import decontaminate, mixing, near, tokens, toxicity
from borelight.llm.queries import byte_bpe, table
from borelight.operators.materialise import checkpoint_folder

ORACLE_SQL = None  # learned classifiers, signatures and coded files have no SQL form; tests compare with plain versions

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000  # whole texts that a task hands to Python at once: batches lie in the memory of the JVM and of the worker
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20  # of a batch, about: the JVM holds it several times over (vectors, their larger copies, what goes to the socket)


def in_batches(stage):
    """`stage` with Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES, also when what it returns is written later."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(BATCH))
        if rows <= 0 or rows > BATCH_ROWS:
            spark.conf.set(BATCH, BATCH_ROWS)
        spark.conf.set(BYTES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on `labels`, does not reject."""
    return toxicity.accepted(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), toxicity.categories()))


@in_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 or more alike."""
    return near.deduplicated(docs, size=5, percent=80)


@in_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@in_batches
def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which the sources interleave at their target weights (rows to the power 0.7)."""
    return mixing.mix(docs).orderBy("mix_position").select(*docs.columns)


@in_batches
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the order of the files just written (that of the mix), as rANS blocks, read back."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        docs = docs.select("doc_id", "text", (part * (1 << 40) + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:  # not read from files: by id
        docs = docs.select("doc_id", "text", F.col("doc_id").alias("place"))
    return tokens.encoded(docs, byte_bpe(), "place")


STAGES = [
    ("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("benchmark decontamination", drop_benchmark),
    ("mixing sources", interleave), ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
