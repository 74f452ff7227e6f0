"""Write an intermediate result once where several later jobs read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="borelight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialised(df: DataFrame, **options: str) -> DataFrame:
    """`df` written to the checkpoint folder (with the writer's `options`) and read back: computed once, short lineage, known size."""
    path = f"{checkpoint_folder(df.sparkSession)}/borelight-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
