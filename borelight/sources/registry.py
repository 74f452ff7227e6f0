"""Append-only model registry on Parquet."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelight.operators.windows import latest_per_group

SCHEMA = (
    "name string, version string, task string, algorithm string, dataset string, dataset_rows long, "
    "trained_at timestamp, training_seconds double, status string, feature_columns array<string>, "
    "hyperparameters map<string,string>, metrics map<string,double>, limitations array<string>, artifact_path string"
)


def new_version() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def register(spark: SparkSession, path: str, record: dict) -> None:
    """Append one version."""
    spark.createDataFrame([record], SCHEMA).write.mode("append").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def latest(registry: DataFrame) -> DataFrame:
    """Newest version of every model."""
    cols = [c for c in registry.columns if not dict(registry.dtypes)[c].startswith("map")]
    order = [c for c in ("trained_at", "version") if c in registry.columns]
    newest = latest_per_group(registry.select(*cols), ["name"], order)
    if len(cols) == len(registry.columns):
        return newest
    return registry.join(newest.select("name", *order), ["name", *order], "left_semi")


def versions(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name).orderBy("trained_at", "version")


def list_models(registry: DataFrame) -> DataFrame:
    return registry.groupBy("name").agg(
        F.count(F.lit(1)).alias("versions"), F.max("trained_at").alias("last_trained_at")
    )
