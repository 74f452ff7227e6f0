"""Table and feature writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "replace", partition: str | None = None) -> None:
    """`replace` the table, `replace_partitions` present in `df` (e.g. one well), or `append`."""
    if mode == "replace_partitions":
        if not partition:
            raise ValueError("replace_partitions needs a partition column")
        # a large partition value is spread over several tasks by a hash of the row
        flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
        (
            df.repartition(F.col(partition), F.pmod(F.xxhash64(*flat), F.lit(16)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(path)
        )
        return
    modes = {"replace": "overwrite", "append": "append"}
    w = df.write.mode(modes[mode])
    (w.partitionBy(partition) if partition else w).parquet(path)


def narrow_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed column order with doubles as single precision."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[F.col(c).cast("float").alias(c) if isinstance(kinds[c], T.DoubleType) else F.col(c) for c in columns]
    )


def write_features(df: DataFrame, path: str, columns: list[str]) -> None:
    narrow_features(df, columns).write.mode("overwrite").parquet(path)
