"""Registry and the roles the test tables play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def add(fn):
        name = fn.__name__.removeprefix("q_")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    df = s.read.parquet(f"{d}/{name}.parquet")
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    )


# depth-indexed logs: one supplier is a well, the price is the depth
CURVES = ["qty", "disc", "tax"]
TIES = ["ok", "ln"]
LOGS = (
    "logs AS (SELECT l_suppkey AS well, l_extendedprice AS depth, l_orderkey AS ok, l_linenumber AS ln, "
    "NULLIF(l_quantity, 1) AS qty, l_discount AS disc, l_tax AS tax, NULLIF(l_returnflag, 'N') AS group_name, "
    "NULLIF(l_linestatus, 'O') AS formation_name FROM lineitem)"
)


def logs(s, d) -> DataFrame:
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("well"), F.col("l_extendedprice").alias("depth"), F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"), F.nullif("l_quantity", F.lit(1.0)).alias("qty"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("group_name"),
        F.nullif("l_linestatus", F.lit("O")).alias("formation_name"),
    )


# telemetry: one user is a well; value is a flow, k a rotation and a depth
TELE = (
    "tele AS (SELECT user_id AS well_name, ts AS \"timestamp\", event_id, event_type, value AS flow_in_lpm, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS bit_rpm, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 10 AS bit_depth_m FROM events)"
)


def tele(s, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(s, d, "events").select(
        F.col("user_id").alias("well_name"), F.col("ts").alias("timestamp"), "event_id", "event_type",
        F.col("value").alias("flow_in_lpm"), k.alias("bit_rpm"), (k * 10).alias("bit_depth_m"),
    )


# wells with derived positions
PLACES = (
    "places AS (SELECT s_suppkey AS well_id, s_name AS well_name, 56 + (s_suppkey % 80) / 20.0 AS latitude, "
    "CASE WHEN s_suppkey % 11 <> 3 THEN 1 + (s_suppkey % 60) / 20.0 END AS longitude FROM supplier)"
)


def places(s, d) -> DataFrame:
    key = F.col("s_suppkey")
    return table(s, d, "supplier").select(
        key.alias("well_id"), F.col("s_name").alias("well_name"), (56 + key % 80 / 20.0).alias("latitude"),
        F.when(key % 11 != 3, 1 + key % 60 / 20.0).alias("longitude"),
    )


# intervals: parts
INTERVALS = (
    "intervals AS (SELECT CAST(p_partkey % 100 AS BIGINT) AS well_id, p_type AS group_name, p_brand AS formation_name, "
    "CAST((p_partkey // 100) % 20 * 50 AS DOUBLE) AS depth_top_m, "
    "CAST((p_partkey // 100) % 20 * 50 + p_size AS DOUBLE) AS depth_base_m FROM part)"
)


def intervals(s, d) -> DataFrame:
    k = F.col("p_partkey")
    top = F.floor(k / 100) % 20 * 50
    return table(s, d, "part").select(
        (k % 100).alias("well_id"), F.col("p_type").alias("group_name"), F.col("p_brand").alias("formation_name"),
        top.cast("double").alias("depth_top_m"), (top + F.col("p_size")).cast("double").alias("depth_base_m"),
    )


# segments: embeddings spread over a hundred wells
SEGMENTS = (
    "segs AS (SELECT CAST(label * 10 + vec_id % 10 AS BIGINT) AS well_id, vec_id AS segment_id, "
    "CAST(vec_id * 2 AS DOUBLE) AS segment_top_m, CAST(vec_id * 2 + 100 AS DOUBLE) AS segment_base_m, "
    "'G' || (vec_id % 3) AS dominant_group, 'F' || (vec_id % 7) AS dominant_formation, embedding FROM embeddings)"
)


def segments(s, d) -> DataFrame:
    v = F.col("vec_id")
    return table(s, d, "embeddings").select(
        (F.col("label") * 10 + v % 10).cast("long").alias("well_id"), v.alias("segment_id"),
        (v * 2).cast("double").alias("segment_top_m"), (v * 2 + 100).cast("double").alias("segment_base_m"),
        F.concat(F.lit("G"), (v % 3).cast("string")).alias("dominant_group"),
        F.concat(F.lit("F"), (v % 7).cast("string")).alias("dominant_formation"), "embedding",
    )


# the wells the segments belong to
FIELD = (
    SEGMENTS + ", field AS (SELECT well_id, 'W' || well_id AS well_name, "
    "CASE WHEN well_id % 9 <> 4 THEN 56 + (well_id % 80) / 20.0 END AS latitude, 1 + (well_id % 60) / 20.0 AS longitude, "
    "max(segment_base_m) AS total_depth_m FROM segs GROUP BY well_id)"
)


def field(s, d) -> DataFrame:
    w = F.col("well_id")
    return segments(s, d).groupBy("well_id").agg(F.max("segment_base_m").alias("total_depth_m")).select(
        "well_id", F.concat(F.lit("W"), w.cast("string")).alias("well_name"),
        F.when(w % 9 != 4, 56 + w % 80 / 20.0).alias("latitude"), (1 + w % 60 / 20.0).alias("longitude"), "total_depth_m",
    )


# depth queries
ASKED = (
    "asked AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey * 4 % 100 AS BIGINT) AS well_id, "
    "CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey * 37.0 END AS depth_m FROM nation)"
)


def asked(s, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(s, d, "nation").select(
        n.cast("long").alias("query_id"), (n * 4 % 100).cast("long").alias("well_id"),
        F.when(n % 7 != 3, n * 37.0).alias("depth_m"),
    )


# historical events: orders
HISTORY = (
    "history AS (SELECT o_orderkey AS event_id, CAST(o_custkey % 100 AS BIGINT) AS well_id, "
    "NULLIF(o_orderpriority, '5-LOW') AS category, CAST(o_orderkey % 997 AS DOUBLE) AS depth_start_m FROM orders)"
)


def history(s, d) -> DataFrame:
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 100).alias("well_id"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category"),
        (F.col("o_orderkey") % 997).cast("double").alias("depth_start_m"),
    )


def us(c: str):
    return F.unix_micros(c)


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
