"""Judge URLs by host and path rules, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and what follows each of its dots, as far as rules of at most `labels` labels need."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))


def path_prefixes(path: Column, depth: int) -> Column:
    """The empty prefix and the path up to each of its first `depth` slashes, slash included."""
    parts = F.split(path, "/")
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit("")), F.transform(ends, lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


def digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule (host and path together) and verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's. Every url is
    expanded into host suffixes times path prefixes that end in a slash; rules are filed under their own path up to its last
    slash. Both sides meet on 8 hex digits of SHA-256, then the full digest and the rest of the rule's path are confirmed. The
    longest rule wins; equally long ones by longer host, then block before allow, then by text. No rule: `default`. Expansion
    stops at the labels and slashes that the longest rule has, beyond which nothing could fit.

    Null urls and urls without `://` have an empty host and path, which only a rule for the empty host fits. Rules with a null
    host or verdict never fit; a null path is empty. Equal urls are judged once in each of 16 salted shares, so a url or host
    that holds a third of the rows stays spread. Columns of `df` named host, path, rule or verdict are replaced.
    """
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(url)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if c in kept and not t.startswith("map")]), F.lit(SALTS))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), host.alias("host"), path.alias("path"), salt.alias("_salt"))
    rules = rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")).where("host is not null and verdict is not null").distinct()
    deepest = rules.agg(
        F.max(F.size(F.split("host", "\\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("depth")
    ).first()
    base = F.regexp_extract("path", "^(?s)(.*/)?", 0)
    filed = rules.select(
        F.struct(
            (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"),
            F.concat("host", "path").alias("rule"), "verdict",
        ).alias("_rule"),
        F.col("path").alias("_rule_path"), digest(F.col("host"), base).alias("_full"),
    ).withColumn("_short", F.substring("_full", 1, 8))
    salted = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    places = rows.select("host", "path", "_salt").distinct()
    spread = places.withColumn("_h", F.explode(host_suffixes(F.col("host"), deepest["labels"] or 1)))
    spread = spread.withColumn("_p", F.explode(path_prefixes(F.col("path"), deepest["depth"] or 0)))
    spread = spread.withColumn("_digest", digest(F.col("_h"), F.col("_p"))).withColumn("_short", F.substring("_digest", 1, 8))
    hits = spread.join(salted, ["_salt", "_short"]).where((F.col("_digest") == F.col("_full")) & F.col("path").startswith(F.col("_rule_path")))
    best = hits.groupBy("host", "path", "_salt").agg(F.max("_rule").alias("_best"))
    return rows.join(best, ["host", "path", "_salt"], "left").select(
        "_row.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
