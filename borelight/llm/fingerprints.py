"""SimHash fingerprints and a search within a Hamming radius, in built-in functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelight.llm.order import piece_of
from borelight.operators.materialise import materialised

BITS = 64
MAX_WEIGHT = 31


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def terms(text: Column) -> Column:
    """The pairs of neighbouring words of a text as structs (a, b); one word stands alone; no words: one empty pair."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    alone = F.array(F.struct(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("a"), F.lit("").alias("b")))
    pairs = F.arrays_zip(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(n - 1, F.lit(0))).alias("b")
    )
    return F.when(n > 1, pairs.cast("array<struct<a:string,b:string>>")).otherwise(alone)


def votes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and the 64-bit `fingerprint` of all texts with equal keys.

    Every term (pair of words) hashes to 64 bits and votes on each with its weight: how often it occurs, times its length up to
    31, since longer pairs are rarer. A bit is set where more than half of the weight votes for it. Two bits are counted in one
    long, 32 apart; a text would need 2**26 terms before the lower count could reach the upper one. No words: fingerprint 0.
    """
    mask = F.lit((1 << 32) + 1)
    rows = df.select(*keys, F.explode(terms(F.col(text))).alias("_t"))
    rows = rows.select(
        *keys,
        F.xxhash64("_t.a", "_t.b").alias("_h"),
        F.least(F.length("_t.a") + F.length("_t.b"), F.lit(MAX_WEIGHT)).cast("long").alias("_w"),
    )
    lanes = [F.sum(F.shiftright("_h", i).bitwiseAND(mask) * F.col("_w")).alias(f"_v{i}") for i in range(32)]
    counted = rows.groupBy(*keys).agg(F.sum("_w").alias("_all"), *lanes)
    half = F.col("_all")
    low = [F.when(F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > half, F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    high = [F.when(F.shiftrightunsigned(f"_v{i}", 32) * 2 > half, F.lit(signed(1 << (i + 32)))).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per distinct `keys` with the fingerprint of its text (null: empty). Keys must tell the rows apart."""
    return votes(df.select(*keys, F.coalesce(text, F.lit("")).alias("_text")), keys, "_text")


def block_tables(radius: int, blocks: int) -> list[int]:
    """Bit masks of the permuted tables: each keeps blocks - radius of the blocks, every choice once."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs (fingerprint, other) of the distinct fingerprints of both sides at most `radius` bits apart, each pair once.

    Fingerprints that differ in at most `radius` bits agree on at least blocks - radius of the blocks, so they meet in one of
    the tables, each of which is an equi join on the kept blocks (about 32 bits by default). The first table in which a pair
    meets reports it. Nulls match nothing. Equal fingerprints are one row on each side, however many documents have them.
    """
    masks = block_tables(radius, blocks or 2 * radius if radius else 1)

    def side(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])
        return one.select(name, F.explode(tables).alias(f"_{name}"))

    a, b = side(queries, "fingerprint"), side(stored, "other")
    apart = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(signed(m))) == 0, F.lit(t)) for t, m in enumerate(masks)])
    on = (
        (F.col("_fingerprint.t") == F.col("_other.t"))
        & (F.col("_fingerprint.k") == F.col("_other.k"))
        & (F.bit_count(apart) <= radius)
        & (first == F.col("_fingerprint.t"))
    )
    return a.join(b, on).select("fingerprint", "other")


def with_next(docs: DataFrame, piece_rows: int) -> DataFrame:
    """`docs` (doc_id, text) with `piece` and `rank`, numbers that tell rows apart, and `after`, the text of the next row.

    Rows go by ascending doc_id (null first, equal ids by text); after the last comes the first. Every piece of the id range is
    sorted by itself and gets a copy (`copied`) of the row that follows it, so that no task sees more than a piece.
    """
    piece, _ = piece_of(docs, "doc_id", piece_rows)
    docs = docs.withColumn("piece", piece)
    firsts = [(r["piece"], r["f"]["doc_id"]) for r in docs.groupBy("piece").agg(F.min(F.struct("doc_id")).alias("f")).collect()]
    firsts.sort()
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = [(p, i, firsts[k - 1][0]) for k, (p, i) in enumerate(firsts)]
    heads = spark.createDataFrame(rows, f"_piece int, _id {kind}, _to int")  # a row a piece
    border = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")))
    border = border.withColumn("_k", F.row_number().over(Window.partitionBy("piece").orderBy("text"))).where("_k = 1")
    both = docs.withColumn("copied", F.lit(False)).unionByName(
        border.select("doc_id", "text", F.col("_to").alias("piece"), F.lit(True).alias("copied"))
    )
    order = Window.partitionBy("piece").orderBy("copied", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("rank", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))


def document_fingerprints(docs: DataFrame, piece_rows: int = 20_000, radius: int = 3, every: int = 100) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and likenesses; a row per row of `docs`.

    The edited text replaces the last floor(n / 2) characters by the first as many (or all) of the next document. `n_near`
    tells for ids divisible by `every` how many other rows have a fingerprint at most `radius` bits away; it is null elsewhere.
    Null text: empty. Null ids come first. Equal ids go by text. Further columns are ignored. No rows: no rows.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), piece_rows)
    n = F.length("text")
    gone = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - gone), F.substring(F.coalesce("after", F.lit("")), F.lit(1), gone))
    rows = rows.select("piece", "rank", "copied", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["piece", "rank", "copied", "doc_id", "n_chars", "edited_sha256"]
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    long = rows.select(*keys, F.explode(texts).alias("e")).where("not copied or e.which = 0").select(*keys, "e.which", "e.t")
    prints = votes(long, [*keys, "which"], "t")
    wide = prints.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("efp")
    )
    wide = wide.withColumn("nfp", F.lead("fp").over(Window.partitionBy("piece").orderBy("rank"))).where("not copied")
    wide = materialised(wide.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp"))
    asked = F.col("doc_id") % every == 0
    near = within_radius(wide.where(asked).select(F.col("fp").alias("fingerprint")), wide.select(F.col("fp").alias("fingerprint")), radius)
    sizes = wide.groupBy(F.col("fp").alias("other")).agg(F.count(F.lit(1)).alias("_n"))
    found = near.join(sizes, "other").groupBy(F.col("fingerprint").alias("fp")).agg((F.sum("_n") - 1).alias("n_near"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    shown = [
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    ]
    none = F.lit(None).cast("long").alias("n_near")
    return wide.where(asked).join(found, "fp", "left").select(*shown, "n_near").unionByName(
        wide.where(~asked | F.col("doc_id").isNull()).select(*shown, none)
    )
