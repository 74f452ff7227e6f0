"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find by contracting edges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borelight.llm.shingles import GOLD, common, mix, shingle_set
from borelight.operators.materialise import materialised

SLOTS = 240
ROWS = 6  # slots a band: a pair of similarity 0.8 meets in none of the 40 bands once in 190,000 times
BANDS = SLOTS // ROWS
CHUNK = 8192
FILTER = 1 << 20
MEMBERS = 2000


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a set of hashes: per slot the least (round, random number), the round in the upper 16 bits.

    In round j each element draws a number and, by one more step of its own shuffle of all slots, a slot it has not met yet.
    A later round can only beat slots that hold a later round, so it stops once none is left: after few rounds for large sets.
    """
    best = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(elements), CHUNK):
        e = elements[lo : lo + CHUNK]
        at = np.arange(len(e))
        order = None
        for j in range(slots):
            if best.max() < np.uint64(j << 48):
                break
            u = mix(e + np.uint64(int(GOLD) * (j + 1) % (1 << 64)))
            k = j + (((mix(u) >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            if order is None and j == 0:
                slot, first = k, k
            else:
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint16), (len(e), 1))
                    order[at, first] = 0
                    order[:, 0] = first
                slot = order[at, k]
                order[at, k] = order[:, j]
                order[:, j] = slot
            np.minimum.at(best, slot, np.uint64(j << 48) | (u >> np.uint64(16)))
    return best


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * GOLD + parts[:, k])
    return out


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of every slot, in two planes of four longs."""
    x = mix(signature + GOLD)
    planes = [np.packbits(np.concatenate([(x >> np.uint64(s)).astype(np.uint8) & 1, np.zeros(16, np.uint8)])) for s in (3, 17)]
    return np.concatenate(planes).view(np.int64)


def prints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two longs of the set's digest, sketch and band keys of every document (no shingles: nulls)."""

    def compute(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                n, d1, d2, sk, bk = [], [], [], [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), size)
                    n.append(len(s))
                    if len(s):
                        d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        m = superminhash(s)
                        for out, v in zip((d1, d2, sk, bk), (d[0], d[1], sketch(m), bands(m).view(np.int64)), strict=True):
                            out.append(v)
                    else:
                        for out in (d1, d2, sk, bk):
                            out.append(None)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = [pa.array(v, t) for v, t in zip((n, d1, d2, sk, bk), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(compute, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>")


def prefix(c: str | Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER))


def rows_of(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of `table` whose `key` is among the distinct `key` of `ids`. The hash prefixes of the ids, at most 2**20 of them, are
    broadcast first to keep other rows from being shuffled; the join that follows is exact."""
    ids = ids.select(key).distinct()
    few = F.broadcast(ids.select(prefix(key).alias("_prefix")).distinct())
    return table.withColumn("_prefix", prefix(key)).join(few, "_prefix", "left_semi").drop("_prefix").join(ids, key)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches do not rule out."""
    info = reps.select(F.col("doc_id"), F.col("n_shingles"), F.col("sketch"))
    a = info.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = info.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b").where(may_link("na", "nb", "sa", "sb", percent)).select("a", "b")


def may_link(na: str, nb: str, sa: str, sb: str, percent: int) -> Column:
    """Not ruled out: a linked pair has sizes at most 100 : percent apart, and its sketches differ in few of the 240 slots: a slot differs with
    3/4 (1 - similarity); the limit is five standard deviations above that mean, which one linked pair in three million exceeds."""
    p = 0.75 * (1 - percent / 100)
    limit = int(SLOTS * p + 5 * (SLOTS * p * (1 - p)) ** 0.5) + 1
    x = lambda i: F.col(sa)[i].bitwiseXOR(F.col(sb)[i])
    differ = reduce(lambda u, v: u + v, [F.bit_count(x(i).bitwiseOR(x(i + 4))) for i in range(4)])
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ <= limit)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose full sets link. The text of a goes once to each share of at most some 2000 pairs; the
    texts of the b stream past it, so a task holds one set at a time."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("shares"))
    pairs = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    texts = texts.select("doc_id", "text")
    heads = rows_of(shares.select(F.col("a").alias("doc_id")), texts, "doc_id").withColumnRenamed("doc_id", "a").join(shares, "a")
    heads = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "text")
    others = rows_of(pairs.select(F.col("b").alias("doc_id")), texts, "doc_id").withColumnRenamed("doc_id", "b").join(pairs, "b")
    both = heads.unionByName(others.select("a", "share", "b", "text")).repartition("a", "share")

    def verify(batches):
        now, head = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, share, b, text in zip(*(batch.column(c) for c in ("a", "share", "b", "text")), strict=True):
                a, b = a.as_py(), b.as_py()
                s = shingle_set(text.as_py(), size)
                if b is None:
                    now, head = (a, share.as_py()), s
                    continue
                assert now == (a, share.as_py())
                i = common(head, s)
                if 100 * i >= percent * (len(head) + len(s) - i):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return both.sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long")


def cross_pairs(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of `members` (doc_id, component, n_shingles, sketch) of different components that may link.

    Shingles are put in one order for all, rarest first. Two linked sets share a shingle among the first (1 - percent) of each,
    and their first common one cannot stand so late that too few are left to share; a document's own edits come first and so
    rule most pairs out without loss. A shingle's largest component is never paired with itself: the others meet all its rows.
    """
    rows = rows_of(members, texts, "doc_id").select("doc_id", "text")

    def spread(batches):
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingle_set(t.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d)), pa.array(s)], names=["doc_id", "h"])

    each = materialised(rows.mapInArrow(spread, "doc_id long, h long"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "h"))
    front = each.join(often, "h").withColumn("i", place).where("n > 1").join(members, "doc_id")
    front = materialised(front.where(F.col("i") * 100 <= F.col("n_shingles") * (100 - percent) + 100).drop("n"))
    sizes = front.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    home = sizes.groupBy("h").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    front = front.join(home.select("h", F.col("m.component").alias("home")), "h")
    names = (("doc_id", "a"), ("component", "ca"), ("n_shingles", "na"), ("sketch", "sa"), ("i", "ia"))
    a = front.where("component <> home").select("h", *[F.col(c).alias(d) for c, d in names])
    b = front.select(F.col("h").alias("h2"), *[F.col(c).alias(d.replace("a", "b") if d != "sa" else "sb") for c, d in names])
    most = 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    on = (F.col("h") == F.col("h2")) & (F.col("ca") != F.col("cb")) & (most * 100 >= (F.col("na") + F.col("nb") - most) * percent)
    found = a.join(b, on & may_link("na", "nb", "sa", "sb", percent))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of all nodes of undirected edges (a, b): the smallest node of each connected component.

    Union-find in rounds: every node hooks its larger neighbours on its smallest one, then its smaller ones (path contraction),
    until the edges form stars. Each round writes its edges; the number of rounds grows with the logarithm of the components' size.
    """
    now = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialised(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("doc_id"), F.col("v").alias("component")))


def rooted(edges: DataFrame) -> DataFrame:
    """(doc_id, component) of all nodes of a forest, edges (a, b) with one smaller parent a for each b: a tree's smallest node is its root.
    In each round every node takes its parent's parent, so a path of n nodes needs log2(n) rounds of one join each."""
    now, moved = edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component")), True
    while moved:
        up = now.select(F.col("doc_id").alias("component"), F.col("component").alias("above"))
        now = now.select("doc_id", "component").join(up, "component", "left")
        now = materialised(now.select("doc_id", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")))
        moved = not now.where("moved").isEmpty()
    roots = now.select(F.col("component").alias("doc_id"), "component").distinct()
    return now.select("doc_id", "component").unionByName(roots)


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """`groups` (doc_id, component) after further edges (a, b): only the components that these join are contracted again. A component is
    named by its smallest node, so the smallest of the joined names is the smallest node of all."""
    if edges.isEmpty():
        return groups
    ends = edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    known = materialised(groups.join(ends, "doc_id", "full").select("doc_id", F.coalesce("component", "doc_id").alias("component")))
    name = lambda c: known.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
    between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(between).select(F.col("doc_id").alias("component"), F.col("component").alias("root"))
    return materialised(known.join(roots, "component", "left").select("doc_id", F.coalesce("root", "component").alias("component")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for every row of `docs` (doc_id, text).

    Two documents link if 100 * intersection >= percent * union of their sets of `size`-word shingles; components are what links
    connect. Equal sets are one representative (the smallest id) from the start, so copies cost one row. Representatives that
    share a band key are candidates. No bucket is expanded into pairs at first: its members are compared with its smallest member,
    then with another one that differs from bucket to bucket; members still apart from others of their bucket are then
    paired across components by an exact prefix join. Every link between members of a bucket is thus either confirmed on full
    sets or implied by links that are.

    Null, empty and blank texts have no shingles, link with nothing and are kept. Rows of one id with different sets are told apart by
    numbers of their own, on a written copy of the texts. A null id
    takes the component of an equal set, else null; it is kept only if no other document stands for it. No rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    all_prints = materialised(prints(docs, size))
    several = all_prints.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo <> hi")
    if not several.isEmpty():
        return _by_row(docs, size, percent)
    first = all_prints.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    ids = materialised(first)
    slim = all_prints.where("n_shingles > 0 and doc_id is not null").join(ids, ["d1", "d2", "doc_id"]).dropDuplicates(["d1", "d2", "doc_id"])
    reps = materialised(slim.select("doc_id", "n_shingles", "sketch", "bands"))
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head <> last")
    live = materialised(keyed.join(heads, "key").select("key", "doc_id", "head"))
    texts = materialised(rows_of(live, docs.where("doc_id is not null"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))

    def link(pairs: DataFrame) -> DataFrame:
        pairs = materialised(plausible(pairs, reps, percent))
        return pairs if pairs.isEmpty() else materialised(confirmed(pairs, texts, size, percent))

    def apart(groups: DataFrame) -> DataFrame:
        """Rows of buckets of several components: key, doc_id, component, another member `o` that differs from bucket to bucket, and the
        smallest member `head` with its component `home`."""
        own = live.join(groups, "doc_id", "left").select("key", "doc_id", "head", F.coalesce("component", "doc_id").alias("component"))
        own = materialised(own)
        other = F.min_by(F.struct("doc_id", "component"), F.xxhash64("doc_id", "key")).alias("o")
        ends = (F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by("component", "doc_id").alias("home"), other)
        return materialised(own.join(own.groupBy("key").agg(*ends).where("c0 <> c1"), "key"))

    tried = materialised(live.where("doc_id <> head").groupBy("doc_id").agg(F.min("head").alias("a")).select("a", F.col("doc_id").alias("b")))
    groups = rooted(link(tried))
    left = apart(groups)
    pairs = left.select(F.explode(F.array(F.struct(F.col("head").alias("a"), F.col("home").alias("ca")), F.struct(F.col("o.doc_id").alias("a"), F.col("o.component").alias("ca")))).alias("p"), "doc_id", "component")
    pairs = pairs.where("p.a <> doc_id and p.ca <> component").select(F.least("p.a", "doc_id").alias("a"), F.greatest("p.a", "doc_id").alias("b")).distinct()
    tried2 = materialised(pairs.join(tried, ["a", "b"], "left_anti"))
    groups = merged(groups, link(tried2))
    members = apart(groups).select("doc_id", "component").distinct().join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id")
    rest = cross_pairs(materialised(members), texts, size, percent).join(tried.unionByName(tried2), ["a", "b"], "left_anti")
    groups = merged(groups, materialised(confirmed(materialised(rest), texts, size, percent)))
    named = ids.join(groups, "doc_id", "left").select("d1", "d2", F.coalesce("component", "doc_id").alias("component_id"))
    out = all_prints.select("doc_id", "n_shingles", "d1", "d2").join(materialised(named), ["d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _by_row(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Near duplicates of rows whose ids are not unique: found by row numbers, named by the smallest id of each component."""
    rows = materialised(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size, percent).withColumnsRenamed({"doc_id": "row", "component_id": "group"})
    found = materialised(rows.select("row", "doc_id").join(found, "row"))
    names = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = found.join(names, "group")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of one document (the smallest id) of each near-duplicate group; of rows with one id one
    stays. Rows with a null id stay, equal ones once."""
    found = near_duplicates(docs, size, percent)
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", whole.alias("_whole"))
    rows = rows.join(gone, "doc_id", "left_anti")
    one = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_whole"))).orderBy("_whole")
    return rows.withColumn("_number", F.row_number().over(one)).where("_number = 1").select("_row.*")
