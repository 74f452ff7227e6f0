"""A Merkle manifest of a dataset: leaf hashes of rows, a tree per group, one root, and a proof for every row.

Rows are ranked within their group by a range sort. Ranks are read as digits of base 32; a block is what shares all but the last two
digits, 1024 nodes at most. Inside a block the lowest digit is grouped away first, then the next: each grouping nests the structs of
the digit below and hashes five binary levels. A block becomes one node of the next round, until a group has one node left, its
subroot; subroots are ranked and rolled up likewise. On the way back every block takes the siblings above it as one more row of the same
grouping, and a transform and an explode hand them to its children, so no leaf is joined to a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelight.operators.materialise import materialised
from borelight.operators.skew import broadcast_if_small

DIGIT = 32  # children of a digit, five binary levels
BLOCK = DIGIT * DIGIT
PATH = "array<struct<sib:string,right:boolean>>"  # from the leaf up: the sibling (null: hashed alone), and whether the node stands right of it


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `rank` (0 .. n - 1 within `group`, which is not null, by `order`, nulls first) and `n`, the rows of the group.

    A range sort over (group, order) deals the rows, so a group may spread over any number of tasks; counts per group and task, one row
    for each pair that occurs, give the rank at which a task begins. `order` should tell all rows apart.
    """
    at = rows.columns.index(group)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, now, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = batch.column(at).to_pylist()
            local = np.empty(len(names), dtype=np.int64)
            for i, name in enumerate(names):
                if name != now:
                    now, count = name, 0
                local[i] = count
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(names), part, dtype=np.int32)), pa.array(local)], names=schema.names)

    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = materialised(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(number, schema))
    counts = placed.groupBy(F.col(group).alias("_group"), F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("_group")
    before = F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialised(counts.select("_group", "_part", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_rows").over(own).alias("n")))
    out = placed.join(broadcast_if_small(starts), (F.col(group) == F.col("_group")) & (F.col("part") == F.col("_part")))
    return out.select(*rows.columns, (F.col("local") + F.col("_start")).alias("rank"), "n")


def nested_levels(hashes: Column, levels: Column) -> Column:
    """The hashes of at most 32 nodes, then `levels` (0 to 5) times the hashes of every two neighbours, or of the last one alone."""
    def up(below: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(below, i * 2), F.coalesce(F.get(below, i * 2 + 1), F.lit(""))), 256))

    kind = "array<array<string>>"
    steps = F.slice(F.array(*[F.lit(k) for k in range(1, 6)]), F.lit(1), levels)
    return F.aggregate(steps, F.array(hashes).cast(kind), lambda all, _: F.concat(all, F.array(up(F.element_at(all, -1)))).cast(kind))


def rolled(nodes: DataFrame) -> DataFrame:
    """One round: nodes (grp, rank, n, hash, own) nested into blocks (grp, rank, n, hash, tree)."""
    depth = F.when(F.col("n") <= 1, F.lit(0)).otherwise(F.length(F.conv((F.col("n") - 1).cast("string"), 10, 2)))  # ceil(log2(n))
    last = lambda c: F.element_at(F.element_at(c, -1), 1)
    digits = nodes.select(
        "grp", "n", F.floor(F.col("rank") / BLOCK).alias("block"), (F.floor(F.col("rank") / DIGIT) % DIGIT).cast("int").alias("d1"),
        (F.col("rank") % DIGIT).cast("int").alias("d0"), "hash", "own",
    ).repartition("grp", "block")
    kids = F.sort_array(F.collect_list(F.struct("d0", "hash", "own")))
    inner = digits.groupBy("grp", "block", "n", "d1").agg(kids.alias("kids"))
    inner = inner.withColumn("levels", nested_levels(F.transform("kids", lambda k: k["hash"]), F.least(depth, F.lit(5)).cast("int")))
    runs = F.sort_array(F.collect_list(F.struct("d1", last("levels").alias("hash"), "levels", "kids")))
    outer = inner.groupBy("grp", "block", "n").agg(runs.alias("runs"))
    high = F.greatest(F.lit(0), F.least(F.lit(5), depth - 5)).cast("int")
    outer = outer.withColumn("levels", nested_levels(F.transform("runs", lambda k: k["hash"]), high))
    return outer.select(
        "grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), last("levels").alias("hash"), F.struct("levels", "runs").alias("tree")
    )


def siblings(levels: Column, at: Column) -> Column:
    """The steps of the node at index `at` of the first of `levels` up to the last."""
    def step(level: Column, k: Column) -> Column:
        i = F.call_function("shiftright", at, k)
        right = i % 2 == 1
        return F.struct(F.get(level, F.when(right, i - 1).otherwise(i + 1)).alias("sib"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def opened(blocks: DataFrame, tops: DataFrame, above: DataFrame | None) -> DataFrame:
    """The nodes nested in `blocks`: grp, subroot, root, rank, hash, own and `path`.

    A block's own path is that of its group in `tops` if it is the last of the group, else the one of its node in the round above; blocks
    and paths are rows of one grouping by (grp, rank), one of each at most."""
    tree = blocks.schema["tree"].dataType.simpleString()
    kinds = {"n": "long", "tree": tree, "top": PATH, "path": PATH, "subroot": "string", "root": "string"}

    def row(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("grp", "rank", *[given.get(c, nothing(t)).cast(t).alias(c) for c, t in kinds.items()])

    rows = row(blocks, n=F.col("n"), tree=F.col("tree"))
    rows = rows.unionByName(row(tops.withColumn("rank", F.lit(0).cast("long")), top=F.col("path"), subroot=F.col("subroot"), root=F.col("root")))
    if above is not None:
        rows = rows.unionByName(row(above, path=F.col("path"), subroot=F.col("subroot"), root=F.col("root")))
    one = rows.groupBy("grp", "rank").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kinds]).where("tree is not null")
    one = one.withColumn("path", F.when(F.col("n") == 1, F.col("top")).otherwise(F.col("path")))

    def child(run: Column):
        return lambda kid: F.struct(
            (F.col("rank") * BLOCK + run["d1"] * DIGIT + kid["d0"]).alias("rank"), kid["hash"].alias("hash"), kid["own"].alias("own"),
            F.concat(siblings(run["levels"], kid["d0"]), siblings(F.col("tree.levels"), run["d1"]), F.col("path")).alias("path"),
        )

    kids = F.flatten(F.transform("tree.runs", lambda run: F.transform(run["kids"], child(run))))
    return one.select("grp", "subroot", "root", F.explode(kids).alias("k")).select("grp", "subroot", "root", "k.*")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and the node that is left of every group (grp, hash)."""
    rounds, now = [], nodes
    while not rounds or not now.isEmpty():
        rounds.append(materialised(rolled(now)))
        now = rounds[-1].where("n > 1").select("grp", "rank", "n", "hash", nothing("string").alias("own"))
    left = rounds[0]
    for blocks in rounds[1:]:
        left = left.select("grp", "n", "hash").unionByName(blocks.select("grp", "n", "hash"))
    return rounds, left.where("n = 1").select("grp", "hash")


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """All nodes of the first round; `tops` (grp, path, subroot, root) says what lies above the node left of each group."""
    above = None
    for blocks in reversed(rounds):
        above = opened(blocks, tops, above)
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a node's hash and its steps lead to."""
    def step(h: Column, s: Column) -> Column:
        return F.sha2(F.when(s["sib"].isNull(), h).when(s["right"], F.concat(s["sib"], h)).otherwise(F.concat(h, s["sib"])), 256)

    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, changed: Column | None = None, replaced: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot (of the row's group), root, `path` (the steps), proof_sha256 (of the siblings), folded_root and verified.

    A row's leaf hashes `columns` (null: `-`, else length, colon, value). Per value of `group` leaves ascend by `key` (nulls first; equal
    keys by leaf, equal rows in any order); every two neighbours become their hash, the last one alone if they are odd, until one is left.
    The groups' subroots, ordered by group (null first, UTF-8 bytewise), give the root likewise. `folded_root` starts from the leaf of the
    row with the values of `replaced` where `changed` holds. Null groups are one group, empty texts are values, other columns of any name
    are ignored; no rows: no rows. Rows of one group, whatever its share, spread over blocks of 1024.
    """
    leaf = digest(*[field(F.col(c)) for c in columns])
    other = digest(*[field((replaced or {}).get(c, F.col(c))) for c in columns])
    tampered = nothing("string") if changed is None else F.when(F.coalesce(changed, F.lit(False)), other)
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # never null, in the order asked for
    leaves = docs.select(F.col(key).alias("key"), name.alias("grp"), leaf.alias("hash"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("uid"))
    rows = ranked(materialised(leaves), "grp", ["key", "hash", "uid"])
    rounds, subroots = climbed(rows.select("grp", "rank", "n", "hash", F.struct("key", "tampered").alias("own")))
    subroots = materialised(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "hash"))
    tops, root = climbed(ranked(subroots, "grp", ["own"]))
    start = root.select("grp", F.array().cast(PATH).alias("path"), nothing("string").alias("subroot"), F.col("hash").alias("root"))
    groups = materialised(descended(tops, start).select(F.col("own").alias("grp"), "path", F.col("hash").alias("subroot"), "root"))
    out = descended(rounds, groups)
    sibs = F.filter(F.transform("path", lambda s: s["sib"]), lambda s: s.isNotNull())
    out = out.select(
        F.col("own.key").alias("key"), F.col("hash").alias("leaf"), "subroot", "root", "path", F.sha2(F.array_join(sibs, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("own.tampered", "hash"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
