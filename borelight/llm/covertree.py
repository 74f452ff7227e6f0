"""Threshold pairs of vectors by cosine: a cover tree, traversed against itself.

On the unit sphere cosine >= c means distance <= t = sqrt(2 - 2 c). The upper levels of the tree are nested nets with halving radii, fitted on
a bounded sample; every vector goes below its nearest lowest centre, into the shell of halving radii that its distance falls in, so that
the copies around a centre are a small node of their own. Radii of nodes are true largest distances, whatever the sample was, so bounds hold for
all vectors. Pairs of nodes are visited from the root down: centres further apart than t and both radii cannot hold a link; centres so
close that t covers them and both radii hold nothing but links, which are counted by weight and never formed. What stays open is compared
vector by vector, in tasks of two bundles of nodes with a bounded number of rows each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelight.llm.near import components
from borelight.operators.materialise import materialised

SAMPLE = 2048  # vectors that the upper levels are fitted on, and at most so many lowest centres
BUNDLE = 8192  # rows of a bundle; beyond BUNDLES of them bundles grow up to MOST rows
BUNDLES = 256
MOST = 1 << 16
CELL = 1 << 22  # products made at once
CHUNK = 1 << 14  # pairs of nodes looked at at once
SLACK = 1e-9  # bounds of nodes are taken so much wider; the comparison of vectors is not


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centre (the first of equals) and the distance to it."""
    half = (centres * centres).sum(axis=1) / 2
    at = np.concatenate([np.zeros(0, np.int64), *[(points[i : i + 1024] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), 1024)]])
    return at, norms(points - centres[at])


class Tree:
    """Nested nets over `sample`, a root of radius 2 at least first: per level its centres and which centre above covers each; the lowest
    net has radius t, and its centres are moved to the middle of the sample's vectors within t of them."""

    def __init__(self, sample: np.ndarray, t: float):
        radius = t * 2.0 ** math.ceil(math.log2(2.0 / t))
        far, chosen = np.full(len(sample), np.inf), []
        self.centres: list[np.ndarray] = []
        self.parents: list[np.ndarray] = []
        while True:
            while far[k := int(far.argmax())] > radius:
                chosen.append(k)
                np.minimum(far, norms(sample - sample[k]), out=far)
            points = sample[chosen]
            self.parents.append(nearest(points, self.centres[-1])[0] if self.centres else np.zeros(len(points), np.int64))
            self.centres.append(points)
            if radius <= t * 1.5:
                break
            radius /= 2
        own, gap = nearest(sample, points)
        sums, many = np.zeros_like(points), np.zeros(len(points))
        np.add.at(sums, own[gap <= t], sample[gap <= t])
        np.add.at(many, own[gap <= t], 1)
        self.centres[-1] = sums / many[:, None]

    def pairs(self, radii: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (u <= v) of lowest centres below which links may lie, from the root down. `radii`: of all that is below each lowest centre."""
        cover = [radii]
        for k in range(len(self.centres) - 1, 0, -1):
            reach = norms(self.centres[k] - self.centres[k - 1][self.parents[k]]) + cover[0]
            cover.insert(0, np.zeros(len(self.centres[k - 1])))
            np.maximum.at(cover[0], self.parents[k], reach)
        u, v = np.triu_indices(len(self.centres[0]))
        for k, points in enumerate(self.centres):
            if k:
                u, v = expanded(self.parents[k], u, v)
            keep = [norms(points[a] - points[b]) <= t + SLACK + cover[k][a] + cover[k][b] for a, b in chunks(u, v)]
            keep = np.concatenate([np.zeros(0, bool), *keep])
            u, v = u[keep], v[keep]
        return u, v


def chunks(u: np.ndarray, v: np.ndarray):
    return ((u[i : i + CHUNK], v[i : i + CHUNK]) for i in range(0, len(u), CHUNK))


def expanded(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a <= b) of the children of each pair of nodes (u <= v), every pair once."""
    order = np.argsort(parent, kind="stable")
    size = int(max(u.max(initial=0), v.max(initial=0), parent.max(initial=0))) + 1
    starts = np.searchsorted(parent[order], np.arange(size + 1))
    many = np.diff(starts)
    n = many[u] * many[v]
    pair = np.repeat(np.arange(len(u)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    per = many[v[pair]]
    a, b = order[starts[u[pair]] + at // np.maximum(per, 1)], order[starts[v[pair]] + at % np.maximum(per, 1)]
    keep = (u[pair] != v[pair]) | (a <= b)
    a, b = a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


class Nodes:
    """The nodes (leaf, shell) that hold vectors: rows, weight, least and largest distance from their centre, smallest member."""

    def __init__(self, rows: list, centres: np.ndarray):
        rows = sorted(rows, key=lambda r: (r["leaf"], r["shell"]))
        self.leaf, self.shell, self.n, self.weight, self.first = (np.array([r[c] for r in rows], np.int64) for c in ("leaf", "shell", "n", "weight", "first"))
        self.near, self.far = (np.array([r[c] for r in rows], float) for c in ("near", "far"))
        self.centre = centres[self.leaf].reshape(len(rows), centres.shape[1])

    def sorted_pairs(self, tree: Tree, t: float):
        """Chunks of pairs (p <= q) of nodes that may hold links, each with what is true of those that hold nothing but links."""
        radii = np.zeros(len(tree.centres[-1]))
        np.maximum.at(radii, self.leaf, self.far)
        for u, v in chunks(*tree.pairs(radii, t)):
            for p, q in chunks(*expanded(self.leaf, u, v)):
                apart = norms(self.centre[p] - self.centre[q])
                gap = np.maximum(apart - self.far[p] - self.far[q], np.maximum(self.near[p] - self.far[q], self.near[q] - self.far[p]) - apart)
                may = gap <= t + SLACK
                p, q, apart = p[may], q[may], apart[may]
                yield p, q, apart + self.far[p] + self.far[q] <= t - SLACK

    def bundled(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The first bundle of every node and to how many it is dealt: small nodes fill a bundle together, large ones have several."""
        first, shares, now, filled = [], [], 0, 0
        for n in self.n.tolist():
            if filled and filled + n > rows:
                now, filled = now + 1, 0
            first.append(now)
            shares.append(max(1, -(-n // rows)))
            if n > rows:
                now, filled = now + shares[-1], 0
            else:
                filled += n
        return np.array(first, np.int64), np.array(shares, np.int64)


def unit_vectors(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """uid (a number of each row), id, the unit vector in double precision (null where the vector is null, empty or zero, or holds a null or
    no finite number), and two hashes of it."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("id"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))  # first divided by, so that no square is lost
    rows = rows.withColumn("top", F.when(fine & (top > 0), top)).withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    unit = F.when(F.col("top").isNotNull(), F.transform("v", lambda x: x / F.col("norm") + 0.0))
    return rows.select("uid", "id", unit.alias("v")).select("*", F.xxhash64(F.lit(1), "v").alias("d1"), F.xxhash64(F.lit(2), "v").alias("d2"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def placed(reps: DataFrame, tree: Tree, t: float, width: int) -> DataFrame:
    """Every representative below its nearest lowest centre: leaf, distance d and shell (0: at most t / 4, then doubling)."""
    centres = tree.centres[-1]

    def place(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                leaf, d = nearest(matrix(part.column("v"), width), centres)
                shell = np.ceil(np.log2(np.maximum(d, t / 4) / (t / 4))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32)), pa.array(shell), pa.array(d)], names=[*part.schema.names, "leaf", "shell", "d"])

    return reps.select("rep", "w", "v").mapInArrow(place, "rep long, w long, v array<double>, leaf int, shell int, d double")


def linked_groups(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (x, y), each end with the smallest end it reaches, where that is another one."""
    ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(ends))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ends))
    return ends[moved], ends[label[moved]]


def hits(x: tuple, y: tuple, nodes: Nodes, full: np.ndarray, t: float, threshold: float, same: int | None):
    """Weights of links of every row of x and of y (ids, weights, nodes, vectors), and the edges that connect what links connect.

    Pairs of nodes that bounds part are skipped, those in `full` left out. `same`: y begins at that row of x; later rows of x count only."""
    cx, cy, edges = np.zeros(len(x[0]), np.int64), np.zeros(len(y[0]), np.int64), []
    size = len(nodes.leaf)
    kind_x, row_x = np.unique(x[2], return_inverse=True)
    step = max(1, CELL // max(1, len(x[0])))
    for lo in range(0, len(y[0]), step):
        ids, w, node, v = (c[lo : lo + step] for c in y)
        kind_y, row_y = np.unique(node, return_inverse=True)
        p, q = nodes.centre[kind_x], nodes.centre[kind_y]
        apart = np.sqrt(np.maximum(0, (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1) - 2 * p @ q.T))
        far_x, far_y, near_x, near_y = nodes.far[kind_x][:, None], nodes.far[kind_y], nodes.near[kind_x][:, None], nodes.near[kind_y]
        gap = np.maximum(apart - far_x - far_y, np.maximum(near_x - far_y, near_y - far_x) - apart)
        codes = np.minimum(kind_x[:, None], kind_y) * size + np.maximum(kind_x[:, None], kind_y)
        look = (gap <= t + 1e-6) & ~np.isin(codes, full)  # the product above is not exact near 0
        whole = look.mean() > 0.25
        if whole:
            parts = [(np.arange(len(x[0])), np.arange(len(ids)))]
        else:
            parts = [(np.flatnonzero(row_x == k), np.flatnonzero(look[k][row_y])) for k in range(len(kind_x))]
        for i, j in parts:
            if not len(i) or not len(j):
                continue
            hit = x[3][i] @ v[j].T >= threshold
            if whole and not look.all():
                hit &= look[row_x][:, row_y]
            if same is not None:
                hit &= i[:, None] > same + lo + j
            if hit.any():
                cx[i] += hit @ w[j]
                cy[lo + j] += x[1][i] @ hit
                a, b = np.nonzero(hit)
                edges.append(linked_groups(x[0][i[a]], ids[j[b]]))
    return cx, cy, edges


def compared(rows: DataFrame, nodes: Nodes, full: np.ndarray, bundles: int, t: float, threshold: float, width: int) -> DataFrame:
    """Links between the two bundles of every task (its number: first * bundles + second): weights of links (a, null, n), and edges (a, b, null).

    The rows of the first bundle are held, those of the second stream past them."""

    def told(ids, counts, edges):
        some = counts > 0
        a = np.concatenate([ids[some], *[e[0] for e in edges]])
        b = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), *[pa.array(e[1], pa.int64()) for e in edges]])
        n = pa.concat_arrays([pa.array(counts[some], pa.int64()), pa.nulls(len(a) - int(some.sum()), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], names=["a", "b", "n"])

    def compare(batches):
        now, held, x, total = None, [], None, None

        def whole():
            return tuple(np.concatenate(c) for c in zip(*held, strict=True))

        def closed():
            if now is None or not held:
                return
            first, second = divmod(now, bundles)
            mine, sums = (whole(), None) if x is None else (x, total)
            if sums is None:
                sums = np.zeros(len(mine[0]), np.int64)
            if first == second:
                for lo in range(0, len(mine[0]), 2048):
                    cx, cy, edges = hits(mine, tuple(c[lo : lo + 2048] for c in mine), nodes, full, t, threshold, lo)
                    sums += cx
                    sums[lo : lo + 2048] += cy
                    yield told(mine[0][:0], sums[:0], edges)
            yield told(mine[0], sums, [])

        for batch in batches:
            task, side = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(task) != 0) | (np.diff(side) != 0)) + 1, [len(task)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if task[lo] != now:
                    yield from closed()
                    now, held, x, total = int(task[lo]), [], None, None
                part = batch.slice(lo, hi - lo)
                some = (*[part.column(c).to_numpy() for c in ("rep", "w", "node")], matrix(part.column("v"), width))
                if side[lo] == 0:
                    held.append(some)
                elif held:
                    if x is None:
                        x = whole()
                        total = np.zeros(len(x[0]), np.int64)
                    cx, cy, edges = hits(x, some, nodes, full, t, threshold, None)
                    total += cx
                    yield told(some[0], cy, edges)
        yield from closed()

    dealt = rows.repartition("task").sortWithinPartitions("task", "side", "node", "rep")
    return dealt.select("task", "side", "node", "rep", "w", "v").mapInArrow(compare, "a long, b long, n long")


def links(spark: SparkSession, reps: DataFrame, threshold: float, width: int) -> DataFrame:
    """For representatives (rep, w: how many equal vectors it stands for, v): weights (a, null, n) and edges (a, b, null) that give, for each, the
    number of linked vectors other than its own copies, and what links connect."""
    t = math.sqrt(2 - 2 * threshold)
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(matrix(sample, width), t)
    rows = materialised(placed(reps, tree, t, width))
    summary = rows.groupBy("leaf", "shell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.min("d").alias("near"), F.max("d").alias("far"), F.min("rep").alias("first"))
    nodes = Nodes(summary.collect(), tree.centres[-1])  # at most some ten shells of each of 2048 centres
    size = len(nodes.leaf)
    per = int(min(MOST, max(BUNDLE, nodes.n.sum() // BUNDLES)))
    start, shares = nodes.bundled(per)
    bundles = int((start + shares).max())
    extra, tied, full, ties, tasks = np.zeros(size, np.int64), np.zeros(size, bool), [], [], []
    for p, q, all_linked in nodes.sorted_pairs(tree, t):
        x, y = p[all_linked], q[all_linked]
        np.add.at(extra, x, nodes.weight[y])
        np.add.at(extra, y[x != y], nodes.weight[x[x != y]])
        tied[x] = tied[y] = True
        full.append(x * size + y)
        ties.append(np.stack([nodes.first[x], nodes.first[y]], axis=1)[x != y])
        x, y = p[~all_linked], q[~all_linked]
        one = (shares[x] == 1) & (shares[y] == 1)
        tasks.append(np.unique(np.minimum(start[x], start[y])[one] * bundles + np.maximum(start[x], start[y])[one]))
        for a, b in zip(x[~one], y[~one], strict=True):
            i, j = (grid.ravel() for grid in np.meshgrid(start[a] + np.arange(shares[a]), start[b] + np.arange(shares[b])))
            tasks.append(np.unique(np.minimum(i, j) * bundles + np.maximum(i, j)))
    full = np.unique(np.concatenate(full))
    tasks = np.unique(np.concatenate(tasks))
    own = np.isin(np.arange(size) * size + np.arange(size), full)
    known = spark.createDataFrame(
        list(zip(*(c.tolist() for c in (nodes.leaf, nodes.shell, np.arange(size), start, shares, extra, own, tied, nodes.first)), strict=True)),
        "leaf int, shell int, node int, start long, shares long, extra long, own boolean, tied boolean, first long",
    )
    rows = rows.join(F.broadcast(known), ["leaf", "shell"])
    weights = rows.select(F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("extra") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("n"))
    edges = rows.where("tied and rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"), F.lit(None).cast("long").alias("n"))
    out = weights.where("n > 0").unionByName(edges)
    ties = np.concatenate(ties)
    if len(ties):
        out = out.unionByName(spark.createDataFrame([(a, b, None) for a, b in ties.tolist()], "a long, b long, n long"))
    if len(tasks):
        sides = [(k // bundles, k, 0) for k in tasks.tolist()] + [(k % bundles, k, 1) for k in tasks.tolist() if k // bundles != k % bundles]
        sides = spark.createDataFrame(sides, "bundle long, task long, side int")
        rows = rows.withColumn("bundle", F.col("start") + F.pmod(F.xxhash64("rep"), F.col("shares"))).select("bundle", "node", "rep", "w", "v")
        out = out.unionByName(compared(rows.join(sides, "bundle"), nodes, full, bundles, t, threshold, width))
    return out


def similar_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, n_links (other rows whose vectors have a cosine of `threshold`, above 0, or more, in double precision), component_id (the
    smallest id that links reach, itself included) and kept (id = component_id).

    Equal unit vectors are one representative with a weight. Vectors that are null, empty or zero, or hold a null or no finite number, link with nothing, as do
    vectors of different lengths with each other (one traversal for each length). Repeated ids are rows of their own. A null id links like any other;
    its component is the smallest id reached, null if there is none, and it is kept in that case only. No rows: no rows; other columns are
    ignored. Where vectors are no closer to each other than at random, bounds part nothing and every bundle meets every other.
    """
    spark = vectors.sparkSession
    rows = materialised(unit_vectors(vectors, id_column, column))
    equal = rows.where("v is not null").groupBy("d1", "d2").agg(
        F.min("uid").alias("rep"), F.count(F.lit(1)).alias("w"), F.min("id").alias("id"), F.first("v").alias("v"))
    equal = materialised(equal.withColumn("width", F.size("v")))
    out = None
    for r in equal.select("width").distinct().orderBy("width").collect():  # the lengths that occur
        part = links(spark, equal.where(F.col("width") == r["width"]), threshold, r["width"])
        out = part if out is None else out.unionByName(part)
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if out is None:
        named = rows.select("id", *alone)
    else:
        out = materialised(out)
        counts = out.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        groups = components(out.where("b is not null").select("a", "b")).select(F.col("doc_id").alias("rep"), "component")
        each = equal.select("d1", "d2", "rep", "w", "id").join(counts, "rep", "left").join(groups, "rep", "left")
        each = materialised(each.select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "id"))
        least = each.groupBy("component").agg(F.min("id").alias("component_id"))
        each = each.drop("id").join(least, "component").select("d1", "d2", "n_links", "component_id")
        named = rows.where("v is not null").select("id", "d1", "d2").join(each, ["d1", "d2"]).select("id", "n_links", "component_id")
        named = named.unionByName(rows.where("v is null").select("id", *alone))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return named.withColumn("kept", kept)
