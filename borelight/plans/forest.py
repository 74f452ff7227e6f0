"""A balanced random forest over counted cells: every tree is grown by one task that has all cells, and the rows of a tree are drawn by counts.

The trees are those of MLlib's RandomForestClassifier: Poisson bootstrap, Gini gain over at most `bins` bins a feature, the same weights, fewest rows and features
a node, and equal leaves under one node merged. Cells beyond FOREST_CELLS are left to MLlib.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.plans.cells import FIT, counted, gathered, scored

FOREST_BINS = 32  # MLlib's maxBins
FOREST_CELLS = 4_000_000
POINTS = 1000  # quantiles of a class that its split points are taken from
COUNTS_AT_ONCE = 4_000_000  # of a level's open nodes


@dataclass
class Forest:
    """Split points a feature, and trees: (feature or -1, cut, left child, share of each class) a node; the right child follows the left."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[tuple]

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        votes = 0.0
        flat, first = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for feature, cut, left, share in self.trees:
            at, live = np.zeros(len(bins), np.int32), np.arange(len(bins))
            while len(live := live[feature[at[live]] >= 0]):
                here = at[live]
                at[live] = left[here] + (flat[first[live] + feature[here]] > cut[here])
            votes = votes + share[at].astype(float)
        return votes / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        return scored(df, self)


def split_points(points: list[tuple[np.ndarray, float]], bins: int) -> np.ndarray:
    """Cuts between `bins` bins of about the same weight; `points`: evenly weighted values and their weight in all, for each class."""
    every = np.concatenate([v for v, _ in points])
    shares = np.concatenate([np.full(len(v), w / len(v)) for v, w in points])
    value, at = np.unique(every, return_inverse=True)
    weight = np.bincount(at, shares, len(value))
    between = (value[1:] + value[:-1]) / 2
    if len(value) <= bins:
        return between
    upto, stride, cuts = np.cumsum(weight), weight.sum() / bins, []
    target = stride
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(between[i - 1])
            target += stride
    return np.array(cuts[: bins - 1])


def grown(x: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, widths: list[int], depth: int, least: int, take: int, rng) -> tuple:
    """One tree over rows drawn with replacement, by levels; a node is cut where the weighted Gini gain is largest."""
    n = rng.poisson(n).astype(float)
    drawn = np.flatnonzero(n)
    x, y, n, classes = x[drawn], y[drawn].astype(np.int64), n[drawn], len(weight)
    slot = np.zeros(len(y), np.int64)  # the open node of a cell
    counts = np.bincount(y, n, classes)[None, :]  # rows of each class in the nodes of the level
    feature, cut, left, stats, first = [], [], [], [], 0
    may = lambda c, level: ((c > 0).sum(axis=1) > 1) & (c.sum(axis=1) >= 2 * least) & (level < depth)
    is_open = may(counts, 0)
    if not is_open[0]:
        x, y, n, slot = x[:0], y[:0], n[:0], slot[:0]
    level = 0
    while True:
        feature.append(np.full(len(counts), -1, np.int16))
        cut.append(np.zeros(len(counts), np.uint8))
        left.append(np.zeros(len(counts), np.int32))
        stats.append(counts * weight)
        opened = np.flatnonzero(is_open)
        if not len(opened):
            break
        usable = rng.random((len(opened), x.shape[1])).argsort(axis=1).argsort(axis=1) < take
        gain, at_f, at_b, below = np.full(len(opened), -np.inf), np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64), np.zeros((len(opened), classes))
        some = max(1, COUNTS_AT_ONCE // (max(widths) * classes))
        if some < len(opened):
            order = np.argsort(slot, kind="stable")
            x, y, n, slot = x[order], y[order], n[order], slot[order]
        for a in range(0, len(opened), some):
            b = min(a + some, len(opened))
            rows = slice(None) if some >= len(opened) else slice(*np.searchsorted(slot, [a, b]))
            mine, k, c = slot[rows] - a, y[rows], n[rows]
            whole = counts[opened[a:b]]
            heavy = whole * weight
            base = (heavy**2).sum(axis=1) / heavy.sum(axis=1)
            for f, width in enumerate(widths):
                if width < 2 or not usable[a:b, f].any():
                    continue
                hist = np.bincount((mine * width + x[rows, f]) * classes + k, c, (b - a) * width * classes).reshape(b - a, width, classes)
                under = hist.cumsum(axis=1)[:, :-1]
                over = whole[:, None] - under
                u, o = under * weight, over * weight
                score = (u**2).sum(axis=2) / np.maximum(u.sum(axis=2), 1e-300) + (o**2).sum(axis=2) / np.maximum(o.sum(axis=2), 1e-300)
                score = (score - base[:, None]) / heavy.sum(axis=1)[:, None]
                score[(under.sum(axis=2) < least) | (over.sum(axis=2) < least) | ~usable[a:b, f, None]] = -np.inf
                best = score.argmax(axis=1)
                most = score[np.arange(b - a), best]
                better = np.flatnonzero(most > gain[a:b])
                gain[a + better], at_f[a + better], at_b[a + better] = most[better], f, best[better]
                below[a + better] = under[better, best[better]]
        split = np.flatnonzero(gain > 1e-12)
        if not len(split):
            break
        cut_nodes = opened[split]
        feature[-1][cut_nodes], cut[-1][cut_nodes] = at_f[split], at_b[split]
        first += len(counts)
        left[-1][cut_nodes] = first + 2 * np.arange(len(split))
        children = np.stack([below[split], counts[cut_nodes] - below[split]], axis=1).reshape(-1, classes)
        level += 1
        is_open = may(children, level)
        rank = np.full(len(opened), -1)
        rank[split] = np.arange(len(split))
        child = np.where(rank[slot] < 0, -1, 2 * rank[slot] + (x[np.arange(len(x)), at_f[slot]] > at_b[slot]))
        stay = np.flatnonzero((child >= 0) & is_open[child])
        slot = (np.cumsum(is_open) - 1)[child[stay]]
        x, y, n, counts = x[stay], y[stay], n[stay], children
    return pruned(feature, cut, left, stats)


def pruned(feature: list, cut: list, left: list, stats: list) -> tuple:
    """The nodes of the levels without pairs of leaves that say the same class, numbered anew."""
    size = np.cumsum([0, *map(len, feature)])
    feature, cut, left, stats = map(np.concatenate, (feature, cut, left, stats))
    says = stats.argmax(axis=1)
    for a, b in zip(size[-2::-1], size[:0:-1], strict=True):
        inner = a + np.flatnonzero(feature[a:b] >= 0)
        one, two = left[inner], left[inner] + 1
        feature[inner[(feature[one] < 0) & (feature[two] < 0) & (says[one] == says[two])]] = -1
    levels = [np.zeros(1, np.int64)]
    while len(inner := levels[-1][feature[levels[-1]] >= 0]):
        levels.append(np.stack([left[inner], left[inner] + 1], axis=1).ravel())
    kept = np.concatenate(levels)
    number = np.zeros(len(feature), np.int32)
    number[kept] = np.arange(len(kept))
    whole = stats[kept].sum(axis=1, keepdims=True)
    return feature[kept], cut[kept], number[left[kept]], np.divide(stats[kept], whole, out=np.zeros_like(stats[kept]), where=whole > 0).astype(np.float32)


def fit_forest(rows: DataFrame, features: list[str], classes: int, trees: int, depth: int, least: int, seed: int) -> Forest | None:
    """A forest over `rows`: features without gaps, `weight` (one a class, else its mean) and `_label`. None if they have more than FOREST_CELLS cells."""
    spark = rows.sparkSession
    probs = [i / POINTS for i in range(POINTS + 1)]
    about = rows.where("_label >= 0").groupBy(F.col("_label").cast("int").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.min("weight") == F.max("weight"), F.max("weight")).otherwise(F.avg("weight")).alias("w"), *[F.percentile_approx(f, probs, 10_000).alias(f"q{i}") for i, f in enumerate(features)]
    ).collect()
    weight = np.zeros(classes)
    for r in about:
        weight[r["k"]] = r["w"]
    edges = [split_points([(np.array(r[f"q{i}"]), r["n"] * r["w"]) for r in about], FOREST_BINS) for i in range(len(features))]
    cells = counted(rows.withColumn("_roles", F.array(F.lit(FIT))), features, edges, classes)
    if cells is None or cells.count() > FOREST_CELLS:
        return None
    bins, label, n = gathered(cells, edges, classes)
    held = spark.sparkContext.broadcast((bins, label, n[:, 0]))
    widths, take = [len(e) + 2 for e in edges], math.ceil(math.sqrt(len(features)))

    def grow(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                bins, label, n = held.value
                tree = grown(bins, label, n, weight, widths, depth, least, take, np.random.default_rng([seed, t]))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in tree]], names=["t", "feature", "cut", "left", "share"])

    tasks = min(trees, 8 * spark.sparkContext.defaultParallelism)
    got = spark.range(0, trees, 1, tasks).mapInArrow(grow, "t long, feature binary, cut binary, left binary, share binary").collect()
    of = lambda r: (np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["left"], np.int32), np.frombuffer(r["share"], np.float32).reshape(-1, classes))
    return Forest(features, edges, [of(r) for r in sorted(got, key=lambda r: r["t"])])
