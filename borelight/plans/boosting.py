"""Boosted trees for several classes: one softmax ensemble over binned features, stopped on the macro F1 of rows set aside.

Rows are binned once and packed into blocks. One job a level of a round reads the blocks, whose margins the first job of a round brings up to date with
the trees of the round before, and adds up gradient histograms of the open nodes; the histograms of the tasks are summed, in two steps when there are
many, and the driver picks the splits. Several models over the same rows (folds) share every job: a row has a role in each of them.

Many rows are counted by cell first (`cells.py`): a block then holds cells and how many rows of each model they stand for. Up to BOOST_CELLS cells go to one
task a model, which grows it alone in one job.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.operators.materialise import materialised
from borelight.plans.cells import COUNTED_ROWS, FIT, UNUSED, WATCH, binned, counted, gathered, scored, unnumbered, values  # noqa: F401

BINS = 64
BOOST_CELLS = 1_000_000  # of a model that one task grows
BLOCK_CELLS = 500_000  # of a task's blocks beyond that
WRITE_EVERY = 10  # rounds after which margins are written; between them they are kept by Spark
DIRECT = 64  # tasks whose histograms the driver sums itself
GROUPS = 16


@dataclass
class Tree:
    """Heap-ordered nodes: children of i are 2 i + 1 (bin <= cut, or unknown if `unknown_left`) and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    unknown_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row, by a table of where a node sends each bin (a leaf to itself)."""
        inner = self.feature >= 0
        nodes = np.arange(len(inner), dtype=np.int32)[:, None]
        goes_right = np.arange(256)[None, :] > self.cut[:, None]
        goes_right[:, 0] = ~self.unknown_left
        after = np.where(inner[:, None], 2 * nodes + 1 + goes_right, nodes).astype(np.int32).ravel()
        column = np.maximum(self.feature, 0)
        flat, first = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.int32)
        for _ in range(int(np.flatnonzero(inner).max(initial=-1) + 1).bit_length()):
            at = after[at * 256 + flat[first + column[at]]]
        return at.astype(np.int64)


@dataclass
class Boosted:
    """A fitted ensemble: bin edges per feature, rounds of one tree for each class, and which classes its rows had."""

    features: list[str]
    edges: list[np.ndarray]
    present: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)  # macro F1 after each round
    best: int = 0
    excluded: int = 0

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.present)))
        for trees in self.rounds[: self.best]:
            for k, t in enumerate(trees):
                out[:, k] += t.value[t.leaf_of(bins)]
        out[:, ~self.present] = -np.inf
        return out

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return softmax(self.margins(bins))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (array) and `prediction` (index of the class)."""
        return scored(df, self)


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shares(margins: list[np.ndarray]) -> list[np.ndarray]:
    """`softmax` by columns, one a class."""
    most = margins[0]
    for m in margins[1:]:
        most = np.maximum(most, m)
    e = [np.exp(m - most) for m in margins]
    whole = sum(e[1:], e[0])
    return [x / whole for x in e]


def macro_f1(confusion: np.ndarray) -> float:
    """Mean F1 of the classes that occur as truth (rows) or as prediction (columns)."""
    right, truth, said = np.diag(confusion), confusion.sum(axis=1), confusion.sum(axis=0)
    there = truth + said > 0
    return float((2 * right[there] / (truth + said)[there]).mean()) if there.any() else 0.0


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of every feature, by one pass of mergeable summaries."""
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    probs = [i / bins for i in range(1, bins)]
    got = df.agg(*[F.percentile_approx(c, probs, 10_000).alias(f"q{i}") for i, c in enumerate(clean)]).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in got]


BLOCKS = "block long, bins binary, label binary, roles binary, margins binary"


def _block(block: int, bins: np.ndarray, label: np.ndarray, roles: np.ndarray, margins: bytes = b"") -> pa.RecordBatch:
    """One row; no margins stand for margins of 0."""
    kept = [bins.tobytes(), label.astype(np.int16).tobytes(), roles.tobytes(), margins]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in kept]], names=["block", "bins", "label", "roles", "margins"])


def packed_blocks(rows: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """`rows` (features, _label, _roles) as blocks of binned rows, written once; uncompressed, so that the size of a file's piece says what a task holds."""
    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            yield _block(block, binned(b.column(0).flatten().to_numpy().reshape(n, -1), edges), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().astype(np.uint8))
            block += 1

    known = rows.select(values(rows, features).alias("x"), F.col("_label").cast("int"), F.col("_roles").cast("array<int>"))
    return materialised(known.mapInArrow(pack, BLOCKS), compression="none")


def packed_cells(cells: DataFrame, number: int, edges: list[np.ndarray], classes: int) -> DataFrame:
    """`number` counted cells as blocks, with the rows that fit and that watch of each model in place of roles."""
    def pack(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            cell = b.column(0).to_numpy()
            yield _block(block, unnumbered(cell // classes, edges), cell % classes, np.stack([c.to_numpy() for c in b.columns[1:]], axis=1).astype(np.int32))
            block += 1

    dealt = cells.repartition(max(cells.sparkSession.sparkContext.defaultParallelism, -(-number // BLOCK_CELLS)))
    return materialised(dealt.mapInArrow(pack, BLOCKS), compression="none")


class Job:
    """What a pass over the blocks needs: the trees since margins were written and those that grow."""

    def __init__(self, models: int, classes: int, features: int, bins: int):
        self.shape = models, classes, features, bins
        self.recent: list[dict] = []  # finished rounds: model -> trees
        self.growing: dict = {}  # model -> trees
        self.weights = np.zeros((models, classes))

    def opened(self, row) -> tuple:
        models, classes, features, _ = self.shape
        bins, label, roles, margins = (row[c].as_py() for c in ("bins", "label", "roles", "margins"))
        bins = np.frombuffer(bins, np.uint8).reshape(-1, features)
        if len(roles) == len(bins) * models:
            roles = np.frombuffer(roles, np.uint8).reshape(len(bins), models)
        else:  # rows that fit and that watch
            roles = np.frombuffer(roles, np.int32).reshape(len(bins), models, 2)
        if margins:
            kind = np.float32 if len(margins) == 4 * models * len(bins) * classes else np.float64
            margins = np.frombuffer(margins, kind).reshape(models, len(bins), classes).astype(np.float64)
        else:
            margins = np.zeros((models, len(bins), classes))
        self.caught_up(bins, margins)
        return bins, np.frombuffer(label, np.int16).astype(np.int64), roles, margins

    def caught_up(self, bins: np.ndarray, margins: np.ndarray) -> None:
        for trees_of in self.recent:
            for m, trees in trees_of.items():
                for k, t in enumerate(trees):
                    margins[m, :, k] += t.value[t.leaf_of(bins)]

    def nothing(self, level: int) -> tuple[dict, dict]:
        """Empty histograms of the open nodes of `level`, and confusions."""
        _, classes, features, bins_n = self.shape
        hist = {(m, k): np.zeros((1 << level) * features * bins_n * 2) for m in self.growing for k in range(classes)} if level >= 0 else {}
        return hist, {m: np.zeros((classes, classes), np.int64) for m in self.growing} if level <= 0 else {}

    def tally(self, level: int, bins: np.ndarray, label: np.ndarray, margins: np.ndarray, drawn: np.ndarray, watched: np.ndarray, hist: dict, seen: dict) -> None:
        """Add rows to `hist` and `seen`; a row counts as often for a model as `drawn` and `watched` (rows x models) say."""
        _, classes, features, bins_n = self.shape
        nodes, first = 1 << max(level, 0), (1 << max(level, 0)) - 1
        for m, trees in self.growing.items():
            if level <= 0:
                watch = np.flatnonzero((watched[:, m] > 0) & (label >= 0))
                watch = watch[self.weights[m][label[watch]] > 0]
                said = np.where(self.weights[m] > 0, margins[m][watch], -np.inf).argmax(axis=1)
                np.add.at(seen[m], (label[watch], said), watched[watch, m].astype(np.int64))
            if level < 0:
                continue
            fit = np.flatnonzero((drawn[:, m] > 0) & (label >= 0))
            if not len(fit):
                continue
            x, y = bins[fit], label[fit]
            w = self.weights[m][y] * drawn[fit, m]
            p = shares([margins[m][fit, k] for k in range(classes)])
            cells = [x[:, f].astype(np.int64) + f * bins_n for f in range(features)]
            size = nodes * features * bins_n
            for k, t in enumerate(trees):
                at = t.leaf_of(x) - first
                g = w * (p[k] - (y == k))
                h = w * np.maximum(2 * p[k] * (1 - p[k]), 1e-16)
                some = cells
                if level and at.min() < 0:  # rows that have come to a leaf above
                    here = np.flatnonzero(at >= 0)
                    at, g, h, some = at[here], g[here], h[here], [c[here] for c in cells]
                at *= features * bins_n
                for c in some:
                    key = at + c
                    hist[m, k][:size] += np.bincount(key, g, size)
                    hist[m, k][size:] += np.bincount(key, h, size)

    def shaped(self, hist: dict, level: int) -> dict:
        """Histograms as node x feature x bin x (gradient, hessian)."""
        _, _, features, bins_n = self.shape
        return {key: np.stack(np.split(v, 2), axis=-1).reshape(1 << max(level, 0), features, bins_n, 2) for key, v in hist.items()}


def rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}


def passed(blocks: DataFrame, job: Job, level: int, number: int, seed: int, subsample: float, tasks: int) -> tuple[dict, dict]:
    """Gradient histograms (model, class) -> node x feature x bin x (gradient, hessian) of the open nodes of `level`, and before the first
    level the confusion (model) of the rows that watch. A level of -1 is for the confusion alone."""
    classes = job.shape[1]

    def look(batches):
        hist, seen = job.nothing(level)
        for row in rows_of(batches):
            bins, label, roles, margins = job.opened(row)
            block = row["block"].as_py()
            if roles.ndim == 2:
                take = np.random.default_rng([seed, number, block]).random(len(bins)) < subsample
                drawn, watched = (roles == FIT) & take[:, None], roles == WATCH
            else:
                drawn, watched = np.random.default_rng([seed, number, block]).binomial(roles[:, :, 0], subsample), roles[:, :, 1]
            job.tally(level, bins, label, margins, drawn, watched, hist, seen)
        yield from told(hist, seen)

    def told(hist, seen):
        parts = [(m, k, v.tobytes()) for (m, k), v in hist.items()] + [(m, -1, v.tobytes()) for m, v in seen.items()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["m", "k", "v"])

    def summed(batches):
        hist, seen = {}, {}
        for row in rows_of(batches):
            m, k, v = row["m"].as_py(), row["k"].as_py(), row["v"].as_py()
            if k < 0:
                seen[m] = seen.get(m, 0) + np.frombuffer(v, np.int64)
            else:
                hist[m, k] = hist.get((m, k), 0) + np.frombuffer(v)
        yield from told(hist, seen)

    parts = blocks.mapInArrow(look, "m int, k int, v binary")
    if tasks > DIRECT:
        parts = parts.repartition(GROUPS).mapInArrow(summed, "m int, k int, v binary")
    hist: dict = {}
    seen: dict = {}
    for r in parts.collect():
        if r["k"] < 0:
            seen[r["m"]] = seen.get(r["m"], 0) + np.frombuffer(r["v"], np.int64).reshape(classes, classes)
        else:
            hist[r["m"], r["k"]] = hist.get((r["m"], r["k"]), 0) + np.frombuffer(r["v"])
    return job.shaped(hist, level), seen


def split_level(tree: Tree, hist: np.ndarray, level: int, usable: np.ndarray, rate: float, shrink: float, least: float) -> None:
    """Give every open node of `level` its best split, and its children their values; a node without one stays a leaf."""
    first = (1 << level) - 1
    for node in range(len(hist)):
        me = first + node
        if level and tree.feature[(me - 1) // 2] < 0:
            continue
        total = hist[node, 0].sum(axis=0)
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + shrink)
        if level == 0:
            tree.value[0] = -rate * total[0] / (total[1] + shrink)
        below = np.cumsum(hist[node, :, 1:], axis=1)[:, :-1]
        best = None
        for with_unknown in (True, False):
            left = below + hist[node, :, :1] if with_unknown else below
            right = total - left
            gain = score(left) + score(right) - score(total)
            gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
            gain[~usable] = -np.inf
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > 1e-6 and (best is None or gain[f, b] > best[0]):
                best = gain[f, b], f, b, with_unknown, left[f, b], right[f, b]
        if best is not None:
            _, f, b, unknown_left, left, right = best
            tree.feature[me], tree.cut[me], tree.unknown_left[me] = f, b + 1, unknown_left
            for child, s in ((2 * me + 1, left), (2 * me + 2, right)):
                tree.value[child] = -rate * s[0] / (s[1] + shrink)


def fit_boosted(
    rows: DataFrame, features: list[str], classes: int, models: int = 1, rounds: int = 100, depth: int = 6, rate: float = 0.05, patience: int = 50,
    subsample: float = 0.8, share_of_features: float = 0.8, least: float = 5.0, shrink: float = 1.0, seed: int = 42, bins: int = BINS,
) -> list[Boosted]:
    """One ensemble a model over `rows`: the features, `_label` (0 .. classes - 1, or -1: unknown) and `_roles` (array: UNUSED, FIT or WATCH in each model).

    Rows count by balanced class weights of the model's own rows. After every round the rows that WATCH are scored whole; a model
    stops `patience` rounds after its best macro F1 and keeps the rounds up to it. Without such rows all rounds are kept. Rows that watch
    and have a class which none of the model's rows has are left out and counted (`excluded`). Unknown values take the side that fits better.
    """
    edges = bin_edges(rows, features, bins)
    width = 1 + max([len(e) + 1 for e in edges] + [1])
    counts = rows.select(F.col("_label").alias("k"), F.posexplode("_roles").alias("m", "role")).groupBy("m", "k", "role").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((models, classes))
    for r in counts:
        if r["role"] == FIT and r["k"] is not None and r["k"] >= 0:
            n[r["m"], r["k"]] = r["n"]
    out = [Boosted(features, edges, n[m] > 0) for m in range(models)]
    watched = np.zeros(models, bool)
    for r in counts:
        if r["role"] == WATCH:
            if r["k"] is not None and r["k"] >= 0 and n[r["m"], r["k"]] > 0:
                watched[r["m"]] = True
            else:
                out[r["m"]].excluded += r["n"]
    job = Job(models, classes, len(features), width)
    job.weights = np.divide(n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True) * n, out=np.zeros_like(n), where=n > 0)
    rows = rows.withColumn("_label", F.coalesce("_label", F.lit(-1)))
    active = [m for m in range(models) if n[m].any()]
    grow = _Growth(rounds, depth, rate, patience, share_of_features, least, shrink, seed, subsample)
    many = sum(r["n"] for r in counts) >= COUNTED_ROWS * models
    cells = counted(rows, features, edges, classes, models) if many else None
    number_of = cells.count() if cells is not None else 0
    if cells is not None and number_of <= BOOST_CELLS:
        _each_in_one_task(cells, edges, job, grow, out, watched, active)
    else:
        _over_blocks(packed_blocks(rows, features, edges) if cells is None else packed_cells(cells, number_of, edges, classes), job, grow, out, watched, active)
    for b, w in zip(out, watched, strict=True):
        b.best = b.best if w else len(b.rounds)
    return out


@dataclass
class _Growth:
    """Rounds of trees, whoever adds up the histograms."""

    rounds: int
    depth: int
    rate: float
    patience: int
    share_of_features: float
    least: float
    shrink: float
    seed: int
    subsample: float

    def grow(self, job: Job, out: list[Boosted], watched: np.ndarray, active: list[int], look: Callable, ended: Callable) -> None:
        """`look(level, number)` gives the histograms of `passed`; `ended(number)` brings margins up to date with `job.recent`."""
        classes, features = job.shape[1:3]
        for number in range(self.rounds + 1):
            job.growing = {m: [Tree.empty(self.depth) for _ in range(classes)] for m in active}
            rng = np.random.default_rng([self.seed, number])
            usable = np.isin(np.arange(features), rng.choice(features, max(1, round(self.share_of_features * features)), replace=False))
            for level in range(self.depth) if number < self.rounds else (-1,):
                hist, seen = look(level, number)
                for m, confusion in seen.items():
                    if out[m].rounds and watched[m]:
                        out[m].scores.append(macro_f1(confusion))
                        out[m].best = int(np.argmax(out[m].scores)) + 1
                for m in [m for m in active if watched[m] and len(out[m].scores) - out[m].best >= self.patience]:
                    active.remove(m)
                    del job.growing[m]
                for (m, k), h in hist.items():
                    if m in job.growing:
                        split_level(job.growing[m][k], h, level, usable, self.rate, self.shrink, self.least)
                if not job.growing:
                    break
            if number == self.rounds or not active:
                break
            for m, trees in job.growing.items():
                out[m].rounds.append(trees)
            job.recent.append(job.growing)
            ended(number)
            job.recent = []


def _over_blocks(blocks: DataFrame, job: Job, growth: _Growth, out: list[Boosted], watched: np.ndarray, active: list[int]) -> None:
    """All models together, one job a level of a round."""
    tasks = blocks.rdd.getNumPartitions()
    kept: list[DataFrame] = []  # the blocks of the last rounds that Spark keeps

    def look(level, number):
        hist, seen = passed(blocks, job, level, number, growth.seed, growth.subsample, tasks)
        while kept and kept[0] is not blocks:
            kept.pop(0).unpersist()  # the pass above has brought the newer ones up to date
        return hist, seen

    def ended(number):
        nonlocal blocks
        blocks = _with_margins(blocks, job, (number + 1) % WRITE_EVERY == 0)
        if (number + 1) % WRITE_EVERY:
            kept.append(blocks)

    growth.grow(job, out, watched, active, look, ended)
    for old in kept:
        old.unpersist()


def _each_in_one_task(cells: DataFrame, edges: list[np.ndarray], job: Job, growth: _Growth, out: list[Boosted], watched: np.ndarray, active: list[int]) -> None:
    """Every model in a task of its own that has all cells: one job in all."""
    models, classes, features, bins_n = job.shape
    spark = cells.sparkSession
    held = spark.sparkContext.broadcast(gathered(cells, edges, classes))
    weights = job.weights

    def alone(m: int) -> bytes:
        bins, label, counts = held.value
        some = np.flatnonzero(counts[:, 2 * m : 2 * m + 2].any(axis=1))
        bins, label, fit, watch = bins[some], label[some].astype(np.int64), counts[some, 2 * m], counts[some, 2 * m + 1 : 2 * m + 2]
        own = Job(1, classes, features, bins_n)
        own.weights = weights[m : m + 1]
        margins = np.zeros((1, len(bins), classes))
        drawn = {}  # of this round

        def look(level, number):
            if number not in drawn:
                drawn.clear()
                drawn[number] = np.random.default_rng([growth.seed, number, m]).binomial(fit, growth.subsample)[:, None]
            hist, seen = own.nothing(level)
            own.tally(level, bins, label, margins, drawn[number], watch, hist, seen)
            return own.shaped(hist, level), seen

        model = Boosted([], edges, weights[m] > 0)
        growth.grow(own, [model], watched[m : m + 1], [0], look, lambda number: own.caught_up(bins, margins))
        return pickle.dumps(([[(t.feature, t.cut, t.unknown_left, t.value) for t in trees] for trees in model.rounds], model.scores, model.best))

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([active[i]], pa.int64()), pa.array([alone(active[i])], pa.binary())], names=["m", "model"])

    if active:
        for r in spark.range(0, len(active), 1, len(active)).mapInArrow(run, "m long, model binary").collect():
            trees, out[r["m"]].scores, out[r["m"]].best = pickle.loads(r["model"])
            out[r["m"]].rounds = [[Tree(*t) for t in of_round] for of_round in trees]


def _with_margins(blocks: DataFrame, job: Job, write: bool) -> DataFrame:
    """The blocks with margins that the recent trees are part of: written, in single precision, or kept by Spark as they are."""
    def update(batches):
        for row in rows_of(batches):
            bins, label, roles, margins = job.opened(row)
            yield _block(row["block"].as_py(), bins, label, roles, margins.astype(np.float32 if write else np.float64).tobytes())

    out = blocks.mapInArrow(update, BLOCKS)
    return materialised(out, compression="none") if write else out.persist(StorageLevel.DISK_ONLY)
