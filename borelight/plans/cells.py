"""Binned rows counted by cell: to a tree, rows with the same bins and label are one row that counts so many times.

A cell has a number made of its bins, so cells are counted in the tasks that read the rows and summed by one shuffle. There are at most as many as the bins allow
(four features of 32 bins: a million a class), however many rows; counts take the place of rows in draws too (Poisson, binomial), with the same distribution.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.operators.materialise import materialised

UNUSED, FIT, WATCH = 0, 1, 2  # roles of a row in a model
COUNTED_ROWS = 50_000  # fewer are not worth counting
HELD = 1_000_000  # cells that a task remembers
AT_ONCE = 200_000  # rows that it counts at once


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """0: unknown; otherwise one more than the number of edges below the value."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], "left"))
    return out


def values(df: DataFrame, features: list[str]):
    """The features of a row as one array, NaN where unknown."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def places(edges: list[np.ndarray], times: int = 1) -> list[int] | None:
    """What a bin of each feature counts for in the number of a cell; None if `times` as many numbers do not fit a long."""
    widths = [len(e) + 2 for e in edges]
    return [math.prod(widths[:f]) for f in range(len(widths))] if math.prod(widths) * times < 1 << 62 else None


def numbered(bins: np.ndarray, at: list[int]) -> np.ndarray:
    out = np.zeros(len(bins), np.int64)
    for f, p in enumerate(at):
        out += bins[:, f].astype(np.int64) * p
    return out


def unnumbered(cells: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([cells // p % (len(e) + 2) for e, p in zip(edges, places(edges), strict=True)], axis=1).astype(np.uint8)


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells, at = np.unique(cells, return_inverse=True)
    return cells, np.stack([np.bincount(at, c, len(cells)) for c in counts.T], axis=1).astype(np.int64)


def counted(rows: DataFrame, features: list[str], edges: list[np.ndarray], classes: int, models: int = 1) -> DataFrame | None:
    """`rows` (features, _label, _roles) by cell, written once: (cell, n0, n1, ..), the rows that FIT and that WATCH of each model in turn.

    The number of a cell ends with the label. Rows without a label are left out. None if cells cannot be numbered.
    """
    at = places(edges, classes)
    if at is None:
        return None
    names = [f"n{i}" for i in range(2 * models)]

    def count(batches):
        held, waiting, size = (np.zeros(0, np.int64), np.zeros((0, 2 * models), np.int64)), [], 0
        told = lambda h: pa.RecordBatch.from_arrays([pa.array(h[0]), *[pa.array(np.ascontiguousarray(c)) for c in h[1].T]], names=["cell", *names])
        for b in batches:
            if not b.num_rows:
                continue
            bins = binned(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), edges)
            roles = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            counts = np.stack([roles == FIT, roles == WATCH], axis=2).reshape(b.num_rows, -1)
            waiting.append((numbered(bins, at) * classes + b.column(1).to_numpy(), counts))
            size += b.num_rows
            if size >= AT_ONCE:
                held, waiting, size = _summed(*map(np.concatenate, zip(held, *waiting, strict=True))), [], 0
                if len(held[0]) > HELD:
                    yield told(held)
                    held = held[0][:0], held[1][:0]
        if waiting:
            held = _summed(*map(np.concatenate, zip(held, *waiting, strict=True)))
        if len(held[0]):
            yield told(held)

    known = rows.where(F.col("_label") >= 0).select(values(rows, features).alias("x"), F.col("_label").cast("int"), F.col("_roles").cast("array<int>"))
    some = known.mapInArrow(count, "cell long, " + ", ".join(f"{n} long" for n in names))
    return materialised(some.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]))


def gathered(cells: DataFrame, edges: list[np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, label, counts) of all cells in the order of their numbers; for a number of cells that is known to be small."""
    table = cells.toArrow()
    number = table.column("cell").to_numpy()
    order = np.argsort(number)
    counts = np.stack([table.column(c).to_numpy() for c in table.column_names[1:]], axis=1)[order]
    return unnumbered(number[order] // classes, edges), (number[order] % classes).astype(np.int16), counts


def scored(df: DataFrame, model) -> DataFrame:
    """`df` with `probability` (array) and `prediction` (index of the class), worked out once for each cell that a Python worker meets."""
    at = places(model.edges)
    held = df.sparkSession.sparkContext.broadcast({"pickled": cloudpickle.dumps(model)})  # a worker keeps it from task to task, and with it the cells known so far

    @F.arrow_udf("array<double>")
    def score(x: pa.Array) -> pa.Array:
        kept = held.value
        if "model" not in kept:
            kept["model"] = cloudpickle.loads(kept["pickled"])
        m = kept["model"]
        bins = binned(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(m.edges)), m.edges)
        if at is None:
            p = m.probabilities(bins)
        else:
            asked, of_row = np.unique(numbered(bins, at), return_inverse=True)
            cells, known = kept.get("known", (None, None))
            if cells is None or len(cells) > HELD:
                cells, known = asked, m.probabilities(unnumbered(asked, m.edges))
            else:
                new = asked[~np.isin(asked, cells)]
                if len(new):
                    cells, known = np.concatenate([cells, new]), np.concatenate([known, m.probabilities(unnumbered(new, m.edges))])
                    order = np.argsort(cells)
                    cells, known = cells[order], known[order]
            kept["known"] = cells, known
            p = known[np.searchsorted(cells, asked)][of_row]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(np.ascontiguousarray(p).ravel()))

    out = df.withColumn("probability", score(values(df, model.features)))
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
