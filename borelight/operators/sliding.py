"""Mean and deviation over sliding row frames, from sorted rows that Spark streams to a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
NOT_ARROW = (T.UserDefinedType, T.VariantType, T.CalendarIntervalType)
LEAST = 8192  # rows gone through at once

Frame = tuple[str, int, int]  # column, first and last row of the frame counted from the current one


def moments(x: np.ndarray, known: np.ndarray, group: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation over the frame of every row, NaN and unknown apart; masked where fewer than two values are known.

    Values are added in the order of the frame, so a row's result does not depend on where the rows are cut.
    """
    n = len(x)
    count, total, mean, squares = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
    for o in range(max(first, 1 - n), min(last, n - 1) + 1):
        here, there = slice(max(0, -o), n - max(0, o)), slice(max(0, o), n - max(0, -o))
        there_known = known[there] & (group[there] == group[here])
        value = x[there]
        count[here] += there_known
        total[here] += np.where(there_known, value, 0.0)
        delta = np.where(there_known, value - mean[here], 0.0)
        share = delta / np.maximum(count[here], 1)
        mean[here] += share
        squares[here] += delta * (delta - share)
    few = count < 2
    return np.ma.array(total / np.maximum(count, 1), mask=few), np.ma.array(np.sqrt(squares / np.maximum(count - 1, 1)), mask=few)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values = pc.cast(column, pa.float64(), safe=False)
    return pc.fill_null(values, 0.0).to_numpy(), ~values.is_null().to_numpy()


def rolled_batches(batches: Iterator[pa.RecordBatch], frames: dict[str, Frame]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column numbers the rows of a key from 1, with `<name>_mean` and `<name>_std` in its place. A few rows on both sides are held."""
    before = max([-lo for _, lo, _ in frames.values()] + [0])
    after = max([hi for _, _, hi in frames.values()] + [0])
    held: list[pa.RecordBatch] = []
    done = new = 0  # rows held that are told already; rows that came since

    def told(end: bool):
        rows = pa.Table.from_batches(held)
        upto = len(rows) if end else len(rows) - after
        if upto > done:
            group = np.cumsum(rows.column(rows.num_columns - 1).to_numpy() == 1)
            known = {c: _numbers(rows.column(c)) for c in {c for c, _, _ in frames.values()}}
            out = rows.slice(done, upto - done).drop_columns([rows.column_names[-1]])
            with np.errstate(all="ignore"):
                for name, (c, lo, hi) in frames.items():
                    for kind, v in zip(("mean", "std"), moments(*known[c], group, lo, hi), strict=True):
                        out = out.append_column(f"{name}_{kind}", pa.array(v.data[done:upto], pa.float64(), mask=np.ma.getmaskarray(v)[done:upto]))
            yield from out.combine_chunks().to_batches()
        keep = max(0, upto - before)
        return rows.slice(keep).combine_chunks().to_batches(), max(done, upto) - keep

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        new += batch.num_rows
        if new >= max(LEAST, before + after):
            held, done = yield from told(False)
            new = 0
    if held:
        yield from told(True)


def rolled(df: DataFrame, win: WindowSpec, frames: dict[str, Frame], extra: list[Column]) -> DataFrame:
    """`df` with `extra` columns, and `<name>_mean` and `<name>_std` over each frame of rows in the order of `win`; NULL below two known values.

    Spark partitions and sorts the rows once. Its own sliding frames add up every frame anew row by row; here each of the frame's rows is added for many rows at
    once. Columns that are no plain numbers (decimals), and rows that Arrow does not carry, are left to Spark.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = not any(isinstance(t, NOT_ARROW) for t in types.values())
    fast = {n: f for n, f in frames.items() if plain and isinstance(types.get(f[0]), NUMBERS)}
    slow = []
    for n, (c, lo, hi) in frames.items():
        if n not in fast:
            over = win.rowsBetween(lo, hi)
            enough = F.count(c).over(over) >= 2
            slow += [F.when(enough, F.avg(c).over(over)).alias(f"{n}_mean"), F.when(enough, F.stddev_samp(c).over(over)).alias(f"{n}_std")]
    rows = df.select("*", *extra, *slow)
    if not fast:
        return rows
    made = [T.StructField(f"{n}_{kind}", T.DoubleType()) for n in fast for kind in ("mean", "std")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *made])
    return df.select("*", *extra, *slow, F.row_number().over(win).alias("_rn")).mapInArrow(lambda batches: rolled_batches(batches, fast), schema)
