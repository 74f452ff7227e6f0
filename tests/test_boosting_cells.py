"""Boosting over counted cells gives the trees that it gives over rows, and blocks take little memory."""

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from borelight.plans import boosting as B
from borelight.plans import lithology as L


def table(spark, n=900, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)).round(1)
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] + 0.3 * r.normal(size=n) > 0, 1, 0))
    unknown = r.random(n) < 0.1
    rows = [(int(r.integers(0, 10)), *[None if unknown[i] and k == 2 else float(v) for k, v in enumerate(x[i])], int(y[i]) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, "well int, a double, b double, c double, _label int").repartition(4)


def same(one, two):
    for a, b in zip(one, two, strict=True):
        assert (a.best, a.excluded, len(a.rounds)) == (b.best, b.excluded, len(b.rounds)) and a.scores == pytest.approx(b.scores)
        for s, t in zip([t for r in a.rounds for t in r], [t for r in b.rounds for t in r], strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value, atol=1e-5)


def test_cells_give_the_trees_of_rows(spark, monkeypatch):
    df = table(spark)
    rows = df.join(L.fold_roles(L.group_folds(df, 3), 3, 0.2), "well")
    fit = lambda: B.fit_boosted(rows, ["a", "b", "c"], 3, 3, rounds=12, depth=3, subsample=1.0, patience=4)
    by_row = fit()
    assert all(m.scores for m in by_row)
    monkeypatch.setattr(B, "COUNTED_ROWS", 1)
    with monkeypatch.context() as m:
        m.setattr(B, "BOOST_CELLS", 0)
        m.setattr(B, "BLOCK_CELLS", 100)
        same(fit(), by_row)
    monkeypatch.setattr(B, "passed", None)  # one job in all, no job a level
    same(fit(), by_row)


def test_rows_of_a_cell_are_drawn_one_by_one(spark, monkeypatch):
    """Ten times the rows of a cell are drawn as ten times a binomial number, so the fit is close to that of all rows."""
    rows = table(spark).withColumn("_roles", F.array(F.lit(B.FIT))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("copy")
    fits = []
    for cells in (1, 0):
        monkeypatch.setattr(B, "COUNTED_ROWS", 1)
        monkeypatch.setattr(B, "BOOST_CELLS", cells * 10**6)
        fits.append(B.fit_boosted(rows, ["a", "b", "c"], 3, rounds=5, depth=2, subsample=0.8)[0])
    monkeypatch.setattr(B, "COUNTED_ROWS", 10**9)
    fits.append(B.fit_boosted(rows, ["a", "b", "c"], 3, rounds=5, depth=2, subsample=0.8)[0])
    bins = np.random.default_rng(1).integers(1, 40, (300, 3)).astype(np.uint8)
    p = [f.probabilities(bins) for f in fits]
    assert abs(p[0] - p[2]).max() < 0.05 and abs(p[1] - p[2]).max() < 0.05 and (p[0] != p[2]).any()


def test_blocks_take_little_memory(spark):
    """No margins are written before there are trees, what a file's piece holds is its size, and what Spark keeps lies on disk."""
    rows = table(spark).where("_label >= 0").withColumn("_roles", F.array(F.lit(B.FIT)))
    blocks = B.packed_blocks(rows, ["a", "b", "c"], [np.array([0.0])] * 3)
    assert {len(r["margins"]) for r in blocks.collect()} == {0} and all(f.endswith(".parquet") and "snappy" not in f for f in blocks.inputFiles())
    job = B.Job(1, 3, 3, 3)
    t = B.Tree.empty(1)
    t.value[0] = 0.5
    job.recent = [{0: [t, B.Tree.empty(1), B.Tree.empty(1)]}]
    kept = B._with_margins(blocks, job, False)
    assert kept.storageLevel == StorageLevel.DISK_ONLY
    got = np.concatenate([np.frombuffer(r["margins"]).reshape(-1, 3) for r in kept.collect()])
    assert len(got) == rows.count() and (got == [0.5, 0.0, 0.0]).all()
    kept.unpersist()


def test_a_large_table_is_scored_as_row_by_row(spark):
    df = table(spark, 600).withColumnRenamed("_label", "lithology")
    b = L.train_lithology(df, ["a", "b", "c"], "boosted", rounds=3, boosted_depth=2).model
    out = b.transform(df).toPandas()
    want = b.probabilities(B.binned(out[["a", "b", "c"]].to_numpy(float), b.edges))
    assert (np.stack(out["probability"].to_numpy()) == want).all() and (out["prediction"] == want.argmax(axis=1)).all()
