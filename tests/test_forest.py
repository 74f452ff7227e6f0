"""Forests over counted cells: cells against plain counts, the first split against all splits, and the whole model against MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from borelight.plans import cells as C
from borelight.plans import forest as R
from borelight.plans import lithology as L


def table(spark, n=3000, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=n) > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    unknown = r.random(n) < 0.1
    rows = [(int(r.integers(0, 9)), float(i), *[None if unknown[i] and k == 2 else float(v) for k, v in enumerate(x[i])], int(y[i]) * 10) for i in range(n)]
    return spark.createDataFrame(rows, "well int, depth double, a double, b double, c double, lithology int").repartition(4)


def test_cells_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 50)
    monkeypatch.setattr(C, "AT_ONCE", 100)
    roles = F.array(F.lit(C.FIT), F.when(F.col("well") < 3, C.WATCH).otherwise(C.UNUSED))
    rows = table(spark, 700).withColumn("_label", (F.col("lithology") / 10 - F.when(F.col("well") == 8, 9).otherwise(0)).cast("int")).withColumn("_roles", roles)
    edges = [np.array([-1.0, 0.0, 1.0]), np.array([0.0]), np.array([-0.5, 0.5])]
    bins, label, n = C.gathered(C.counted(rows, ["a", "b", "c"], edges, 3, 2), edges, 3)
    want = {}
    for r in rows.collect():
        if r["_label"] >= 0:
            key = (*C.binned(np.array([[np.nan if r[f] is None else r[f] for f in "abc"]]), edges)[0].tolist(), r["_label"])
            want[key] = want.get(key, 0) + np.array([r["_roles"][0] == C.FIT, r["_roles"][0] == C.WATCH, r["_roles"][1] == C.FIT, r["_roles"][1] == C.WATCH])
    got = {(*b, k): c for b, k, c in zip(bins.tolist(), label.tolist(), n.tolist(), strict=True)}
    assert len(got) == len(label) and got == {k: v.tolist() for k, v in want.items()}
    assert C.places([np.zeros(200)] * 9) is None and C.counted(rows, ["a"] * 9, [np.zeros(200)] * 9, 3) is None


def test_first_split_is_the_best_of_all():
    """Weighted Gini gain of the root over every cut of every feature, from the rows that the tree drew; leaves that say the same are one."""
    r = np.random.default_rng(5)
    x = r.integers(1, 9, (400, 3)).astype(np.uint8)
    y = np.where(x[:, 1] > 4, r.integers(0, 3, 400), 0).astype(np.int16)
    n, weight = r.integers(1, 6, 400), np.array([1.0, 2.0, 0.5])
    feature, cut, left, share = R.grown(x, y, n, weight, [10] * 3, 1, 5, 3, np.random.default_rng(7))
    drawn = np.random.default_rng(7).poisson(n)
    counts = lambda s: np.bincount(y[s], drawn[s], 3) * weight
    gini = lambda c: c.sum() - (c**2).sum() / c.sum()
    best = min((gini(counts(x[:, f] <= b)) + gini(counts(x[:, f] > b)), f, b) for f in range(3) for b in range(1, 8))
    assert (feature[0], cut[0], left[0]) == (best[1], best[2], 1)
    for i, s in ((1, x[:, best[1]] <= best[2]), (2, x[:, best[1]] > best[2])):
        assert share[i] == pytest.approx(counts(s) / counts(s).sum())
    alike = R.grown(x, np.where(r.random(400) < 0.05, 1, 0).astype(np.int16), n, np.ones(2), [10] * 3, 6, 5, 3, np.random.default_rng(7))
    assert len(alike[0]) == 1 or (np.diff(alike[3].argmax(axis=1)[1:]) != 0).any()


def test_levels_in_parts_change_nothing(monkeypatch):
    r = np.random.default_rng(6)
    x, y, n = r.integers(1, 33, (3000, 4)).astype(np.uint8), r.integers(0, 3, 3000).astype(np.int16), r.integers(1, 9, 3000)
    fits = []
    for some in (500, 4_000_000):
        monkeypatch.setattr(R, "COUNTS_AT_ONCE", some)
        fits.append(R.grown(x, y, n, np.array([1.0, 2.0, 3.0]), [34] * 4, 8, 5, 2, np.random.default_rng(1)))
    assert len(fits[0][0]) > 100 and all((a == b).all() for a, b in zip(*fits, strict=True))


def test_split_points():
    """Few values: between all of them. Many: cuts of even weight, so that a class with three quarters of it gets three quarters of the cuts."""
    assert R.split_points([(np.array([1.0, 2.0, 2.0]), 1.0), (np.array([4.0]), 9.0)], 32).tolist() == [1.5, 3.0]
    cuts = R.split_points([(np.arange(1000.0), 1.0), (np.arange(1000.0) + 9000, 3.0)], 8)
    assert len(cuts) == 7 and cuts[0] == pytest.approx(499.5, abs=1) and cuts[2:] - 9000 == pytest.approx(np.arange(1, 6) * 1000 / 6, abs=2)


def test_forest_of_many_rows_is_as_mllibs_and_goes_through_them_no_more_than_once(spark, monkeypatch):
    df = table(spark)
    with monkeypatch.context() as m:
        m.setattr(L, "COUNTED_ROWS", 10**9)
        old = L.train_lithology(df, ["a", "b", "c"], trees=30, depth=8, min_leaf=10)
        old_rows = L.predict_lithology(old, df, None).toPandas().sort_values("depth")
    monkeypatch.setattr(L, "COUNTED_ROWS", 100)
    monkeypatch.setattr(L, "Pipeline", None)  # no pass of MLlib over the rows
    new = L.train_lithology(df, ["a", "b", "c"], trees=30, depth=8, min_leaf=10)
    assert isinstance(new.model, R.Forest) and len(new.model.trees) == 30
    out = L.predict_lithology(new, df, None).toPandas().sort_values("depth")
    assert (out["lithology_code"].to_numpy() == old_rows["lithology_code"].to_numpy()).mean() > 0.97
    assert abs(out["probability"].to_numpy() - old_rows["probability"].to_numpy()).mean() < 0.03
    right = lambda o: (o["lithology_code"] == o["actual_code"]).mean()
    assert right(out) > right(old_rows) - 0.01
    again = L.predict_lithology(L.train_lithology(df.repartition(3), ["a", "b", "c"], trees=30, depth=8, min_leaf=10), df, None).toPandas().sort_values("depth")
    assert (again["probability"].to_numpy() == out["probability"].to_numpy()).all()
    x = C.binned(np.array([[0.1, 0.2, 0.3, 0.0], [2.0, -1.0, 0.0, 1.0]]), new.model.edges)
    one = L.LithologyModel.transform(new, spark.createDataFrame([(0.1, 0.2, 0.3), (2.0, -1.0, None)], "a double, b double, c double")).collect()
    assert one[0]["probability"] == round(float(new.model.probabilities(x)[0].max()), 4)
    monkeypatch.setattr(R, "FOREST_CELLS", 3)
    with pytest.raises(TypeError):  # left to MLlib
        L.train_lithology(df, ["a", "b", "c"], trees=2)
