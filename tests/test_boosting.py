"""Boosted softmax trees against plain counts, the stop rule, and folds that grow together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from borelight.plans import boosting as B
from borelight.plans import lithology as L


def table(spark, n=1500, seed=1, wells=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] + 0.3 * r.normal(size=n) > 0, 1, 0))
    unknown = r.random(n) < 0.1
    rows = [(int(r.integers(0, wells)), *[None if unknown[i] and k == 2 else float(v) for k, v in enumerate(x[i])], int(y[i]) * 10) for i in range(n)]
    return spark.createDataFrame(rows, "well int, a double, b double, c double, lithology int").repartition(4)


def test_first_split_is_the_best_of_all(spark):
    """Gradients, hessians and gain of the root, counted one by one over every cut of every feature."""
    df = table(spark, 300)
    rows = df.withColumn("_label", F.col("lithology") / 10).withColumn("_label", F.col("_label").cast("int")).withColumn("_roles", F.array(F.lit(B.FIT)))
    m = B.fit_boosted(rows, ["a", "b", "c"], 3, rounds=1, depth=1, subsample=1.0, share_of_features=1.0, least=1.0)[0]
    data = rows.select("a", "b", "c", "_label").toPandas()
    x, y = data[["a", "b", "c"]].to_numpy(float), data["_label"].to_numpy()
    bins = B.binned(x, m.edges)
    w = np.array([len(y) / (3 * (y == k).sum()) for k in range(3)])[y]
    for k in range(3):
        g, h = w * (1 / 3 - (y == k)), w * 2 * (1 / 3) * (2 / 3)
        best = -np.inf
        for f in range(3):
            for cut in range(1, len(m.edges[f]) + 1):
                for unknown_left in (True, False):
                    left = np.where(bins[:, f] == 0, unknown_left, bins[:, f] <= cut)
                    if h[left].sum() >= 1 and h[~left].sum() >= 1:
                        best = max(best, sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)))
        t = m.rounds[0][k]
        leaf = t.leaf_of(bins)
        got = sum(g[leaf == i].sum() ** 2 / (h[leaf == i].sum() + 1) for i in (1, 2))
        assert got == pytest.approx(best)
        for i in (1, 2):
            assert t.value[i] == pytest.approx(-0.05 * g[leaf == i].sum() / (h[leaf == i].sum() + 1))


def test_stops_on_macro_f1_and_keeps_the_best(spark):
    df = table(spark)
    watch = df.where("well < 3").unionByName(spark.createDataFrame([(0, 0.0, 0.0, 0.0, 990)], df.schema))
    m = L.train_lithology(df.where("well >= 3"), ["a", "b", "c"], "boosted", validation=watch, rounds=40, patience=4, boosted_depth=3)
    b = m.model
    assert m.excluded == 1 and b.best == int(np.argmax(b.scores)) + 1 and len(b.scores) <= min(40, b.best + 4)
    out = m.transform(watch.where("lithology < 990")).toPandas()
    confusion = np.zeros((3, 3))
    np.add.at(confusion, (out["lithology"] // 10, out["lithology_code"] // 10), 1)
    assert B.macro_f1(confusion) == pytest.approx(max(b.scores), abs=1e-6) and max(b.scores) > 0.8


def test_margins_written_on_the_way_change_nothing(spark, monkeypatch):
    df = table(spark, 400)
    fits = []
    for every, direct in ((1, 0), (100, 64)):
        monkeypatch.setattr(B, "WRITE_EVERY", every)
        monkeypatch.setattr(B, "DIRECT", direct)
        fits.append(L.train_lithology(df, ["a", "b", "c"], "boosted", rounds=5, boosted_depth=3).model)
    for one, two in zip(fits[0].rounds, fits[1].rounds, strict=True):
        for s, t in zip(one, two, strict=True):
            assert (s.feature == t.feature).all() and np.allclose(s.value, t.value, atol=1e-5)


def test_no_pass_repeats_the_trees_of_earlier_rounds(spark, monkeypatch):
    """Margins are up to date in every pass, and rows come to the leaves that their bins say."""
    seen, passed = [], B.passed
    monkeypatch.setattr(B, "passed", lambda blocks, job, *rest: (seen.append(len(job.recent)), passed(blocks, job, *rest))[1])
    m = L.train_lithology(table(spark, 400), ["a", "b", "c"], "boosted", rounds=4, boosted_depth=3).model
    assert len(seen) >= 12 and set(seen) == {0}
    bins = np.random.default_rng(1).integers(0, 65, (500, 3)).astype(np.uint8)
    for t in m.rounds[-1]:
        for row, leaf in zip(bins, t.leaf_of(bins), strict=True):
            at = 0
            while t.feature[at] >= 0:
                b = row[t.feature[at]]
                at = 2 * at + 1 + int(not t.unknown_left[at] if b == 0 else b > t.cut[at])
            assert at == leaf


def test_folds_grow_together_as_they_would_alone(spark):
    df = table(spark, 600)
    roles = L.fold_roles(L.group_folds(df, 3), 3, 0.2)
    rows = df.join(roles, "well").withColumn("_label", (F.col("lithology") / 10).cast("int"))
    together = B.fit_boosted(rows, ["a", "b", "c"], 3, 3, rounds=6, depth=3, subsample=1.0, patience=3)
    for m in range(3):
        alone = B.fit_boosted(rows.withColumn("_roles", F.slice("_roles", m + 1, 1)), ["a", "b", "c"], 3, 1, rounds=6, depth=3, subsample=1.0, patience=3)[0]
        assert alone.scores == pytest.approx(together[m].scores) and alone.best == together[m].best
    got = {r["well"]: r for r in roles.collect()}
    for r in got.values():
        assert r["_roles"][r["fold"]] == B.UNUSED and sum(x == B.UNUSED for x in r["_roles"]) == 1
    assert all(any(r["_roles"][m] == B.WATCH for r in got.values()) for m in range(3))


def test_rows_without_labels_or_values(spark):
    df = table(spark, 200).unionByName(spark.createDataFrame([(1, None, None, None, None)] * 5, "well int, a double, b double, c double, lithology int"))
    m = L.train_lithology(df, ["a", "b", "c"], "boosted", rounds=3, boosted_depth=2)
    assert m.transform(df.select("a", "b", "c")).where("lithology_code is null").count() == 0
    one = L.train_lithology(df.where("lithology = 10"), ["a", "b", "c"], "boosted", rounds=2)
    assert {r["lithology_code"] for r in one.transform(df).collect()} == {10}


def test_cross_validation_of_both_kinds(spark):
    got = L.cross_validate(table(spark, 900), ["a", "b", "c"], ["random_forest", "boosted"], 3, rounds=15, patience=5, boosted_depth=3, trees=5, depth=5).collect()
    assert sorted((r["model"], r["fold"]) for r in got) == [(k, f) for k in ("boosted", "random_forest") for f in range(3)]
    assert all(r["macro_f1"] > 0.7 and r["fit_seconds"] > 0 for r in got)
