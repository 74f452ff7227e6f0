import inspect
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borelight.operators import metrics as M
from borelight.operators.profile import assert_disjoint, exclusion_reasons
from borelight.plans import anomaly as A
from borelight.plans import lithology as L


def wells(spark, n=30, rows=100):
    return spark.range(n * rows).select(
        F.format_string("W%d", F.floor(F.col("id") / rows).cast("int")).alias("well"), (F.col("id") % rows).cast("double").alias("depth"),
        F.when(F.floor(F.col("id") / rows) < 4, F.lit(90000)).when(F.col("id") % 3 == 0, 65000).when(F.col("id") % 3 == 1, 30000).otherwise(65030).alias("lithology"),
    )


def test_splits_hold_whole_wells(spark):
    s = L.well_splits(wells(spark)).toPandas()
    assert len(s) == 30 and s["well"].is_unique
    assert s["split"].value_counts().to_dict() == {"train": 22, "validation": 4, "test": 4}
    rare = s[s["well"].isin(["W0", "W1", "W2", "W3"])]
    assert set(rare["split"]) == {"train", "validation", "test"}
    assert L.well_splits(wells(spark)).toPandas().sort_values("well")["split"].tolist() == s.sort_values("well")["split"].tolist()


def test_fractions_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1.0"):
        L.well_splits(wells(spark, 2), fractions={"train": 0.5, "validation": 0.3, "test": 0.3})


def test_folds(spark):
    df = wells(spark, 12, 20)
    folds = L.group_folds(df, 4)
    rows = df.join(folds, "well")
    assert sorted(r["count"] for r in rows.groupBy("fold").count().collect()) == [60, 60, 60, 60]
    for k in range(4):
        assert_disjoint(rows.where(F.col("fold") == k), rows.where(F.col("fold") != k), ["well"])
    with pytest.raises(ValueError, match="test"):
        L.group_folds(df, 4, use_splits=("train", "test"))
    with pytest.raises(ValueError):
        assert_disjoint(rows, rows, ["well"])
    uneven = spark.createDataFrame([(w, i) for w in range(9) for i in range(10 - w)], "well int, x int")
    assert [r["fold"] for r in L.group_folds(uneven, 3).orderBy("well").collect()] == [0, 1, 2, 2, 1, 0, 0, 1, 2]


def _greedy(sizes, k):
    load, out = [0] * k, []
    for n in sizes:
        i = load.index(min(load))
        load[i] += n
        out.append(i)
    return out


def test_folds_dealt_in_bulk_are_the_greedy_ones(spark):
    rng = np.random.default_rng(2)
    for _ in range(300):
        k = int(rng.integers(1, 7))
        sizes = sorted(rng.integers(1, rng.integers(2, 30), rng.integers(1, 60)).tolist(), reverse=True)
        classes = [(n, sizes.count(n)) for n in sorted(set(sizes), reverse=True)]
        got = [turn[(r - a) % len(turn)] for _, a, b, turn in L._dealt(classes, k) for r in range(a, b)]
        assert got == _greedy(sizes, k)
    wells = [(f"w{i:03d}" if i else None, n) for i, n in enumerate(rng.integers(1, 9, 50).tolist())]
    df = spark.createDataFrame([(w, i) for w, n in wells for i in range(n)], "well string, x int").repartition(3)
    order = sorted(wells, key=lambda w: (-w[1], w[0] is not None, w[0] or ""))
    want = dict(zip([w for w, _ in order], _greedy([n for _, n in order], 5), strict=True))
    assert {r["well"]: r["fold"] for r in L.group_folds(df, 5).collect()} == want
    assert L.group_folds(df.limit(0), 5).count() == 0


def test_early_stop_wells(spark):
    df = spark.range(20).select(F.col("id").alias("well"))
    assert L.early_stop_wells(df, 0.15).count() == 3 and L.early_stop_wells(df.limit(1), 0.15).count() == 1


def test_metrics(spark):
    base = spark.createDataFrame([(1,)] * 90 + [(2,)] * 10, "actual int")
    r = M.majority_baseline(base).first()
    assert r["accuracy"] == 0.9 and r["macro_f1"] < 0.5 and r["predicted_class"] == 1
    df = spark.createDataFrame([(1, 1)] * 100 + [(2, 1)] * 3, "actual int, predicted int")
    conf = M.confusion(df)
    rel = {r["code"]: r["reliable"] for r in M.per_class_metrics(conf, min_support=50).collect()}
    m = M.classification_metrics(conf).first()
    assert rel == {1: True, 2: False} and m["macro_f1"] < m["accuracy"]
    short = M.penalty_table(spark, [[0.0]], [1])
    assert M.penalty_score(conf, short).first()["penalty"] is None


SCORES = {"rf": [0.30, 0.34, 0.28, 0.36, 0.32], "xgb": [0.29, 0.35, 0.26, 0.33, 0.31]}


def frame(spark, scores):
    return spark.createDataFrame([(m, i, v) for m, vs in scores.items() for i, v in enumerate(vs)], "model string, fold int, macro_f1 double")


def test_comparison(spark):
    f = frame(spark, SCORES)
    ranks = {r["model"]: r["rank"] for r in M.fold_summary(f).collect()}
    c = M.compare_models(f, "rf", "xgb").first()
    assert ranks == {"rf": 1, "xgb": 2} and c["folds_won"] == 4 and c["folds_total"] == 5 and "anti-conservative" in c["caveat"]
    d = {r["fold"]: r["difference"] for r in M.fold_differences(f, "rf", "xgb").collect()}
    assert d[1] < 0
    diff = np.array(SCORES["rf"]) - np.array(SCORES["xgb"])
    t = diff.mean() / (diff.std(ddof=1) / 5**0.5)
    assert c["paired_t_statistic"] == pytest.approx(t, abs=1e-4)
    assert M.t_test_p(2.776445, 4) == pytest.approx(0.05, abs=1e-5) and M.t_test_p(3.182446, 3) == pytest.approx(0.05, abs=1e-5)


def summary(spark, a, b, std):
    return spark.createDataFrame([("xgb", 5, a, std[0], 1), ("random_forest", 5, b, std[1], 2)], "model string, folds int, macro_f1_mean double, macro_f1_std double, rank int")


def test_verdict(spark):
    gap = lambda d: spark.createDataFrame([(d,)], "mean_difference double")
    close = M.cv_verdict(summary(spark, 0.3840, 0.3667, (0.0543, 0.0462)), gap(0.0173), "random_forest", 0.2241).first()
    assert not close["separable"] and close["selected_model"] == "random_forest" and "0.2241" in close["conclusion"]
    far = M.cv_verdict(summary(spark, 0.50, 0.30, (0.01, 0.01)), gap(0.20), "random_forest").first()
    assert far["separable"] and "disagrees with the single-split selection" in far["conclusion"]
    same = M.cv_verdict(summary(spark, 0.50, 0.30, (0.01, 0.01)), gap(0.20), "xgb").first()
    assert "agrees" in same["conclusion"]


def test_reasons(spark):
    df = spark.createDataFrame([("denied_by_report",), ("denied_by_report",), ("routine:leak off",)], "reason string")
    assert [tuple(r) for r in exclusion_reasons(df).collect()] == [("denied_by_report", 2), ("routine:leak off", 1)]


def test_impute_uses_the_fit(spark):
    train = spark.createDataFrame([(1.0, 1.0), (3.0, None), (5.0, 3.0)], "a double, b double")
    _, names, fitted = L.impute_with_indicators(train, ["a", "b"])
    new, again, _ = L.impute_with_indicators(spark.createDataFrame([(None, None)], "a double, b double"), ["a", "b"], fitted)
    r = new.first()
    assert names == again == ["a", "b", "b_missing"] and (r["a"], r["b"], r["b_missing"]) == (3.0, 2.0, 1.0)


@pytest.fixture(scope="module")
def forest_rows(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(4000, 3))
    x[:40] += 6
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(4000))
    pdf.loc[100:120, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.select("id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])


def test_isolation_forest(spark, forest_rows):
    f = A.fit_isolation_forest(forest_rows, ["a", "b", "c"], ["id"], trees=60, max_rows=500)
    assert len(f.nodes) == 60 and all(len(t) <= 2 * 256 - 1 for t in f.nodes)
    s = A.score_isolation_forest(forest_rows, f).toPandas()
    assert s["anomaly_score"].between(0, 1).all() and s["anomaly_score"].min() == 0 and s["anomaly_score"].max() == 1
    assert abs(s["is_anomaly"].mean() - 0.02) < 0.002
    assert s.loc[s["id"] < 40, "is_anomaly"].mean() > 0.8
    again = A.score_isolation_forest(forest_rows.repartition(7), A.fit_isolation_forest(forest_rows.repartition(5), ["a", "b", "c"], ["id"], trees=60)).toPandas()
    m = s.merge(again, on="id")
    np.testing.assert_allclose(m["raw_score_x"], m["raw_score_y"], atol=1e-9)
    stored = A.score_isolation_forest(forest_rows, f, stored_range=True).toPandas()
    np.testing.assert_allclose(stored.sort_values("id")["anomaly_score"], s.sort_values("id")["anomaly_score"], atol=1e-9)
    with pytest.raises(ValueError, match="90 are required"):
        A.fit_isolation_forest(forest_rows.limit(20), ["a"], ["id"])


def test_attribution(spark, forest_rows):
    df = forest_rows.withColumn("flat", F.lit(1.0))
    rows = A.deviation_attribution(df, ["a", "b", "c", "flat"], 2, max_rows=700).collect()
    pdf = forest_rows.toPandas().set_index("id")
    dev = ((pdf - pdf.median()) / pdf.std()).abs()
    for r in rows[:60]:
        want = dev.loc[r["id"]].dropna().sort_values(ascending=False)[:2]
        assert [c["feature"] for c in r["contributing_features"]] == list(want.index)
        assert [c["contribution"] for c in r["contributing_features"]] == pytest.approx(want.round(3).tolist(), abs=1e-3)


def test_lithology_models(spark):
    df = spark.range(1200).select(
        F.format_string("W%d", (F.col("id") % 12).cast("int")).alias("well"), (F.col("id") * 0.5).alias("depth"), (F.col("id") % 7 * 1.0).alias("x"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7 * 2.0).alias("y"), F.when(F.col("id") % 7 < 3, 30000).otherwise(65000).alias("lithology"),
    )
    m = L.train_lithology(df, ["x", "y"], trees=5, depth=4, min_leaf=2)
    p = L.predict_lithology(m, df, 5.0)
    assert p.where("lithology_code <> actual_code").count() == 0 and p.count() == 120
    assert p.first()["lithology_name"] in ("Sandstone", "Shale") and p.agg(F.max("probability")).first()[0] <= 1
    stop = df.where("well = 'W0'").withColumn("lithology", F.when(F.col("depth") < 18, 12345).otherwise(F.col("lithology")))
    b = L.train_lithology(df.where("well <> 'W0'"), ["x"], "boosted", validation=stop, depth=2, rounds=3)
    assert b.excluded == 3 and L.evaluate(b, df.where("well = 'W0'")).first()["accuracy"] == 1.0


class Called(Exception):
    pass


def test_forest_rows_are_dealt_however_few_tasks_read_them(spark, monkeypatch):
    class Fitted:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            raise Called(rows)

    monkeypatch.setattr(L, "Pipeline", Fitted)
    monkeypatch.setattr(L, "FOREST_ROWS", 100)
    df = spark.range(0, 1000, 1, 1).selectExpr("'W' || id % 7 AS well", "CAST(id AS double) AS x", "IF(id % 3 = 0, 30000, 65000) AS lithology")
    with pytest.raises(Called) as got:
        L.train_lithology(df, ["x"])
    tasks = [len(t) for t in got.value.args[0].rdd.glom().collect()]
    assert len(tasks) == 10 and sum(tasks) == 1000 and max(tasks) <= 110
    monkeypatch.setattr(L, "FOREST_ROWS", 100_000)
    with pytest.raises(Called) as got:
        L.train_lithology(df, ["x"])
    assert got.value.args[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(
    "name, operator, kinds",
    [
        ("isolation_forest", "anomaly.fit_isolation_forest", None), ("score_anomalies", "anomaly.score_anomalies", None),
        ("stream_score", "anomaly.fit_isolation_forest", None), ("train_and_predict_lithology", "lithology.train_lithology", None),
        ("train_boosted_lithology", "lithology.train_lithology", None),
        ("cross_validate", "lithology.cross_validate", ["random_forest", "boosted"]),
    ],
)
@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not there")
def test_model_queries_run_whole_forms(spark, monkeypatch, name, operator, kinds):
    import importlib

    import __spark_entry__ as entry

    module, function = operator.split(".")
    plan = importlib.import_module(f"borelight.plans.{module}")
    real = inspect.signature(getattr(plan, function))

    def seen(*args, **options):
        raise Called(real.bind(*args, **options).arguments)

    monkeypatch.setattr(plan, function, seen)
    with pytest.raises(Called) as got:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    given = got.value.args[0]
    cut = {"trees", "depth", "rounds", "k", "windows", "min_leaf", "samples"}
    assert not cut & (given.keys() | given.get("model_options", {}).keys() | given.get("fit_options", {}).keys())
    assert len(given.get("features") or given.get("channels")) == (3 if module == "anomaly" else 4)
    assert kinds is None or given["kinds"] == kinds
