import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borelight.operators import quantiles as Q
from borelight.operators import skew as K
from borelight.operators import windows as W
from borelight.plans import builds as B
from borelight.plans import similarity as M


@pytest.fixture(scope="module")
def depth_pdf():
    rng = np.random.default_rng(3)
    n = 3000
    # one well holds most rows; depths are far from evenly spread
    pdf = pd.DataFrame({"well": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)), "depth": np.round(rng.gamma(1.5, 400, n), 3)})
    pdf["c"] = np.where(rng.random(n) < 0.15, np.nan, rng.normal(50, 9, n))
    pdf = pdf.drop_duplicates(["well", "depth"]).sort_values(["well", "depth"]).reset_index(drop=True)
    return pdf


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@pytest.mark.parametrize("max_rows", [5_000_000, 150, 40])
@pytest.mark.parametrize("window", [4.0, 5.0, 12.0])
def test_rolling_depth_equals_pandas(spark, depth_pdf, max_rows, window):
    if (window, max_rows) not in {(4.0, 5_000_000), (5.0, 150), (12.0, 40), (4.0, 40)}:
        pytest.skip("pairs chosen to cover odd and even windows on both plans")
    out = W.rolling_depth_stats(to_spark(spark, depth_pdf), ["c"], 1.0, (window,), gradient=True, max_rows=max_rows)
    got = out.toPandas().sort_values(["well", "depth"]).reset_index(drop=True)
    g = depth_pdf.groupby("well", sort=False)
    n = int(window)
    want_m = g["c"].rolling(n, min_periods=2, center=True).mean().reset_index(level=0, drop=True)
    want_s = g["c"].rolling(n, min_periods=2, center=True).std().reset_index(level=0, drop=True)
    np.testing.assert_allclose(got[f"c_roll{window:g}m_mean"], want_m, rtol=1e-9)
    np.testing.assert_allclose(got[f"c_roll{window:g}m_std"], want_s, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(got["c_grad"], g["c"].diff() / g["depth"].diff(), rtol=1e-9)
    assert len(got) == len(depth_pdf)


def test_split_really_splits(spark, depth_pdf):
    fr = K.framed(to_spark(spark, depth_pdf), ["well"], "depth", before=3, after=2, max_rows=100)
    sizes = fr.df.groupBy("well", "_chunk").count().toPandas()
    assert fr.split and sizes["count"].max() < 400 and len(sizes) > 8
    assert fr.df.where("not _halo").count() == len(depth_pdf)


@pytest.mark.parametrize("max_rows", [5_000_000, 60])
def test_rolling_time_equals_pandas(spark, max_rows):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"well_name": rng.choice(["hot", "hot", "hot", "x"], 900), "timestamp": pd.date_range("2024-01-01", periods=900, freq="7s")})
    pdf["v"] = np.where(rng.random(900) < 0.2, np.nan, rng.normal(size=900))
    pdf = pdf.sort_values(["well_name", "timestamp"]).reset_index(drop=True)
    out = W.rolling_time_stats(to_spark(spark, pdf), ["v"], {"s": 6, "l": 40}, max_rows=max_rows)
    got = out.toPandas().sort_values(["well_name", "timestamp"]).reset_index(drop=True)
    g = pdf.groupby("well_name", sort=False)["v"]
    for name, n in (("s", 6), ("l", 40)):
        np.testing.assert_allclose(got[f"v_{name}_mean"], g.rolling(n, min_periods=2).mean().reset_index(level=0, drop=True), rtol=1e-8, atol=1e-12)
        np.testing.assert_allclose(got[f"v_{name}_std"], g.rolling(n, min_periods=2).std().reset_index(level=0, drop=True), rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(got[f"v_{name}_slope"], g.diff(n) / n, rtol=1e-9)
    np.testing.assert_allclose(got["v_rate"], g.diff(), rtol=1e-9)
    assert len(W.time_feature_names([f"c{i}" for i in range(11)])) == 121


@pytest.mark.parametrize("max_rows", [5_000_000, 50])
def test_runs_equal_loop(spark, max_rows):
    rng = np.random.default_rng(6)
    n = 1200
    pdf = pd.DataFrame({"well": rng.choice(["hot", "hot", "hot", "b"], n), "depth": rng.permutation(n) * 1.5})
    pdf = pdf.sort_values(["well", "depth"]).reset_index(drop=True)
    pdf["group_name"] = rng.choice(["G", "H", None], n, p=[0.8, 0.1, 0.1])
    pdf["formation_name"] = [None if g is None and rng.random() < 0.7 else f for g, f in zip(pdf["group_name"], rng.choice(["F", None], n, p=[0.9, 0.1]))]
    want = []
    for well, block in pdf.groupby("well"):
        prev = object()
        for d, g, f in zip(block["depth"], block["group_name"], block["formation_name"]):
            if g is None and f is None:
                continue
            if (g, f) != prev:
                want.append([well, g, f, d, d, 0])
                prev = (g, f)
            want[-1][4], want[-1][5] = d, want[-1][5] + 1
    schema = "well string, depth double, group_name string, formation_name string"
    df = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in pdf.itertuples(index=False)], schema)
    got = W.formation_runs(df, max_rows=max_rows)
    key = lambda r: (r[0], r[3])
    assert sorted([list(r) for r in got.collect()], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("max_rows", [10_000_000, 100])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_equal_numpy(spark, max_rows, keys):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": np.where(rng.random(2500) < 0.8, "hot", "x"), "v": rng.lognormal(2, 2, 2500), "u": rng.integers(0, 4, 2500).astype(float), "none": np.nan})
    pdf.loc[::9, "v"] = np.nan
    probs = [0.0, 0.02, 0.5, 0.9, 1.0]
    got = Q.group_quantiles(to_spark(spark, pdf), keys, ["v", "u", "none"], probs, max_rows).collect()
    for r in got:
        part = pdf[pdf["k"] == r["k"]] if keys else pdf
        for c in ("v", "u"):
            np.testing.assert_allclose(r[c], np.quantile(part[c].dropna(), probs), rtol=1e-12)
        assert r["none"] is None or all(x is None for x in r["none"])
    assert len(got) == (2 if keys else 1)


@pytest.mark.parametrize("cells", [256, 3])
def test_quantiles_of_many_columns(spark, monkeypatch, cells):
    """Signs, zeros, infinities, equal and tiny values; more wanted cells than a scan holds."""
    monkeypatch.setattr(Q, "CELLS", cells)
    rng = np.random.default_rng(9)
    n = 1500
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": np.repeat(7.25, n), "c": rng.choice([-0.0, 0.0, -1.0, np.nan], n), "d": 1 + rng.random(n) * 1e-13, "e": rng.normal(size=n) * 1e-310,
        "f": np.where(rng.random(n) < 0.01, np.inf, rng.normal(size=n)), "g": np.nan, "h": rng.integers(-5, 5, n).astype(float),
    })
    probs = [0.0, 0.3, 0.5, 0.98]
    got = Q.column_quantiles(to_spark(spark, pdf).repartition(5), list(pdf.columns), probs)
    assert got["g"] is None
    for c in pdf.columns.drop("g"):
        np.testing.assert_allclose(got[c], np.quantile(pdf[c].dropna(), probs), rtol=1e-14, atol=1e-320)
    one = Q.group_quantiles(to_spark(spark, pdf), [], ["a", "g"], [0.5], max_rows=100).first()
    assert one["a"] == [np.median(pdf["a"])] and one["g"] is None


def test_resample_equals_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"well_name": "w", "timestamp": pd.Timestamp("2024-01-01 00:00:03") + pd.to_timedelta(np.sort(rng.uniform(0, 600, 200)), unit="s"), "v": rng.normal(size=200)})
    pdf.loc[50:90, "v"] = np.nan
    got = W.resample(to_spark(spark, pdf), ["v"]).toPandas().sort_values("timestamp").reset_index(drop=True)
    want = pdf.set_index("timestamp")[["v"]].resample("10s").mean().dropna(how="all").reset_index()
    np.testing.assert_allclose(got["v"], want["v"], rtol=1e-9)
    assert list(got["timestamp"]) == list(want["timestamp"])


def test_rig_state_handles_gaps(spark):
    rows = [("w", 0, 100.0, 150.0, None), ("w", 60, 101.0, 50.0, 6.0), ("w", 60, 102.0, None, 5.0), ("w", 120, 102.1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "well_name string, s long, bit_depth_m double, flow_in_lpm double, bit_rpm double").withColumn("timestamp", F.timestamp_seconds("s"))
    got = W.rig_state(df, ties=["bit_depth_m"]).orderBy("s", "bit_depth_m").collect()
    assert [r["trip_speed_m_per_min"] for r in got][:3] == [None, 1.0, None]
    assert got[3]["trip_speed_m_per_min"] == pytest.approx(0.1)
    assert [r["circulating"] for r in got] == [True, False, False, False]
    assert [r["rotating"] for r in got] == [False, True, False, False]
    assert [r["tripping"] for r in got] == [False, True, False, False]
    assert [r["operations_active"] for r in got] == [True, True, False, False]


def test_segments_equal_loop(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"well": rng.choice(["a", "b"], 700), "depth": np.round(rng.uniform(1000, 1800, 700), 2)}).drop_duplicates()
    want = []
    for well, block in pdf.groupby("well"):
        d = np.sort(block["depth"].to_numpy())
        top, k = d.min(), 0
        while top < d.max():
            inside = d[(d >= top) & (d < top + 100)]
            if len(inside) >= 30:
                want.append((well, k, inside.min(), inside.max(), len(inside)))
            top, k = d.min() + (k + 1) * 50.0, k + 1
    got = W.depth_segments(spark.createDataFrame(pdf), min_samples=30)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_segment_vectors_fill_and_clip(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"well": "a", "depth": np.arange(0, 400, 1.0), "c": rng.normal(size=400), "flat": 3.0, "none": np.nan})
    out = M.segment_vectors(to_spark(spark, pdf), ["c", "flat", "none"], min_samples=30).collect()
    assert all(len(r["embedding"]) == 11 for r in out)
    assert all(r["embedding"][i] == 0 for r in out for i in (3, 5)) and all(abs(x) <= 5 for r in out for x in r["embedding"] if x is not None)


def test_replay_and_rank(spark):
    df = spark.range(50).select(F.lit(1).alias("well_id"), F.timestamp_seconds(F.col("id") * 7200).alias("recorded_at"))
    got = W.replay_timeline(df, 3600.0, 10).orderBy("index").collect()
    assert len(got) == 40 and got[0]["emit_offset_s"] == 0 and got[1]["emit_offset_s"] == pytest.approx(0.01) and got[-1]["is_last"]
    assert W.replay_timeline(df, 0.0, 999).count() == 1
    ranks = K.global_rank(spark.range(500).select(F.col("id").alias("w")), ["w"], "r", 8).toPandas()
    assert sorted(ranks["r"]) == list(range(1, 501))


def test_prepare_logs(spark, depth_pdf):
    df = to_spark(spark, depth_pdf.assign(bad=np.nan, lith=(depth_pdf["depth"] % 3).round()))
    got = B.prepare_logs(df, "well", "depth", target="lith", windows_m=(5.0,))
    assert got.curves == ["c"] and got.rejected == ["bad"]
    assert got.features.count() == len(depth_pdf)
    assert {"c_roll5m_mean", "c_roll5m_std", "c_grad", "split"} <= set(got.features.columns)


def test_rows_of_a_window_task_are_bounded(spark, monkeypatch):
    """A larger table gets more tasks, not larger ones; a small table is left as it is."""
    from borelight.operators import skew

    df = spark.range(4000).select((F.col("id") % 97).alias("well"), F.col("id").cast("double").alias("depth"), F.lit("g").alias("group_name"), (F.col("id") % 5).cast("string").alias("formation_name"))
    plain = W.formation_runs(df)
    monkeypatch.setattr(skew, "TASK_ROWS", 200)
    assert skew.framed(df, ["well"], "depth", 1).df.rdd.getNumPartitions() == 20
    assert sorted(map(repr, W.formation_runs(df).collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("max_rows", [5_000_000, 90])
def test_sliding_frames_equal_sparks(spark, max_rows):
    """Frames longer than a batch and than a well, unknown values, NaN, null wells and depths, repeated rows, whole numbers and decimals: as Spark's own frames, bit for bit."""
    from pyspark.sql import Window

    rows = [(None if i % 41 == 0 else f"w{i % 5 % 3}", None if i % 37 == 0 else float(i * 7919 % 2003), i, None if i % 6 == 0 else float("nan") if i % 97 == 0 else (i * 31 % 101) / 7, i % 9) for i in range(700)]
    df = spark.createDataFrame(rows + rows[:30], "well string, depth double, id int, x double, k int").withColumn("e", F.col("k").cast("decimal(9,2)"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = W.rolling_depth_stats(df, ["x", "k", "e"], 1.0, (4.0, 300.0), ties=["id"], gradient=True, max_rows=max_rows)
        base, cols = Window.partitionBy("well").orderBy("depth", "id"), []
        for w, lo, hi in (("4", -2, 1), ("300", -150, 149)):
            for c in ("x", "k", "e"):
                over = base.rowsBetween(lo, hi)
                enough = F.count(c).over(over) >= 2
                cols += [F.when(enough, F.avg(c).over(over)).alias(f"{c}_roll{w}m_mean"), F.when(enough, F.stddev_samp(c).over(over)).alias(f"{c}_roll{w}m_std")]
        want = df.select("*", *cols)
        assert got.columns == [*want.columns, "x_grad", "k_grad", "e_grad"]
        assert [t for _, t in got.dtypes[: len(want.columns)]] == [t for _, t in want.dtypes]
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert "MapInArrow" in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sliding_frames_do_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    from borelight.operators import sliding

    rng = np.random.default_rng(21)
    rn = np.concatenate([np.arange(1, n + 1) for n in (1, 70, 3, 200, 2)])
    t = pa.table({"x": pa.array(rng.normal(size=len(rn)), mask=rng.random(len(rn)) < 0.2), "_rn": rn})
    frames = {"a": ("x", -3, 4), "b": ("x", -60, 0), "c": ("x", 2, 5)}
    whole = pa.Table.from_batches(sliding.rolled_batches(t.to_batches(), frames))
    monkeypatch.setattr(sliding, "LEAST", 1)
    parts = list(sliding.rolled_batches(t.to_batches(max_chunksize=7), frames))
    assert len(parts) > 3 and pa.Table.from_batches(parts).equals(whole) and whole.num_rows == len(rn)
    s = pd.Series(t["x"].to_numpy()[71 + 3 :][:200])
    want = s.rolling(61, min_periods=2).mean()
    np.testing.assert_allclose(whole["b_mean"].to_numpy()[74:274], want, rtol=1e-12)
