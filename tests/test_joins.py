import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from borelight.operators import joins as J


def us(sec):
    return pd.to_datetime(sec, unit="s")


@pytest.mark.parametrize("ties", [False, True])
def test_asof_equals_pandas(spark, ties):
    rng = np.random.default_rng(11 + ties)
    grid = (lambda n, o: np.sort(rng.choice(4000, n, replace=False)) * 20 + o) if ties else (lambda n, o: np.sort(rng.choice(80000, n, replace=False)))
    t = pd.DataFrame({"well_name": rng.choice(["a", "a", "a", "b"], 400), "timestamp": us(grid(400, 0)), "bit_depth_m": rng.normal(2000, 50, 400), "hole_depth_m": 2500.0})
    t.loc[::7, "bit_depth_m"] = np.nan
    m = pd.DataFrame({"well_name": rng.choice(["a", "b", "c"], 300), "recorded_at": us(grid(300, 10)), "id": range(300)})
    ts = spark.createDataFrame(t)
    ts = ts.withColumn("bit_depth_m", F.when(~F.isnan("bit_depth_m"), F.col("bit_depth_m")))
    got = J.recover_depths(spark.createDataFrame(m), ts, tolerance_s=600, piece_s=3000).toPandas().sort_values("id")
    t = t.assign(d=t["bit_depth_m"].fillna(t["hole_depth_m"]))
    want = pd.merge_asof(
        m.sort_values("recorded_at"), t[["well_name", "timestamp", "d"]].sort_values("timestamp"), left_on="recorded_at", right_on="timestamp", by="well_name",
        direction="nearest", tolerance=pd.Timedelta("10min"),
    ).sort_values("id")
    np.testing.assert_allclose(got["depth_m"].to_numpy(float), want["d"].to_numpy(float))
    assert set(got.loc[got["depth_m"].isna(), "depth_source"]) <= {"unresolved"}


@pytest.mark.parametrize("width", [3.0, 50.0, 5000.0])
def test_nearest_without_limit(spark, width):
    rng = np.random.default_rng(12)
    ref = pd.DataFrame({"w": rng.choice(["hot", "hot", "b"], 300), "d": rng.integers(0, 400, 300) * 5.0, "at": rng.permutation(300), "x": range(300)})
    q = pd.DataFrame({"w": rng.choice(["hot", "b", "none"], 200), "qd": rng.integers(-100, 900, 200) * 2.5, "id": range(200)})
    want = {}
    for r in q.itertuples():
        c = ref[ref["w"] == r.w]
        if len(c):
            c = c.assign(gap=(c["d"] - r.qd).abs()).sort_values(["gap", "at"], ascending=[True, False])
            want[r.id] = (c["x"].iloc[0], c["gap"].iloc[0])
    out = J.nearest_join(spark.createDataFrame(q), spark.createDataFrame(ref), ["w"], "qd", "d", ["x"], width, prefer=F.col("at").cast("double"))
    got = {r["id"]: (r["x"], r["gap"]) for r in out.collect()}
    assert len(got) == 200
    assert {k: v for k, v in got.items() if v[0] is not None} == want


def test_latest_row_without_depth(spark):
    t = spark.createDataFrame([(1, 1, 10.0), (1, 2, 50.0), (1, 3, None)], "well_id int, s long, bit_depth_m double").withColumn("recorded_at", F.timestamp_seconds("s"))
    q = spark.createDataFrame([(1, 1, None), (2, 1, 12.0), (3, 2, 5.0)], "query_id int, well_id int, depth_m double")
    got = {r["query_id"]: r["s"] for r in J.telemetry_near_depth(q, t, ["s"]).collect()}
    assert got == {1: 3, 2: 1, 3: None}


def test_touching_intervals(spark):
    iv = spark.createDataFrame([(1, "G", "upper", 0.0, 100.0), (1, "G", "lower", 100.0, 250.0), (1, "G", None, 240.0, 300.0)], "well_id int, group_name string, formation_name string, depth_top_m double, depth_base_m double")
    q = spark.createDataFrame([(1, 1, 100.0), (2, 1, 245.0), (3, 1, 290.0), (4, 1, 301.0), (5, 1, None)], "query_id int, well_id int, depth_m double")
    got = {r["query_id"]: r["formation_name"] for r in J.formation_at(q, iv, width=30.0).collect()}
    assert got == {1: "upper", 2: "lower", 3: None, 4: None, 5: None}


def test_overlap_pairs_once(spark):
    rng = np.random.default_rng(13)
    a = pd.DataFrame({"k": 1, "i": range(80), "lo": rng.uniform(0, 900, 80)}).assign(hi=lambda d: d["lo"] + rng.uniform(0, 200, 80))
    b = pd.DataFrame({"k": 1, "j": range(80), "top": rng.uniform(-50, 900, 80)}).assign(base=lambda d: d["top"] + rng.uniform(0, 300, 80))
    want = sorted((x.i, y.j) for x in a.itertuples() for y in b.itertuples() if y.base >= x.lo and y.top <= x.hi)
    got = J.overlap_join(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], "lo", "hi", "top", "base", 37.0)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


@pytest.mark.parametrize("radius", [30.0, 700.0])
def test_radius_near_poles_and_date_line(spark, radius):
    rng = np.random.default_rng(14)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(88.5, 90, 40), rng.uniform(50, 50.5, 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 190), rng.choice([-1, 1], 60) * rng.uniform(179.6, 180, 60)])
    pdf = pd.DataFrame({"well_id": range(250), "latitude": lat, "longitude": lon})
    w = spark.createDataFrame(pdf)
    q = w.select(F.col("well_id").alias("query_id"), F.col("well_id").alias("query_well_id"), "latitude", "longitude")
    got = {(r["query_id"], r["well_id"]) for r in J.wells_within(q, w, radius).collect()}
    p, l = np.radians(lat), np.radians(lon)
    cosine = np.clip(np.cos(p)[:, None] * np.cos(p) * np.cos(l[:, None] - l) + np.sin(p)[:, None] * np.sin(p), -1, 1)
    km = 6371.0088 * np.arccos(cosine)
    assert got == {(i, j) for i, j in zip(*np.where(km <= radius)) if i != j}


@pytest.mark.parametrize("radius", [0.5, 30.0, 700.0])
def test_nearest_within_a_radius_where_wells_lie_close(spark, radius):
    """The first five by distance and id: crowded spots, repeated positions and ids, poles, date line."""
    rng = np.random.default_rng(15)
    lat = np.concatenate([rng.uniform(-90, 90, 60), rng.uniform(88.5, 90, 30), 50 + rng.normal(0, 0.003, 150), np.repeat(50.0, 60), rng.choice([50.2, 50.3], 50)])
    lon = np.concatenate([rng.uniform(-180, 180, 90), rng.choice([-1, 1], 150) * 179.999, np.repeat(-179.999, 60), rng.choice([10.0, 10.01], 50)])
    ids = [int(i) for i in range(350)]
    ids[300:306], ids[345] = [7] * 6, None
    w = spark.createDataFrame(list(zip(ids, lat.tolist(), lon.tolist())), "well_id int, latitude double, longitude double")
    rows = [(n, ids[n], float(lat[n]), float(lon[n])) for n in range(350)]
    q = spark.createDataFrame(rows, "query_id int, query_well_id int, latitude double, longitude double")
    p, l = np.radians(lat), np.radians(lon)
    km = 6371.0088 * np.arccos(np.clip(np.cos(p)[:, None] * np.cos(p) * np.cos(l[:, None] - l) + np.sin(p)[:, None] * np.sin(p), -1, 1))
    got = {}
    for r in J.wells_within(q, w, radius, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance_km"]))
    for n in range(350):
        want = sorted(km[n, j] for j in range(350) if ids[j] != ids[n] and km[n, j] <= radius)[:5]
        have = sorted(got.get(n, []))
        assert [k for k, _ in have] == list(range(1, len(want) + 1)) and np.allclose([x for _, x in have], want, atol=1e-3)


def test_the_reach_of_a_search_shrinks_where_wells_lie_close(spark):
    w = spark.range(4000).select("id", (F.lit(56.0) + F.pmod("id", F.lit(60)) / 5000).alias("latitude"), (F.lit(2.0) + F.floor(F.col("id") / 60) % 30 / 5000).alias("longitude"))
    kept = J._first_per_position(w, "id", 1)
    assert kept.count() == 3600
    q = w.select("id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    far = J._reach(q, kept, 0.45, 1, "id")
    assert far.count() == 4000 and far.agg(F.max("_deg")).first()[0] < 0.01


def test_evidence_needs_a_category(spark):
    m = spark.createDataFrame([(1, 1000.0, 7, "W7", 0.8), (1, 1000.0, 8, "W8", 0.4), (2, None, 7, "W7", 0.9)], "query_id int, depth_m double, well_id int, well_name string, score double")
    e = spark.createDataFrame([(1, 7, "kick", 1150.0), (2, 7, None, 1000.0), (3, 7, "loss", 850.0), (4, 7, "loss", 1150.1), (5, 8, "kick", 1000.0), (6, 7, "kick", None)], "event_id int, well_id int, category string, depth_start_m double")
    got = sorted((r["query_id"], r["event_id"], r["offset_m"]) for r in J.historical_evidence(m, e).collect())
    assert got == [(1, 1, 150.0), (1, 3, -150.0)]


def test_names_and_new_rows(spark):
    w = spark.createDataFrame([(1, "A"), (2, "B")], "well_id int, well_name string")
    rows = spark.createDataFrame([("A", 1), ("C", 2), ("C", 3)], "well_name string, x int")
    got, missing = J.attach_ids(rows, w)
    assert [r["well_id"] for r in got.collect()] == [1] and missing.first()["rows"] == 2
    old = spark.createDataFrame([(1, None)], "a int, b string")
    new = spark.createDataFrame([(1, None, 5), (1, "x", 9), (1, "x", 4)], "a int, b string, c int")
    assert [tuple(r) for r in J.new_rows_only(new, old, ["a", "b"]).collect()] == [(1, "x", 4)]


@pytest.mark.parametrize("tolerance", [None, 4.0])
def test_a_place_with_most_queries_spreads(spark, tolerance):
    """A third of all queries at one depth: dealt to copies of that piece, same rows found; null keys and depths stay."""
    queries = spark.createDataFrame([(i, "a" if i % 7 else None, 55.0 if i % 3 == 0 else float(i % 200) if i % 11 else None) for i in range(300)], "qid int, k string, d double")
    refs = spark.createDataFrame([("a", float(i * 7 % 230) + (i % 4) / 4, i) for i in range(120)], "k string, d double, v int")
    plain = J.nearest_join(queries, refs, ["k"], "d", "d", ["v"], 20.0, tolerance)
    dealt = J.nearest_join(queries, refs, ["k"], "d", "d", ["v"], 20.0, tolerance, max_rows=9)
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect())) and dealt.count() == 300
    assert dealt.where("v is not null").count() > 150


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_of_points_and_intervals_lie_together(spark, how):
    """Many points are dealt and joined by bucket, a crowded bucket to copies of its intervals; null keys and repeated rows stay as they are."""
    rows = [(i, None if i % 29 == 0 else i % 3, 55.0 if i % 2 == 0 else float(i * 37 % 400) / 2 if i % 11 else None) for i in range(600)]
    rows += rows[:40]
    other = [(j, j % 4 if j % 7 else None, float(j * 13 % 180), float(j * 13 % 180 + j % 50 - 2)) for j in range(150)]
    points, intervals = spark.createDataFrame(rows, "i int, k int, d double"), spark.createDataFrame(other, "j int, k int, lo double, hi double")
    got = J.range_join(points, intervals, ["k"], "d", "lo", "hi", 20.0, how, max_rows=60).withColumn("task", F.spark_partition_id()).collect()
    inside = [[j for j, q, lo, hi in other if k is not None and q == k and d is not None and lo <= d <= hi] for _, k, d in rows]
    want = [(i, j) for (i, _, _), js in zip(rows, inside) for j in js or ([None] if how == "left" else [])]
    assert sorted(((r["i"], r["j"]) for r in got), key=repr) == sorted(want, key=repr) and len(got) > 2000
    runs, last = [], None
    for r in got:
        if r["j"] is not None:
            now = (r["task"], r["k"], r["d"] // 20)
            runs += [now] if now != last else []
            last = now
    assert len(runs) == len(set(runs)) and len({t for t, _, _ in runs}) > 4
    of = [r[1:] for r in runs]
    assert {b for b in of if of.count(b) > 1} and {b[1] for b in of if of.count(b) > 1} == {2}
