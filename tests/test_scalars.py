import math

import pytest
from pyspark.sql import functions as F

from borelight.functions import scalars as S
from borelight.functions import vectors as V
from borelight.operators import clean as C
from borelight.operators.positions import utm_to_wgs84
from conftest import col


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_levels(spark):
    df = spark.createDataFrame([(0.0,), (0.30,), (0.45,), (0.70,), (0.99,)], "s double")
    assert col(df.select(S.risk_level("s").alias("x")), "x") == ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


@pytest.mark.parametrize(
    "channels, score, texts",
    [({"pit_gain_loss_m3": -500.0}, 0.2, 1), ({"surface_torque_knm": 5.0}, 0.0, 0), ({}, 0.0, 0)],
)
def test_rules(spark, channels, score, texts):
    df = spark.createDataFrame([(channels,)], "m map<string,double>")
    r = df.select(S.evaluate_rules("m").alias("r")).first()["r"]
    assert r["score"] == pytest.approx(score) and len(r["messages"]) == texts
    assert all("pit_gain_loss_m3" in t for t in r["messages"])


def test_cosine(spark):
    v = (1.0, 2.0, 3.0)
    rows = [(v, v), (v, tuple(-x for x in v)), (v, (3.0, -1.0, 0.5)), ((0.0, 0.0, 0.0), v)]
    got = col(spark.createDataFrame(rows, "a array<double>, b array<double>").select(V.cosine01("a", "b").alias("x")), "x")
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0) and 0 <= got[2] <= 1 and got[3] == 0


def test_width_is_checked(spark):
    ok = spark.createDataFrame([([1.0] * 384,)], "v array<float>").select(V.check_dimension("v", 384).alias("v"))
    assert len(ok.first()["v"]) == 384
    with pytest.raises(Exception, match="expected 384 values, got 383"):
        spark.createDataFrame([([1.0] * 383,)], "v array<float>").select(V.check_dimension("v", 384)).collect()


def test_distances(spark):
    a = (58.440974, 1.885883, 58.445030, 1.946510)
    km = one(spark, S.haversine_km(*[F.lit(x) for x in a]))
    assert 3.0 < km < 4.2
    assert one(spark, S.great_circle_km(*[F.lit(x) for x in a])) == pytest.approx(km, abs=1e-6)
    assert one(spark, S.haversine_km(F.lit(58.0), F.lit(1.0), F.lit(58.0), F.lit(1.0))) == 0
    unknown = F.lit(None).cast("double")
    assert one(spark, S.haversine_km(unknown, F.lit(1.0), F.lit(58.0), F.lit(1.0))) is None
    assert one(spark, S.great_circle_km(unknown, F.lit(1.0), F.lit(58.0), F.lit(1.0))) is None


def test_units(spark):
    rows = [(1e6, "N"), (1e5, "Pa"), (273.15, "K"), (1.0, "c/s"), (42.0, "furlongs")]
    out = C.convert_units(spark.createDataFrame(rows, "value double, unit string"), C.unit_table(spark)).collect()
    got = {r["unit"]: (round(r["value"], 9), r["canonical_unit"], r["is_known"]) for r in out}
    assert got == {
        "N": (1000, "kN", True), "Pa": (1, "bar", True), "K": (0, "degC", True), "c/s": (60, "rpm", True),
        "furlongs": (42, "furlongs", False),
    }


@pytest.mark.parametrize(
    "offsets, nearest",
    [([0.0], 0), ([-40.0, 90.0], 40), ([None], 150), ([], 150)],
)
def test_offsets(spark, offsets, nearest):
    df = spark.createDataFrame([(offsets,)], "o array<double>")
    assert df.select(S.nearest_offset("o").alias("x")).first()["x"] == nearest


def test_proximity_falls_with_distance(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (149.0,), (200.0,), (None,)], "o double")
    got = col(df.select(S.proximity("o").alias("x")), "x")
    assert got[0] == 1 and got[0] > got[1] > got[2] > 0 and got[3] == got[4] == 0


def test_relations(spark):
    df = spark.createDataFrame([(150.0,), (-45.0,), (0.0,), (-0.5,), (0.5,)], "o double")
    assert col(df.select(S.relation_to_bit("o").alias("x")), "x") == ["150 m ahead", "45 m behind", "at the bit", "at the bit", "1 m ahead"]
    df = spark.createDataFrame([(0.0,), (120.0,), (-35.0,)], "o double")
    assert col(df.select(S.relation_in_depth("o").alias("x")), "x") == ["same depth", "120 m deeper", "35 m shallower"]


@pytest.mark.parametrize(
    "prev, bit, step, want",
    [(None, 0, 25, 0), (None, 1237, 25, 1225), (1225, 1230, 25, 1225), (1225, 1249, 25, 1225), (1225, 1250, 25, 1250),
     (1225, 1400, 25, 1400), (1225, 1200, 25, 1200), (None, 1237, 50, 1250), (1200, 1230, 50, 1200)],
)
def test_context_depth(spark, prev, bit, step, want):
    p = F.lit(None if prev is None else float(prev)).cast("double")
    assert one(spark, S.next_context_depth(p, F.lit(float(bit)), step)) == want


def test_names(spark):
    assert one(spark, S.slugify(F.lit("15/9-F-4: Final (report)"))) == "15_9_F_4_Final_report"
    assert one(spark, S.decode_dir(F.lit("NO 15_$47$_9-F-4"))) == "NO 15/9-F-4"
    assert one(spark, S.decode_dir(F.lit("A$32$B$47$$229$ $99999$"))) == "A B/å $99999$"
    assert one(spark, S.citation_path(F.lit("/srv/x/a.pdf"), "/srv")) == "x/a.pdf"
    assert one(spark, S.citation_path(F.lit("/opt/a.pdf"), "/srv")) == "/opt/a.pdf"
    assert one(spark, S.join_name(F.lit("NO 15/9-F-4 "))) == "15/9-F-4"
    assert one(spark, S.dedupe_key(F.lit(7), F.lit("HIGH"), F.lit(None).cast("double"))) == "7:HIGH:0"
    assert one(spark, S.lithology_name(F.lit(70032))) == "Chalk"
    assert one(spark, S.lithology_name(F.lit(1))) == "1"
    assert len(one(spark, S.investigation_query(F.lit(None).cast("string"), F.lit("stuck_pipe"), F.lit("x" * 400), 300))) == 300


def test_narrative(spark):
    parts = F.array(
        F.struct(F.lit("anomaly").alias("name"), F.lit(0.5).alias("value"), F.lit(0.4).alias("weight")),
        F.struct(F.lit("rules").alias("name"), F.lit(0.2).alias("value"), F.lit(0.2).alias("weight")),
    )
    text = one(
        spark,
        S.narrative(F.lit("HIGH"), F.lit("W1"), F.lit(1234.4), parts, F.lit(2), F.array(F.lit("B"), F.lit("A")), F.lit("hybrid_indicator")),
    )
    assert text.startswith("HIGH at W1, 1234 m MD; strongest signs: anomaly 0.50, rules 0.20; earlier records near this depth: 2 (A, B); to be read")
    assert text.endswith("without a fitted chance of an event.")


def test_position_shift(spark):
    """Projected metres near 58.44 N 1.89 E come back within tens of metres."""
    df = spark.createDataFrame([(435050.0, 6478550.0), (None, 1.0)], "e double, n double")
    near, none = utm_to_wgs84(df, "e", "n").collect()
    assert near["latitude"] == pytest.approx(58.441, abs=0.02) and near["longitude"] == pytest.approx(1.886, abs=0.02)
    assert none["latitude"] is None and none["longitude"] is None


def test_wkt(spark):
    assert one(spark, S.point_wkt(F.lit(1.5), F.lit(58.25))) == "SRID=4326;POINT(1.5 58.25)"
    assert one(spark, S.point_wkt(F.lit(None).cast("double"), F.lit(58.25))) is None


def test_channel_map(spark):
    t = C.channel_table(spark, {"wob": ("WOB_AVG", "WOB"), "mse": ("MSE",)})
    long = spark.createDataFrame([("L", "WOB"), ("L", "HKLD_AVG")], "log string, mnemonic string")
    r = C.resolve_channels(long, t, ["log"])
    assert [(x["channel"], x["mnemonic"]) for x in r.collect()] == [("wob", "WOB")]
    assert col(C.missing_channels(r, t), "channel") == ["mse"]


def test_implausible(spark):
    df = spark.createDataFrame([(10.0,), (5000.0,), (20.0,)], "surface_rpm double")
    out = C.flag_implausible(df).collect()
    assert [r["surface_rpm"] for r in out] == [10.0, None, 20.0]
    assert [r["surface_rpm_implausible"] for r in out] == [False, True, False]
    assert C.implausible_counts(df).first()["implausible"] == 1


def test_constants(spark):
    df = spark.range(10).select(F.lit(0.0).alias("rop"), (F.col("id") * 44.0 + 500).alias("hookload"))
    assert {r["channel"]: r["constant"] for r in C.constant_channels(df, ["rop", "hookload"]).collect()} == {"rop": True, "hookload": False}


def test_behaviour(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"a": 1.0, "c": 3.0})], "l map<string,double>, r map<string,double>")
    r = df.select(S.behaviour_similarity("l", "r", {"a": 10.0, "b": 1.0}).alias("x")).first()["x"]
    assert r["value"] == 1.0 and r["shared"] == 1
    assert math.isclose(one(spark, S.exp_decay(F.lit(25.0), 25.0)), math.exp(-1))


def test_page_above_the_limit(spark):
    from borelight.operators.topk import paginate

    with pytest.raises(ValueError, match="limit"):
        paginate(spark.range(3), ["id"], 501)
