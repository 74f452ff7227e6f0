import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from borelight.functions import scalars as S
from borelight.operators import windows as W
from borelight.plans import alerts as A
from borelight.streaming import telemetry as T

# a watermark starts at the epoch, so event times lie well after it
START = 1_699_999_980
SCHEMA = "well_name string, timestamp timestamp, bit_depth_m double, flow_in_lpm double, bit_rpm double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Five files in time order, read one per batch."""
    path = str(tmp_path_factory.mktemp("tele"))
    rng = random.Random(18)
    rows, depth = [], {"a": 1000.0, "b": 500.0}
    for i in range(500):
        w = rng.choice("aab")
        depth[w] += rng.uniform(-6, 12)
        rows.append((w, START + i * 15, depth[w], rng.choice([None, 50.0, 150.0]), rng.choice([0.0, 9.0])))
    for k in range(5):
        df = spark.createDataFrame(rows[k * 100 : k * 100 + 100], "well_name string, s long, bit_depth_m double, flow_in_lpm double, bit_rpm double")
        df.select("well_name", F.timestamp_seconds("s").alias("timestamp"), "bit_depth_m", "flow_in_lpm", "bit_rpm").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, source):
    return T.stream_telemetry(spark, source, SCHEMA, files_per_trigger=1)


def finished(spark, df, tmp_path):
    T.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def rows(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_rig_state_equals_batch(spark, source, tmp_path):
    cols = ("well_name", F.unix_micros("timestamp"), F.coalesce("trip_speed_m_per_min", F.lit(-1.0)), "circulating", "rotating", "tripping", "operations_active")
    got = finished(spark, T.stream_rig_state(stream(spark, source), delay="2 minutes"), tmp_path)
    want = W.rig_state(spark.read.schema(SCHEMA).parquet(source)).where(F.unix_seconds("timestamp") <= START + 499 * 15 - 120)
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 480


@pytest.fixture(scope="module")
def shuffled(spark, source, tmp_path_factory):
    """The same rows in five files out of order: up to half an hour early or late."""
    path = str(tmp_path_factory.mktemp("shuffled"))
    rng = random.Random(5)
    kept = sorted(spark.read.schema(SCHEMA).parquet(source).collect(), key=lambda r: r["timestamp"].timestamp() + rng.uniform(-1800, 1800))
    for k in range(5):
        spark.createDataFrame(kept[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_disorder_gives_the_batch_result(spark, source, shuffled, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(source).where(F.unix_seconds("timestamp") <= START + 499 * 15 - 3720)
    cols = ("well_name", F.unix_micros("timestamp"), F.coalesce("trip_speed_m_per_min", F.lit(-1.0)), "circulating", "tripping")
    got = finished(spark, T.stream_rig_state(stream(spark, shuffled), delay="62 minutes"), tmp_path / "r")
    assert rows(got, *cols) == rows(W.rig_state(batch), *cols)
    deep = finished(spark, T.stream_context_depth(stream(spark, shuffled), 25.0, delay="62 minutes"), tmp_path / "d")
    even = finished(spark, T.stream_context_depth(stream(spark, source), 25.0, delay="62 minutes"), tmp_path / "e")
    assert rows(deep, "well_name", "bit_depth_m", "depth_m") == rows(even, "well_name", "bit_depth_m", "depth_m") and deep.count() > 5


def test_alerts_by_cell_equal_batch_under_disorder(spark, source, shuffled, tmp_path):
    """Short cooldowns, depths on the edge of cells and unknown ones."""
    def shaped(df):
        depth = F.when(F.unix_seconds("timestamp") % 4 != 0, F.floor("bit_depth_m") % 300)
        return df.select(
            F.unix_seconds("timestamp").alias("assessment_id"), F.lit(1).cast("long").alias("well_id"), F.col("timestamp").alias("assessed_at"),
            depth.cast("double").alias("depth_m"), F.lit("HIGH").alias("risk_level"))

    got = finished(spark, T.stream_alerts(shaped(stream(spark, shuffled)), 300, 25.0, delay="62 minutes"), tmp_path)
    want = A.alert_decisions(shaped(spark.read.schema(SCHEMA).parquet(source)), 300, 25.0).where(F.unix_seconds("assessed_at") <= START + 499 * 15 - 3720)
    cols = ("assessment_id", "alert_id", "is_new")
    assert rows(got, *cols) == rows(want, *cols) and got.where("not is_new").count() > 20


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    src = str(tmp_path / "src")
    for ts in ([100, 50, 3000], [3001, 20_000], [110, 30_000]):
        spark.createDataFrame([("a", START + t, 1.0) for t in ts], "well_name string, s long, bit_depth_m double").select(
            "well_name", F.timestamp_seconds("s").alias("timestamp"), "bit_depth_m").coalesce(1).write.mode("append").parquet(src)
    df = T.stream_context_depth(T.stream_telemetry(spark, src, "well_name string, timestamp timestamp, bit_depth_m double", 1), 25.0, delay="1 minute")
    q = T.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "state"))
    assert T.late_rows([json.loads(p.json) for p in q.recentProgress]) == 1


def test_resample_equals_batch_up_to_the_watermark(spark, source, tmp_path):
    got = finished(spark, T.stream_resample(stream(spark, source), ["bit_depth_m"], "60 seconds", "2 minutes"), tmp_path)
    want = W.resample(spark.read.schema(SCHEMA).parquet(source), ["bit_depth_m"], "60 seconds")
    last = START + 499 * 15 - 120
    want = want.where(F.unix_seconds("timestamp") + 60 <= last)
    assert rows(got, "well_name", F.unix_micros("timestamp"), "bit_depth_m") == rows(want, "well_name", F.unix_micros("timestamp"), "bit_depth_m")


def test_context_depth_equals_loop(spark, source, tmp_path):
    got = finished(spark, T.stream_context_depth(stream(spark, source), 25.0, delay="2 minutes"), tmp_path)
    want, last = [], {}
    for r in spark.read.schema(SCHEMA).parquet(source).where(F.unix_seconds("timestamp") <= START + 499 * 15 - 120).orderBy("timestamp").collect():
        p = last.get(r["well_name"])
        if p is None or abs(r["bit_depth_m"] - p) >= 25:
            last[r["well_name"]] = math.floor(r["bit_depth_m"] / 25 + 0.5) * 25.0
            want.append((r["well_name"], round(r["bit_depth_m"], 9), last[r["well_name"]]))
    assert rows(got, "well_name", "bit_depth_m", "depth_m") == sorted(want)


def test_rules_and_dedupe(spark, source, tmp_path):
    m = F.create_map(F.lit("standpipe_pressure_bar"), F.col("bit_depth_m"))
    got = finished(spark, T.stream_rules(stream(spark, source), m).select("bit_depth_m", "rule_score"), tmp_path)
    want = spark.read.schema(SCHEMA).parquet(source).select("bit_depth_m", S.evaluate_rules(m)["score"].alias("rule_score"))
    assert rows(got, "bit_depth_m", "rule_score") == rows(want, "bit_depth_m", "rule_score")
    doubled = stream(spark, source).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = finished(spark, T.stream_dedupe(doubled, ["well_name", "timestamp"]).select("well_name", "timestamp"), tmp_path / "d")
    assert once.count() == 500


def test_alerts_equal_batch(spark, source, tmp_path):
    def shaped(df):
        x = F.col("bit_depth_m") % 100
        return df.select(
            F.unix_seconds("timestamp").alias("assessment_id"), F.when(F.col("well_name") == "a", 1).otherwise(2).cast("long").alias("well_id"),
            F.col("timestamp").alias("assessed_at"), "bit_depth_m", F.when(x > 60, "HIGH").when(x > 20, "MEDIUM").otherwise("LOW").alias("risk_level"),
        ).withColumn("depth_m", F.when(F.col("assessment_id") % 4 != 0, F.col("bit_depth_m")))

    got = finished(spark, T.stream_alerts(shaped(stream(spark, source)), delay="3 minutes"), tmp_path)
    batch = shaped(spark.read.schema(SCHEMA).parquet(source))
    edge = batch.where("risk_level <> 'LOW'").agg(F.max(F.unix_seconds("assessed_at"))).first()[0] - 180
    want = A.alert_decisions(batch).where(F.col("assessment_id") <= edge)
    cols = ("assessment_id", "alert_id", "is_new", F.unix_seconds("assessed_at"))
    assert rows(got, *cols) == rows(want, *cols) and got.where("not is_new").count() > 20


def test_late_rows_are_counted(spark, tmp_path):
    src = str(tmp_path / "src")
    # late rows are judged by the watermark of the batch before
    for ts in ([100, 105, 3000], [3001, 3002], [110, 6000]):
        spark.createDataFrame([("a", t, 1.0) for t in ts], "well_name string, s long, v double").select("well_name", F.timestamp_seconds("s").alias("timestamp"), "v").coalesce(1).write.mode("append").parquet(src)
    df = T.stream_resample(T.stream_telemetry(spark, src, "well_name string, timestamp timestamp, v double", 1), ["v"], "10 seconds", "1 minute")
    q = T.run_to_table(df, str(tmp_path / "out"), str(tmp_path / "state"))
    assert T.late_rows([json.loads(p.json) for p in q.recentProgress]) == 1


class Store:
    """A map or value of the state store that counts the calls."""

    calls = 0

    def __init__(self):
        self.held: dict = {}

    def __getattr__(self, name):
        def call(*args):
            Store.calls += 1
            key = args[0] if name.endswith(("Value", "Key")) else ()
            if name.startswith("update"):
                self.held[key] = args[-1]
            elif name.startswith("remove"):
                del self.held[key]
            return {"get": self.held.get(key), "key": list(self.held)}.get(name[:3])

        return call


def test_calls_to_the_state_grow_with_keys_not_rows():
    """Rows of one key, a minute apart and out of order, wait in few chunks and come back in order."""
    from borelight.streaming.ordered import InOrder

    class Handle:
        def __init__(self):
            self.getMapState = self.getValueState = lambda *_: Store()
            self.timers = set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    told = InOrder(lambda key, carried, row: (((carried or (0,))[0] + 1,), [(row, (carried or (0,))[0])]))
    handle = Handle()
    told.init(handle)
    times = [m * 60_000_000 for m in range(1, 5001)]
    random.Random(3).shuffle(times)
    Store.calls, out, row = 0, [], Row("key", "_us", "_v")
    for part, ms in ((times[:2500], 0), (times[2500:], 2_000 * 60_000), ([], 5_000 * 60_000)):
        if ms:
            out += list(told.handleExpiredTimer(("a",), At(ms), None))
        list(told.handleInputRows(("a",), iter([row("a", t, None if t % 7 else t) for t in part if t > ms * 1000]), At(ms)))
    seen = sorted(times[:2500] + [t for t in times[2500:] if t > 2_000 * 60_000_000])
    assert out == [((t, None if t % 7 else t), i) for i, t in enumerate(seen)]
    assert Store.calls < 60 and told.waiting.held == {}
