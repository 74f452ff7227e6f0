"""Structured Streaming over telemetry, each operator with a batch twin elsewhere in the package."""

from __future__ import annotations

import math
import pickle

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from borelight.functions import scalars as S
from borelight.params import DEFAULTS, RISK_RULES
from borelight.plans.alerts import qualifying
from borelight.plans.anomaly import Forest, score_isolation_forest
from borelight.streaming.ordered import InOrder, in_order, moment, use_rocksdb


def stream_telemetry(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = 64, fmt: str = "parquet", pattern: str | None = None,
) -> DataFrame:
    """Stored rows as a stream, nothing made up; `files_per_trigger` bounds what one batch holds."""
    r = spark.readStream.format(fmt).schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def stream_resample(
    df: DataFrame, channels: list[str], every: str = DEFAULTS.resample, delay: str = "10 minutes", well: str = "well_name",
    at: str = "timestamp",
) -> DataFrame:
    """Tumbling means with a watermark; bins without any value are dropped."""
    out = df.withWatermark(at, delay).groupBy(well, F.window(at, every).alias("_w")).agg(
        *[F.avg(c).alias(c) for c in channels]
    )
    some = F.coalesce(*[F.col(c) for c in channels]).isNotNull()
    return out.where(some).select(well, F.col("_w.start").alias(at), *channels)


def late_rows(progress: list[dict]) -> int:
    """Rows dropped behind the watermark over all finished batches of a query."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", [])
    )


def stream_rig_state(
    df: DataFrame, well: str = "well_name", at: str = "timestamp", bit: str = "bit_depth_m", flow: str = "flow_in_lpm",
    rpm: str = "bit_rpm", min_flow: float = DEFAULTS.min_flow_lpm, min_rpm: float = DEFAULTS.min_rpm,
    min_speed: float = DEFAULTS.min_trip_speed, delay: str = "10 minutes",
) -> DataFrame:
    """Rig state of arriving bins in event-time order, whatever order and batch they come in; a bin is told once the watermark has passed it.

    Carried on per well: its last time and bit depth. Rows behind the watermark are dropped and counted by Spark.
    """
    names = [well, at, bit, flow, rpm, "trip_speed_m_per_min", "circulating", "rotating", "tripping", "operations_active"]

    def step(key, carried, row):
        us, b, f, r = row
        speed = None
        if carried is not None:
            minutes = (us - carried[0]) / 60e6
            if minutes != 0 and carried[1] is not None and b is not None:
                speed = abs((b - carried[1]) / minutes)
        circ, rot, trip = f is not None and f > min_flow, r is not None and r > min_rpm, speed is not None and speed > min_speed
        out = Row(**dict(zip(names, (key[0], moment(us), b, f, r, speed, circ, rot, trip, circ or rot or trip), strict=True)))
        return (us, b), [out]

    kind = df.schema[well].dataType.simpleString()
    schema = (
        f"`{well}` {kind}, `{at}` timestamp, `{bit}` double, `{flow}` double, `{rpm}` double, trip_speed_m_per_min double, "
        "circulating boolean, rotating boolean, tripping boolean, operations_active boolean"
    )
    return in_order(df, [well], at, delay, {bit: "double", flow: "double", rpm: "double"}, step, schema)


def stream_context_depth(
    df: DataFrame, step: float = DEFAULTS.context_step_m, well: str = "well_name", at: str = "timestamp", bit: str = "bit_depth_m",
    delay: str = "10 minutes",
) -> DataFrame:
    """A (well, context depth) query each time the bit has moved a full step from the last one, in event-time order behind the watermark."""

    def move(key, carried, row):
        us, b = row
        if b is None or (carried is not None and abs(b - carried[0]) < step):
            return carried, []
        last = math.floor(b / step + 0.5) * step
        return (last,), [Row(**{well: key[0], at: moment(us), bit: b, "depth_m": last})]

    kind = df.schema[well].dataType.simpleString()
    return in_order(df, [well], at, delay, {bit: "double"}, move, f"`{well}` {kind}, `{at}` timestamp, `{bit}` double, depth_m double")


def stream_rules(df: DataFrame, channels: Column, rules=RISK_RULES) -> DataFrame:
    """Rule score and messages of every arriving sample."""
    return df.withColumn("_r", S.evaluate_rules(channels, rules)).select(
        "*", F.col("_r.score").alias("rule_score"), F.col("_r.messages").alias("rule_messages")
    ).drop("_r")


def stream_alerts(
    df: DataFrame, cooldown_s: int = DEFAULTS.cooldown_s, window: float = DEFAULTS.alert_depth_window_m,
    raise_at: str = DEFAULTS.raise_at, delay: str = "10 minutes",
) -> DataFrame:
    """Decision for every arriving assessment: the alert it opens or adds to.

    Rows of a well and level wait in the state store until the watermark has passed them and are folded in time order, so the result does
    not depend on the batch a row came in. Open alerts are a map by depth cell of the window's width: a row looks at the cells in its reach and at
    alerts without a depth, and what the cooldown has passed is removed. Input: assessment_id (long), well_id, assessed_at, depth_m, risk_level.
    """
    use_rocksdb(df.sparkSession)
    kind = df.schema["well_id"].dataType.simpleString()
    rows = qualifying(df, raise_at).where(F.col("assessed_at").isNotNull()).withWatermark("assessed_at", delay).select(
        "well_id", "risk_level", "assessed_at", F.unix_micros("assessed_at").alias("_us"), F.col("assessment_id").alias("_id"),
        F.col("depth_m").cast("double").alias("_depth"),
    )
    schema = (
        f"assessment_id long, well_id {kind}, risk_level string, depth_m double, assessed_at timestamp, alert_id long, "
        "is_new boolean"
    )
    return rows.groupBy("well_id", "risk_level").transformWithState(OpenAlerts(cooldown_s * 1_000_000, window), schema, "append", "EventTime")


class OpenAlerts(InOrder):
    """The alert fold of one well and level: rows wait as in InOrder; open alerts lie in a map by depth cell, as (time, id, depth)."""

    def __init__(self, cooldown_us: int, window: float):
        super().__init__(self.decide)
        self.cooldown, self.window = cooldown_us, window

    def init(self, handle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "cell long", "alerts binary")

    def cell(self, depth) -> int:
        return ANYWHERE if depth is None else math.floor(depth / (self.window if self.window > 0 else 1.0))

    def alerts(self, cell: int, us: int) -> list:
        """The alerts of a cell that the cooldown before `us` has not passed; read once a release, empty cells are dropped from the state."""
        if cell not in self.read:
            stored = self.open.getValue((cell,)) if self.stored else None
            self.read[cell] = [] if stored is None else pickle.loads(stored[0])
        self.read[cell] = [a for a in self.read[cell] if a[0] >= us - self.cooldown]
        return self.read[cell]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.read: dict = {}
        self.last = None  # time of the last row decided
        self.stored = self.open.exists()  # without stored alerts no cell has to be asked for
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        for cell in list(self.read):
            if alerts := self.alerts(cell, self.last):  # none that the cooldown has passed by now
                self.open.updateValue((cell,), (pickle.dumps(alerts),))
            elif self.stored and self.open.containsKey((cell,)):
                self.open.removeKey((cell,))

    def decide(self, key, carried, row):
        us, number, depth = row
        self.last = us
        here = self.cell(depth)
        reach = (here - 1, here, here + 1, ANYWHERE)
        if depth is None:
            reach = ({k[0] for k in self.open.keys()} if self.stored else set()) | set(self.read)  # noqa: SIM118
        near = [a for c in reach for a in self.alerts(c, us) if depth is None or a[2] is None or abs(a[2] - depth) <= self.window]
        owner = max(near, default=None, key=lambda a: a[:2])
        if owner is None:
            owner = (us, number, depth)
            self.alerts(here, us).append(owner)
        out = Row(assessment_id=number, well_id=key[0], risk_level=key[1], depth_m=depth, assessed_at=moment(us), alert_id=owner[1], is_new=owner[1] == number)
        return carried, [out]


ANYWHERE = -(1 << 62)  # the cell of alerts without a depth


def stream_score(df: DataFrame, forest: Forest) -> DataFrame:
    """Scores of arriving feature rows with a fitted forest and the score range of its fit."""
    return score_isolation_forest(df, forest, stored_range=True)


def stream_dedupe(df: DataFrame, key: list[str], at: str = "timestamp", delay: str = "10 minutes") -> DataFrame:
    """First row of each key; repeats within the watermark are ignored."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into an in-memory table (tests and small checks)."""
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over what is there now into a Parquet table; restarts go on where it stopped."""
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q
