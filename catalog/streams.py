"""Streaming queries: the table is read as a stream and run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from borelight.operators.materialise import checkpoint_folder
from borelight.plans import anomaly as A
from borelight.streaming import telemetry as S
from catalog.base import TELE, query, tele, us
from catalog.timeline import FOLD


def _stream(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    raw = S.stream_telemetry(s, d, schema, pattern="events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(
        F.col("user_id").alias("well_name"), F.col("ts").cast("timestamp").alias("timestamp"), "event_id", "event_type",
        F.col("value").alias("flow_in_lpm"), k.alias("bit_rpm"), (k * 10).alias("bit_depth_m"),
    )


def _run(s, df):
    base = f"{checkpoint_folder(s)}/stream-{uuid.uuid4().hex}"
    S.run_to_table(df, f"{base}/out", f"{base}/state")
    return s.read.schema(df.schema).parquet(f"{base}/out")


@query("SELECT event_id, user_id, epoch_us(ts) AS at FROM events")
def q_stream_telemetry(s, d):
    out = _run(s, _stream(s, d).select("event_id", F.col("well_name").alias("user_id"), "timestamp"))
    return out.select("event_id", "user_id", us("timestamp").alias("at"))


@query(
    f"WITH {TELE}, b AS (SELECT well_name, time_bucket(INTERVAL '6 hours', \"timestamp\") AS tm, avg(flow_in_lpm) AS f FROM tele GROUP BY 1, 2) SELECT well_name, epoch_us(tm) AS at, "
    "round(f, 7) AS flow_in_lpm FROM b WHERE tm + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
)
def q_stream_resample(s, d):
    out = _run(s, S.stream_resample(_stream(s, d), ["flow_in_lpm"], "6 hours"))
    return out.select("well_name", us("timestamp").alias("at"), F.round("flow_in_lpm", 7).alias("flow_in_lpm"))


@query(
    f"WITH {TELE}, s AS (SELECT *, abs((bit_depth_m - lag(bit_depth_m) OVER w) / nullif((epoch_us(\"timestamp\") - lag(epoch_us(\"timestamp\")) OVER w) / 60e6, 0)) AS speed FROM tele WINDOW w AS (PARTITION BY well_name ORDER BY "
    "\"timestamp\")) SELECT well_name, epoch_us(\"timestamp\") AS at, round(speed, 7) AS speed, flow_in_lpm > 100 AS circulating, bit_rpm > 50 AS rotating, coalesce(speed > 0.5, FALSE) AS tripping, flow_in_lpm > 100 OR bit_rpm > 50 OR "
    "coalesce(speed > 0.5, FALSE) AS operations_active FROM s WHERE epoch_us(\"timestamp\") // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"
)
def q_stream_rig_state(s, d):
    out = _run(s, S.stream_rig_state(_stream(s, d), min_rpm=50.0))
    return out.select(
        "well_name", us("timestamp").alias("at"), F.round("trip_speed_m_per_min", 7).alias("speed"), "circulating", "rotating", "tripping",
        "operations_active",
    )


@query(
    f"WITH RECURSIVE {TELE}, o AS (SELECT well_name, \"timestamp\" AS tm, bit_depth_m AS b, row_number() OVER (PARTITION BY well_name ORDER BY \"timestamp\") AS i FROM tele), r AS (SELECT well_name, tm, b, i, floor(b / 250 + 0.5) * "
    "250 AS cur, TRUE AS moved FROM o WHERE i = 1 UNION ALL SELECT o.well_name, o.tm, o.b, o.i, CASE WHEN abs(o.b - r.cur) < 250 THEN r.cur ELSE floor(o.b / 250 + 0.5) * 250 END, abs(o.b - r.cur) >= 250 FROM r JOIN o ON o.well_name = "
    "r.well_name AND o.i = r.i + 1) SELECT well_name, epoch_us(tm) AS at, b AS bit_depth_m, cur AS depth_m FROM r WHERE moved AND epoch_us(tm) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"
)
def q_stream_context_depth(s, d):
    out = _run(s, S.stream_context_depth(_stream(s, d), 250.0))
    return out.select("well_name", us("timestamp").alias("at"), "bit_depth_m", "depth_m")


@query(f"WITH {TELE} SELECT event_id, ((bit_rpm / 2 - 25 < -20)::INT + (bit_rpm / 2 - 25 > 20)::INT) / 5 AS rule_score FROM tele")
def q_stream_rules(s, d):
    m = F.create_map(F.lit("pit_gain_loss_m3"), F.col("bit_rpm") / 2 - 25)
    return _run(s, S.stream_rules(_stream(s, d), m).select("event_id", "rule_score"))


@query(
    f"{FOLD} SELECT event_id AS assessment_id, alert AS alert_id, event_id = alert AS is_new FROM f WHERE epoch_us(ts) // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM a)"
)
def q_stream_alerts(s, d):
    x = F.col("flow_in_lpm") / 150
    level = F.when(x >= 0.85, "CRITICAL").when(x >= 0.65, "HIGH").when(x >= 0.45, "MEDIUM").otherwise("LOW")
    a = _stream(s, d).select(
        F.col("event_id").alias("assessment_id"), F.col("well_name").alias("well_id"), F.col("timestamp").alias("assessed_at"),
        F.col("bit_rpm").alias("depth_m"), level.alias("risk_level"),
    )
    return _run(s, S.stream_alerts(a, 2 * 86400, 1000.0)).select("assessment_id", "alert_id", "is_new")


@query("SELECT DISTINCT user_id AS well_name, value AS flow_in_lpm FROM events")
def q_stream_dedupe(s, d):
    return _run(s, S.stream_dedupe(_stream(s, d), ["well_name", "flow_in_lpm"])).select("well_name", "flow_in_lpm")


@query()
def q_stream_score(s, d):
    channels = ["flow_in_lpm", "bit_rpm", "bit_depth_m"]
    forest = A.fit_isolation_forest(tele(s, d).select("event_id", *channels), channels, ["event_id"])
    out = _run(s, S.stream_score(_stream(s, d), forest).select("event_id", "is_anomaly", "anomaly_score"))
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))
