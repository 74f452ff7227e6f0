"""Time windows, states and alert folding on the telemetry role."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.operators import profile as P
from borelight.operators import windows as W
from borelight.plans import alerts as A
from catalog.base import TELE, query, rounded, table, tele, us

CH = ["flow_in_lpm", "bit_rpm"]
WINDOWS = {"short": 6, "medium": 30, "long": 90}


def _time_sql():
    o = "OVER (PARTITION BY well_name ORDER BY \"timestamp\", event_id"
    cols = []
    for w, n in WINDOWS.items():
        fr = f"{o} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for c in CH:
            cols += [
                f"round(CASE WHEN count({c}) {fr} >= 2 THEN avg({c}) {fr} END, 8) AS {c}_{w}_mean",
                f"round(CASE WHEN count({c}) {fr} >= 2 THEN stddev_samp({c}) {fr} END, 8) AS {c}_{w}_std",
                f"round(({c} - lag({c}, {n}) {o})) / {n}, 8) AS {c}_{w}_slope",
            ]
    cols += [f"round({c} - lag({c}) {o}), 8) AS {c}_rate" for c in CH]
    return f"WITH {TELE} SELECT event_id, {', '.join(cols)} FROM tele"


def _time(s, d, max_rows):
    out = W.rolling_time_stats(tele(s, d), CH, WINDOWS, ties=["event_id"], max_rows=max_rows)
    made = [c for c in W.time_feature_names(CH, WINDOWS) if c not in CH]
    return rounded(out.select("event_id", *made), 8, *made)


@query(_time_sql())
def q_rolling_time_stats(s, d):
    return _time(s, d, 5_000_000)


@query(_time_sql())
def q_rolling_time_stats_split(s, d):
    return _time(s, d, 40)


BINS = (
    f"WITH {TELE}, bins AS (SELECT well_name, time_bucket(INTERVAL '6 hours', \"timestamp\") AS tm, avg(flow_in_lpm) AS flow_in_lpm, "
    "avg(bit_rpm) AS bit_rpm, avg(bit_depth_m) AS bit_depth_m, count(*) FILTER (WHERE flow_in_lpm NOT BETWEEN 5 AND 120) AS bad FROM tele "
    "GROUP BY 1, 2)"
)


def _bins(s, d):
    df = tele(s, d).withColumn("bad", ~F.col("flow_in_lpm").between(5.0, 120.0))
    return W.resample(df, ["flow_in_lpm", "bit_rpm", "bit_depth_m"], "6 hours", count_flags=["bad"])


@query(f"{BINS} SELECT well_name, epoch_us(tm) AS at, round(flow_in_lpm, 7) AS flow_in_lpm, round(bit_rpm, 7) AS bit_rpm, bad AS bad_count FROM bins")
def q_resample(s, d):
    out = _bins(s, d)
    return out.select(
        "well_name", us("timestamp").alias("at"), F.round("flow_in_lpm", 7).alias("flow_in_lpm"),
        F.round("bit_rpm", 7).alias("bit_rpm"), "bad_count",
    )


STATE = (
    f"{BINS}, st AS (SELECT *, abs((bit_depth_m - lag(bit_depth_m) OVER w) / nullif((epoch_us(tm) - lag(epoch_us(tm)) OVER w) / 60e6, 0)) AS speed "
    "FROM bins WINDOW w AS (PARTITION BY well_name ORDER BY tm)), flags AS (SELECT *, flow_in_lpm > 100 AS circulating, bit_rpm > 50 AS rotating, "
    "coalesce(speed > 0.5, FALSE) AS tripping FROM st)"
)


def _state(s, d, **kw):
    return W.rig_state(_bins(s, d), min_rpm=50.0, **kw)


@query(
    f"{STATE} SELECT well_name, epoch_us(tm) AS at, round(speed, 7) AS speed, circulating, rotating, tripping, circulating OR rotating OR tripping "
    "AS operations_active FROM flags"
)
def q_rig_state(s, d):
    return _state(s, d).select(
        "well_name", us("timestamp").alias("at"), F.round("trip_speed_m_per_min", 7).alias("speed"), "circulating", "rotating",
        "tripping", "operations_active",
    )


@query(
    f"{STATE} SELECT well_name, count(*) FILTER (WHERE circulating) AS circulating, count(*) FILTER (WHERE rotating) AS rotating, "
    "count(*) FILTER (WHERE tripping) AS tripping, count(*) FILTER (WHERE circulating OR rotating OR tripping) AS operations_active FROM "
    "flags GROUP BY well_name"
)
def q_state_counts(s, d):
    return P.state_counts(_state(s, d), ["well_name"])


@query(
    f"{STATE}, raw AS (SELECT well_name, count(*) AS rows_before FROM tele GROUP BY 1) SELECT f.well_name, any_value(rows_before) AS rows_before, "
    "count(*) AS rows_after, epoch_us(min(tm)) AS first_at, epoch_us(max(tm)) AS last_at, round(max(bit_depth_m), 6) AS bit_depth_max, count(*) "
    "FILTER (WHERE circulating OR rotating OR tripping) AS active_rows, 'mud_temp' AS missing FROM flags f JOIN raw r ON f.well_name = r.well_name "
    "GROUP BY f.well_name"
)
def q_prepare_report(s, d):
    out = P.prepare_report(tele(s, d), _state(s, d), ["flow_in_lpm", "bit_rpm", "mud_temp"])
    return out.select(
        "well_name", "rows_before", "rows_after", us("first_at").alias("first_at"), us("last_at").alias("last_at"),
        F.round("bit_depth_max", 6).alias("bit_depth_max"), "active_rows", F.array_join("missing_channels", ",").alias("missing"),
    )


@query(
    "SELECT event_type, event_id, user_id, epoch_us(ts) AS at FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, "
    "event_id DESC) AS r FROM events) WHERE r = 1"
)
def q_latest_per_group(s, d):
    df = table(s, d, "events").select("event_type", "event_id", "user_id", "ts")
    return W.latest_per_group(df, ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "event_id", "user_id", us("ts").alias("at"))


LAST = (
    f"WITH {TELE}, p AS (SELECT *, lag(bit_rpm) OVER (PARTITION BY well_name ORDER BY \"timestamp\", event_id) AS prev FROM tele) SELECT well_name, "
    "event_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY well_name ORDER BY \"timestamp\" DESC, event_id DESC) AS r "
    "FROM p WHERE prev IS NULL OR prev <> bit_rpm) WHERE r <= 20"
)


@query(LAST)
def q_latest_n(s, d):
    out = W.latest_n(tele(s, d), 20, "well_name", "timestamp", ["event_id"], index="bit_rpm")
    return out.select("well_name", "event_id", "rank")


@query(
    f"WITH {TELE} SELECT well_name, bit_depth_m, event_id FROM (SELECT *, row_number() OVER (PARTITION BY well_name, bit_depth_m ORDER BY event_id) AS r "
    "FROM tele) WHERE r = 1"
)
def q_first_station_per_md(s, d):
    return W.first_station_per_md(tele(s, d).select("well_name", "bit_depth_m", "event_id"), "well_name", "bit_depth_m", "event_id")


@query("SELECT event_id, round((max(value) OVER () - value) / (max(value) OVER () - min(value) OVER ()), 9) AS anomaly_score FROM events")
def q_score_range_normalise(s, d):
    return rounded(W.score_range_normalise(table(s, d, "events"), "value").select("event_id", "anomaly_score"), 9, "anomaly_score")


@query(
    "SELECT user_id, event_id, i AS \"index\", (i - 3) * (10.0::DOUBLE / 60) AS emit_offset_s, i = n - 1 AS is_last FROM (SELECT user_id, event_id, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i >= 3"
)
def q_replay_timeline(s, d):
    df = table(s, d, "events").select("user_id", "event_id", "ts")
    return W.replay_timeline(df, 60.0, 3, "user_id", "ts").select("user_id", "event_id", "index", "emit_offset_s", "is_last")


LEVEL = "CASE WHEN value / 150 >= 0.85 THEN 'CRITICAL' WHEN value / 150 >= 0.65 THEN 'HIGH' WHEN value / 150 >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"
# the depth window is wide enough to hold every depth, so the fold depends on time alone and has an SQL form
FOLD = (
    f"WITH RECURSIVE a AS (SELECT event_id, user_id, {LEVEL} AS lv, ts, row_number() OVER (PARTITION BY user_id, {LEVEL} ORDER BY ts, event_id) "
    f"AS i FROM events WHERE {LEVEL} <> 'LOW'), f AS (SELECT event_id, user_id, lv, ts, i, ts AS t0, event_id AS alert FROM a WHERE i = 1 UNION ALL "
    "SELECT a.event_id, a.user_id, a.lv, a.ts, a.i, CASE WHEN a.ts - f.t0 <= INTERVAL '2 days' THEN f.t0 ELSE a.ts END, CASE WHEN a.ts - f.t0 <= "
    "INTERVAL '2 days' THEN f.alert ELSE a.event_id END FROM f JOIN a ON a.user_id = f.user_id AND a.lv = f.lv AND a.i = f.i + 1)"
)


def _assessments(s, d):
    x = F.col("value") / 150
    level = F.when(x >= 0.85, "CRITICAL").when(x >= 0.65, "HIGH").when(x >= 0.45, "MEDIUM").otherwise("LOW")
    return table(s, d, "events").select(
        F.col("event_id").alias("assessment_id"), F.col("user_id").alias("well_id"), F.col("ts").alias("assessed_at"),
        F.get_json_object("props", "$.k").cast("double").alias("depth_m"), level.alias("risk_level"),
    )


@query(f"{FOLD} SELECT event_id AS assessment_id, alert AS alert_id, event_id = alert AS is_new FROM f")
def q_alert_decisions(s, d):
    return A.alert_decisions(_assessments(s, d), 2 * 86400, 1000.0).select("assessment_id", "alert_id", "is_new")


@query(f"{FOLD} SELECT alert AS alert_id, user_id AS well_id, lv AS level, epoch_us(min(ts)) AS raised_at, count(*) AS occurrence_count FROM f GROUP BY ALL")
def q_batch_alerts(s, d):
    out = A.batch_alerts(_assessments(s, d), max_rows=20, cooldown_s=2 * 86400, window=1000.0)
    return out.select("alert_id", "well_id", "level", us("raised_at").alias("raised_at"), "occurrence_count")


@query()
def q_batch_alerts_by_depth(s, d):
    """Depth-window folding: no SQL form (several alerts of one level can be open at different depths)."""
    out = A.batch_alerts(_assessments(s, d), cooldown_s=2 * 86400, window=25.0)
    return out.select("alert_id", "well_id", "level", us("raised_at").alias("raised_at"), "depth_m", "occurrence_count", "dedupe_key")


ALERTS = (
    "al AS (SELECT o_orderkey AS alert_id, o_custkey AS well_id, 'open' AS status FROM orders), act AS (SELECT l_orderkey AS alert_id, l_shipdate AS "
    "recorded_at, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'rejected' END AS "
    "decision FROM lineitem)"
)


def _alerts(s, d):
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("well_id"), F.lit("open").alias("status")
    )


def _actions(s, d):
    n = F.col("l_linenumber") % 4
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("alert_id"), F.col("l_shipdate").alias("recorded_at"),
        F.when(n == 0, "accepted").when(n == 1, "investigating").when(n == 2, "resolved").otherwise("rejected").alias("decision"),
    )


@query(
    f"WITH {ALERTS}, r AS (SELECT alert_id, decision, row_number() OVER (PARTITION BY alert_id ORDER BY recorded_at DESC, decision DESC) AS r FROM act "
    "WHERE decision <> 'investigating') SELECT al.alert_id, well_id, CASE WHEN decision = 'resolved' THEN 'closed' WHEN decision IS NOT NULL THEN "
    "'reviewed' ELSE status END AS status FROM al LEFT JOIN r ON al.alert_id = r.alert_id AND r.r = 1"
)
def q_apply_actions(s, d):
    return A.apply_actions(_alerts(s, d), _actions(s, d))


@query(f"WITH {ALERTS} SELECT decision, count(*) AS n, TRUE AS available_for_training FROM act GROUP BY decision")
def q_training_actions(s, d):
    out = A.training_actions(_actions(s, d))
    return out.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("available_for_training").alias("available_for_training"))


@query(
    "SELECT o_orderkey AS alert_id, o_custkey AS well_id, o_orderkey AS assessment_id, l.score, coalesce(l.parts, 0) AS parts FROM orders LEFT JOIN (SELECT l_orderkey, "
    "round(max(l_discount), 4) AS score, count(*) AS parts FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey"
)
def q_alert_explanation(s, d):
    stored = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("assessment_id")).agg(
        F.round(F.max("l_discount"), 4).alias("score"), F.count(F.lit(1)).alias("parts")
    )
    al = _alerts(s, d).drop("status").withColumn("assessment_id", F.col("alert_id"))
    return A.alert_explanation(al, stored).withColumn("parts", F.coalesce("parts", F.lit(0)))
