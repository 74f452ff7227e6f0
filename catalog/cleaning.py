"""Cleaning, conversion, filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from borelight.functions import scalars as S
from borelight.functions import vectors as V
from borelight.operators import clean as C
from borelight.operators import topk as K
from borelight.operators.materialise import checkpoint_folder
from borelight.sources import readers as R
from borelight.sources import writers as O
from catalog.base import (
    ASKED,
    HISTORY,
    INTERVALS,
    LOGS,
    PLACES,
    TELE,
    asked,
    history,
    intervals,
    logs,
    places,
    query,
    table,
    tele,
    us,
)

RANGES = {"flow_in_lpm": (5.0, 120.0), "bit_rpm": (10.0, 90.0)}


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity NOT IN (1, 50) THEN l_quantity END AS l_quantity, "
    "CASE WHEN l_tax NOT IN (1, 50) THEN l_tax END AS l_tax, l_suppkey FROM lineitem"
)
def q_null_sentinels(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_suppkey")
    return C.null_sentinels(df, ["l_quantity", "l_tax"], (1.0, 50.0))


@query("SELECT 'l_quantity' AS \"column\", count(*) AS hits FROM lineitem WHERE l_quantity IN (1, 50)")
def q_sentinel_counts(s, d):
    return C.sentinel_counts(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], (1.0, 50.0))


@query(
    "SELECT event_id, epoch_us(ts) AS at, CASE WHEN value NOT IN (12.31, 6.55) AND "
    "CAST(value AS VARCHAR) <> CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR) || '.0' THEN value END AS value "
    "FROM events WHERE event_type <> 'view'"
)
def q_parse_channels(s, d):
    text = table(s, d, "events").select(
        "event_id", F.col("value").cast("string").alias("value"),
        F.when(F.col("event_type") == "view", "not a time").otherwise(F.col("ts").cast("string")).alias("time_text"),
        F.get_json_object("props", "$.k").alias("null_value"),
    )
    out = C.parse_channels(text, sentinels=(12.31, 6.55))
    return out.select("event_id", us("timestamp").alias("at"), "value")


CHANNELS = {"flow": ("purchase", "click"), "torque": ("missing", "view"), "rpm": ("error",), "gas": ("absent",)}
CHANNEL_ROWS = (
    "(VALUES ('flow', 'purchase', 0), ('flow', 'click', 1), ('torque', 'missing', 0), ('torque', 'view', 1), "
    "('rpm', 'error', 0), ('gas', 'absent', 0)) AS c(channel, mnemonic, prio)"
)


@query(
    "SELECT user_id AS log, channel, arg_min(mnemonic, prio) AS mnemonic FROM "
    f"(SELECT DISTINCT user_id, event_type FROM events) e JOIN {CHANNEL_ROWS} ON e.event_type = c.mnemonic "
    "GROUP BY user_id, channel"
)
def q_resolve_channels(s, d):
    long = table(s, d, "events").select(F.col("user_id").alias("log"), F.col("event_type").alias("mnemonic"))
    return C.resolve_channels(long, C.channel_table(s, CHANNELS), ["log"]).select("log", "channel", "mnemonic")


@query("SELECT 'gas' AS channel")
def q_missing_channels(s, d):
    long = table(s, d, "events").select(F.col("user_id").alias("log"), F.col("event_type").alias("mnemonic"))
    t = C.channel_table(s, CHANNELS)
    return C.missing_channels(C.resolve_channels(long, t, ["log"]), t)


@query(
    "WITH r AS (SELECT user_id AS log, channel, arg_min(mnemonic, prio) AS mnemonic FROM "
    f"(SELECT DISTINCT user_id, event_type FROM events) e JOIN {CHANNEL_ROWS} ON e.event_type = c.mnemonic "
    "GROUP BY user_id, channel) SELECT e.user_id AS log, epoch_us(date_trunc('day', ts)) AS day, "
    "max(CASE WHEN channel = 'flow' THEN value END) AS flow, max(CASE WHEN channel = 'torque' THEN value END) AS torque, "
    "max(CASE WHEN channel = 'rpm' THEN value END) AS rpm FROM events e JOIN r ON e.user_id = r.log AND "
    "e.event_type = r.mnemonic GROUP BY 1, 2"
)
def q_wide_channels(s, d):
    long = table(s, d, "events").select(
        F.col("user_id").alias("log"), F.col("event_type").alias("mnemonic"), "value", us("ts").alias("_t")
    ).withColumn("day", (F.floor(F.col("_t") / 86400000000) * 86400000000).cast("long"))
    r = C.resolve_channels(long, C.channel_table(s, CHANNELS), ["log"])
    return C.wide_channels(long, r, ["log"], ["log", "day"], ["flow", "torque", "rpm"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0")
def q_filter_logs(s, d):
    df = table(s, d, "events").withColumn("kind", F.when(F.col("user_id") % 2 == 0, "date time").otherwise("depth"))
    return C.filter_logs(df, "event_type", "kind", ("click", "view")).select("event_id", "event_type")


@query(
    "SELECT count(*) FILTER (WHERE n AND k) AS kept, count(*) FILTER (WHERE NOT n) AS skipped_name, "
    "count(*) FILTER (WHERE n AND NOT k) AS skipped_index_type FROM (SELECT event_type IN ('click', 'view') AS n, "
    "user_id % 2 = 0 AS k FROM events)"
)
def q_skipped_logs(s, d):
    df = table(s, d, "events").withColumn("kind", F.when(F.col("user_id") % 2 == 0, "date time").otherwise("depth"))
    return C.skipped_logs(df, "event_type", "kind", ("click", "view"))


UNIT_SQL = (
    "(VALUES ('N', 'kN', 1e-3, 0.0), ('N.m', 'kN.m', 1e-3, 0.0), ('Pa', 'bar', 1e-5, 0.0), "
    "('m3/s', 'L/min', 60000.0, 0.0), ('c/s', 'rpm', 60.0, 0.0), ('Hz', 'spm', 60.0, 0.0), "
    "('K', 'degC', 1.0, -273.15), ('kg/m3', 's.g.', 1e-3, 0.0), ('m/s', 'm/h', 3600.0, 0.0), "
    "('J', 'kJ', 1e-3, 0.0)) AS u(unit, canonical, scale, shift)"
)
UNIT_OF = "CASE event_type WHEN 'click' THEN 'Pa' WHEN 'view' THEN 'K' WHEN 'error' THEN 'm/s' WHEN 'signup' THEN 'furlongs' ELSE 'm' END"


def _with_unit(s, d):
    e = F.col("event_type")
    unit = (
        F.when(e == "click", "Pa").when(e == "view", "K").when(e == "error", "m/s").when(e == "signup", "furlongs").otherwise("m")
    )
    return table(s, d, "events").select("event_id", "event_type", "user_id", unit.alias("unit"), "value")


@query(
    f"WITH e AS (SELECT event_id, {UNIT_OF} AS unit, value FROM events) SELECT event_id, "
    "round(CASE WHEN u.unit IS NULL THEN value ELSE value * CAST(scale AS DOUBLE) + CAST(shift AS DOUBLE) END, 9) AS value, "
    "coalesce(canonical, e.unit) AS canonical_unit, u.unit IS NOT NULL AS converted, "
    f"u.unit IS NOT NULL OR e.unit = 'm' AS is_known FROM e LEFT JOIN {UNIT_SQL} ON e.unit = u.unit"
)
def q_convert_units(s, d):
    out = C.convert_units(_with_unit(s, d), C.unit_table(s))
    return out.select("event_id", F.round("value", 9).alias("value"), "canonical_unit", "converted", "is_known")


@query(
    f"WITH {TELE} SELECT event_id, CASE WHEN flow_in_lpm BETWEEN 5 AND 120 THEN flow_in_lpm END AS flow_in_lpm, "
    "CASE WHEN bit_rpm BETWEEN 10 AND 90 THEN bit_rpm END AS bit_rpm, flow_in_lpm NOT BETWEEN 5 AND 120 AS "
    "flow_in_lpm_implausible, bit_rpm NOT BETWEEN 10 AND 90 AS bit_rpm_implausible FROM tele"
)
def q_flag_implausible(s, d):
    return C.flag_implausible(tele(s, d).select("event_id", "flow_in_lpm", "bit_rpm"), RANGES)


@query(
    f"WITH {TELE} SELECT 'flow_in_lpm' AS channel, count(*) AS implausible FROM tele WHERE flow_in_lpm NOT BETWEEN 5 AND 120 "
    "UNION ALL SELECT 'bit_rpm', count(*) FROM tele WHERE bit_rpm NOT BETWEEN 10 AND 90"
)
def q_implausible_counts(s, d):
    return C.implausible_counts(tele(s, d), RANGES)


@query(
    f"WITH {LOGS} SELECT curve, round(c, 9) AS coverage, c >= 0.985 AS selected FROM (SELECT 'qty' AS curve, "
    "count(qty) / count(*) AS c FROM logs UNION ALL SELECT 'disc', count(disc) / count(*) FROM logs UNION ALL "
    "SELECT 'formation_name', count(formation_name) / count(*) FROM logs)"
)
def q_select_curves(s, d):
    out = C.curve_selection(logs(s, d), ["qty", "disc", "formation_name"], 0.985)
    return out.withColumn("coverage", F.round("coverage", 9))


@query(
    f"WITH {TELE} SELECT 'flow_in_lpm' AS channel, count(flow_in_lpm) > 1 AND max(flow_in_lpm) - min(flow_in_lpm) <= 1e-9 AS "
    "constant FROM tele UNION ALL SELECT 'still', TRUE UNION ALL SELECT 'empty', FALSE"
)
def q_constant_channels(s, d):
    df = tele(s, d).withColumn("still", F.lit(5.0)).withColumn("empty", F.lit(None).cast("double"))
    return C.constant_channels(df, ["flow_in_lpm", "still", "empty"])


@query(
    f"WITH {TELE} SELECT 'flow_in_lpm' AS channel, count(DISTINCT flow_in_lpm) <= 1 AS constant FROM tele UNION ALL "
    "SELECT 'still', TRUE UNION ALL SELECT 'empty', TRUE"
)
def q_uninformative_channels(s, d):
    df = tele(s, d).withColumn("still", F.lit(5.0)).withColumn("empty", F.lit(None).cast("double"))
    return C.uninformative_channels(df, ["flow_in_lpm", "still", "empty"])


@query(
    f"WITH {LOGS} SELECT well, depth, ok, ln FROM logs WHERE CAST(depth AS FLOAT) % CAST(5 AS FLOAT) < CAST(0.08 AS FLOAT)"
)
def q_decimate_by_depth(s, d):
    return C.decimate_by_depth(logs(s, d), 5.0).select("well", "depth", "ok", "ln")


@query(
    f"WITH {LOGS} SELECT ok, ln, well, depth, k AS key, v AS value FROM (SELECT ok, ln, well, depth, "
    "unnest(['qty', 'disc', 'tax']) AS k, unnest([qty, disc, tax]) AS v FROM logs) WHERE v IS NOT NULL"
)
def q_pack_map(s, d):
    df = logs(s, d).select("ok", "ln", "well", "depth", "qty", "disc", "tax")
    packed = C.pack_map(df, ["qty", "disc", "tax"], "curves", drop_null=True)
    return packed.select("ok", "ln", "well", "depth", F.explode("curves"))


@query(f"WITH {LOGS} SELECT ok, ln, well, depth, qty, tax, CAST(NULL AS DOUBLE) AS nothing FROM logs")
def q_unpack_map(s, d):
    df = logs(s, d).select("ok", "ln", "well", "depth", "qty", "disc", "tax")
    return C.unpack_map(C.pack_map(df, ["qty", "disc", "tax"], "curves"), "curves", ["qty", "tax", "nothing"])


@query(
    f"WITH {PLACES} SELECT well_id, CASE WHEN longitude IS NOT NULL THEN latitude END AS latitude, longitude, "
    "CASE WHEN longitude IS NOT NULL THEN 'SRID=4326;POINT(' || CAST(longitude AS DOUBLE) || ' ' || CAST(latitude AS DOUBLE) || ')' END AS wkt "
    "FROM places"
)
def q_point_wkt(s, d):
    p = places(s, d)
    lat = F.when(F.col("longitude").isNotNull(), F.col("latitude"))
    return p.select("well_id", lat.alias("latitude"), "longitude", S.point_wkt("longitude", "latitude").alias("wkt"))


@query(
    "SELECT c_custkey, CASE WHEN c_acctbal / 50 BETWEEN -90 AND 90 THEN c_acctbal / 50 END AS latitude, "
    "CASE WHEN c_acctbal / 50 BETWEEN -90 AND 90 THEN 10.0::DOUBLE END AS longitude, c_acctbal / 50 NOT BETWEEN -90 AND 90 AS "
    "position_rejected FROM customer"
)
def q_validate_positions(s, d):
    df = table(s, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("latitude"), F.lit(10.0).alias("longitude")
    )
    return C.validate_positions(df)


@query("SELECT c_custkey, trim(replace('NO ' || c_name || ' ', 'NO ', '')) AS name FROM customer")
def q_join_name(s, d):
    name = F.concat(F.lit("NO "), F.col("c_name"), F.lit(" "))
    return table(s, d, "customer").select("c_custkey", S.join_name(name).alias("name"))


@query("SELECT c_custkey AS well_id, c_name AS well_name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_name ILIKE '%#0000001%'")
def q_filter_wells(s, d):
    df = table(s, d, "customer").select(
        F.col("c_custkey").alias("well_id"), F.col("c_name").alias("well_name"), F.col("c_mktsegment").alias("field_name")
    )
    return C.filter_wells(df, field="MACHINERY", search="customer#0000001").select("well_id", "well_name")


@query(f"WITH {LOGS} SELECT well, depth, ok, ln FROM logs WHERE depth BETWEEN 20000 AND 30000")
def q_depth_slice(s, d):
    return C.depth_slice(logs(s, d), "depth", 20000.0, 30000.0, order=["well", "depth", "ok", "ln"]).select("well", "depth", "ok", "ln")


@query(
    "SELECT o_orderkey AS alert_id, o_custkey AS well_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' "
    "ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"
)
def q_filter_alerts(s, d):
    df = table(s, d, "orders").select(
        F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("well_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("level"), F.col("o_orderdate").alias("raised_at"),
    )
    return C.filter_alerts(df, status="F", level="1-URGENT", limit=50).select("alert_id", "well_id")


@query("SELECT 'empty' AS channel")
def q_absent_channels(s, d):
    df = tele(s, d).withColumn("empty", F.lit(None).cast("double"))
    return C.absent_channels(df, ["flow_in_lpm", "bit_rpm", "empty"])


# ------------------------------------------------------------------ scalar functions


PAIRS = f"WITH {PLACES}, {ASKED.replace('asked AS', 'q AS')}"


@query(
    f"WITH {PLACES}, c AS (SELECT c_custkey, 50 + c_acctbal % 40 / 4 AS lat, c_custkey % 9 AS lon FROM customer) "
    "SELECT c_custkey, round(2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(58 - lat) / 2), 2) + cos(radians(lat)) * "
    "cos(radians(58)) * power(sin(radians(2 - lon) / 2), 2)))), 6) AS haversine, round(6371.0088 * acos(least(1, greatest(-1, "
    "cos(radians(lat)) * cos(radians(58)) * cos(radians(2) - radians(lon)) + sin(radians(lat)) * sin(radians(58))))), 5) AS great_circle "
    "FROM c"
)
def q_distances(s, d):
    c = table(s, d, "customer").select(
        "c_custkey", (50 + F.col("c_acctbal") % 40 / 4).alias("lat"), (F.col("c_custkey") % 9).cast("double").alias("lon")
    )
    return c.select(
        "c_custkey",
        F.round(S.haversine_km("lat", "lon", F.lit(58.0), F.lit(2.0)), 6).alias("haversine"),
        F.round(S.great_circle_km("lat", "lon", F.lit(58.0), F.lit(2.0)), 5).alias("great_circle"),
    )


@query(
    "SELECT a.vec_id, b.vec_id AS other, round(least(1, greatest(0, (list_cosine_similarity(a.embedding::DOUBLE[], "
    "b.embedding::DOUBLE[]) + 1) / 2)), 6) AS cosine01, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def q_vector_similarity(s, d):
    a = table(s, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return a.join(b, "vec_id").select(
        "vec_id", "other", F.round(V.cosine01("embedding", "e2"), 6).alias("cosine01"),
        F.round(V.dot("embedding", "e2"), 6).alias("dot"),
    )


@query(
    "SELECT o_orderkey, CASE WHEN x >= 0.85 THEN 'CRITICAL' WHEN x >= 0.65 THEN 'HIGH' WHEN x >= 0.45 THEN 'MEDIUM' WHEN "
    "x >= 0.25 THEN 'LOW' ELSE 'INFO' END AS level, round(exp(-x / 0.3), 9) AS decay, "
    "CAST(o_custkey AS VARCHAR) || ':LOW:' || CAST(CAST(floor(o_totalprice / 25) AS BIGINT) AS VARCHAR) AS dedupe_key FROM "
    "(SELECT *, o_totalprice / 500000 AS x FROM orders)"
)
def q_risk_levels(s, d):
    x = F.col("o_totalprice") / 500000
    return table(s, d, "orders").select(
        "o_orderkey", S.risk_level(x).alias("level"), F.round(S.exp_decay(x, 0.3), 9).alias("decay"),
        S.dedupe_key("o_custkey", F.lit("LOW"), "o_totalprice").alias("dedupe_key"),
    )


@query(
    f"WITH {TELE} SELECT event_id, CAST((flow_in_lpm > 350)::INT + (bit_rpm / 2 - 25 < -20)::INT + (bit_rpm / 2 - 25 > 20)::INT AS DOUBLE) / 5 AS "
    "rule_score, concat_ws('; ', CASE WHEN flow_in_lpm > 350 THEN printf('standpipe_pressure_bar = %.2f exceeds the configured "
    "maximum of 350.00', flow_in_lpm) END, CASE WHEN bit_rpm / 2 - 25 < -20 THEN printf('pit_gain_loss_m3 = %.2f is below the "
    "configured minimum of -20.00', bit_rpm / 2 - 25) END, CASE WHEN bit_rpm / 2 - 25 > 20 THEN printf('pit_gain_loss_m3 = %.2f "
    "exceeds the configured maximum of 20.00', bit_rpm / 2 - 25) END) AS messages FROM tele"
)
def q_evaluate_rules(s, d):
    m = F.create_map(
        F.lit("standpipe_pressure_bar"), F.col("flow_in_lpm"), F.lit("pit_gain_loss_m3"), F.col("bit_rpm") / 2 - 25
    )
    r = S.evaluate_rules(m)
    return tele(s, d).select("event_id", r["score"].alias("rule_score"), F.array_join(r["messages"], "; ").alias("messages"))


@query(
    "SELECT o_orderkey, greatest(0, 1 - abs(coalesce(x, 150)) / 150) AS proximity, CASE WHEN floor(x + 0.5) = 0 THEN 'at the bit' "
    "WHEN floor(x + 0.5) > 0 THEN CAST(floor(x + 0.5) AS INT) || ' m ahead' WHEN floor(x + 0.5) < 0 THEN CAST(abs(floor(x + 0.5)) AS INT) || "
    "' m behind' END AS to_bit, CASE WHEN floor(x + 0.5) = 0 THEN 'same depth' WHEN floor(x + 0.5) > 0 THEN CAST(floor(x + 0.5) AS INT) || "
    "' m deeper' WHEN floor(x + 0.5) < 0 THEN CAST(abs(floor(x + 0.5)) AS INT) || ' m shallower' END AS in_depth, "
    "floor(x / 25 + 0.5) * 25 AS snapped FROM (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_orderkey % 401 / 1.0 - 200.25 END AS x FROM orders)"
)
def q_offsets(s, d):
    x = F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderkey") % 401 - F.lit(200.25))
    return table(s, d, "orders").withColumn("x", x).select(
        "o_orderkey", S.proximity("x").alias("proximity"), S.relation_to_bit("x").alias("to_bit"),
        S.relation_in_depth("x").alias("in_depth"), S.quantise_depth("x").alias("snapped"),
    )


@query(
    "SELECT o_orderkey, round((CASE WHEN a IS NOT NULL THEN a * 0.4 ELSE 0 END + CASE WHEN b IS NOT NULL THEN b * 0.2 ELSE 0 END) / "
    "nullif((a IS NOT NULL)::INT * 0.4 + (b IS NOT NULL)::INT * 0.2, 0), 9) AS score FROM (SELECT o_orderkey, CASE WHEN "
    "o_orderkey % 3 <> 0 THEN o_totalprice / 500000 END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey / 150000.0 END AS b FROM orders)"
)
def q_weighted_mean(s, d):
    a = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 500000)
    b = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") / 150000.0)
    parts = F.array(
        F.struct(a.alias("value"), F.lit(0.4).alias("weight")), F.struct(b.alias("value"), F.lit(0.2).alias("weight"))
    )
    return table(s, d, "orders").select("o_orderkey", F.round(S.weighted_mean(parts), 9).alias("score"))


@query(
    "SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' / ' || p_brand || '!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, "
    "replace(replace('A$47$B_/_' || p_name, '$47$', '/'), '_/_', '/') AS folder, p_name || '.pdf' AS cited, "
    "substr(p_brand || ' ' || p_type, 1, 300) AS question FROM part"
)
def q_names(s, d):
    return table(s, d, "part").select(
        "p_partkey",
        S.slugify(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"),
        S.decode_dir(F.concat(F.lit("A$47$B_/_"), "p_name")).alias("folder"),
        S.citation_path(F.concat(F.lit("/data/raw/"), "p_name", F.lit(".pdf")), "/data/raw").alias("cited"),
        S.investigation_query("p_brand", "p_type", F.lit("")).alias("question"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE l_suppkey % 5 WHEN 0 THEN 'Sandstone' WHEN 1 THEN 'Shale' WHEN 2 THEN 'Chalk' WHEN 3 THEN "
    "'Coal' ELSE '12345' END AS lithology FROM lineitem"
)
def q_lithology_name(s, d):
    k = F.col("l_suppkey") % 5
    code = F.when(k == 0, 30000).when(k == 1, 65000).when(k == 2, 70032).when(k == 3, 90000).otherwise(12345)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.lithology_name(code).alias("lithology"))


@query(
    f"WITH {INTERVALS}, sets AS (SELECT well_id, list_sort(list(DISTINCT formation_name)) AS f, list_sort(list(DISTINCT group_name)) AS g "
    "FROM intervals GROUP BY well_id) SELECT a.well_id, b.well_id AS other, round(CAST(len(list_intersect(a.f, b.f)) AS DOUBLE) / "
    "len(list_distinct(list_concat(a.f, b.f))), 9) AS formations, round(CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / "
    "len(list_distinct(list_concat(a.g, b.g))), 9) AS groups, array_to_string(CASE WHEN len(list_intersect(a.f, b.f)) > 0 THEN "
    "list_sort(list_intersect(a.f, b.f)) ELSE list_sort(list_intersect(a.g, b.g)) END, ',') AS shared FROM sets a JOIN sets b ON "
    "b.well_id = a.well_id + 1"
)
def q_jaccard(s, d):
    sets = intervals(s, d).groupBy("well_id").agg(F.collect_set("formation_name").alias("f"), F.collect_set("group_name").alias("g"))
    nxt = sets.select((F.col("well_id") - 1).alias("well_id"), F.col("well_id").alias("other"), F.col("f").alias("f2"), F.col("g").alias("g2"))
    return sets.join(nxt, "well_id").select(
        "well_id", "other", F.round(S.jaccard("f", "f2"), 9).alias("formations"), F.round(S.jaccard("g", "g2"), 9).alias("groups"),
        F.array_join(S.shared_names("f", "f2", "g", "g2"), ",").alias("shared"),
    )


# ------------------------------------------------------------------ ordering and top-k


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 25 OFFSET 50")
def q_paginate(s, d):
    page, _ = K.paginate(table(s, d, "customer").select("c_custkey", "c_name"), ["c_name"], 25, 50)
    return page


@query("SELECT count(*) AS total FROM customer")
def q_page_total(s, d):
    return K.paginate(table(s, d, "customer"), ["c_name"], 25, 50)[1]


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
    "ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3"
)
def q_top_k_per_query(s, d):
    df = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return K.top_k_per_query(df, 3, "o_custkey", "o_totalprice", "o_orderkey")


EVIDENCE = (
    f"{HISTORY}, evidence AS (SELECT well_id AS query_id, event_id, well_id, CASE WHEN event_id % 13 <> 0 THEN depth_start_m - 500 END AS "
    "offset_m, round((event_id % 50) / 50.0, 4) AS similarity_score FROM history)"
)


def evidence(s, d):
    return history(s, d).select(
        F.col("well_id").alias("query_id"), "event_id", "well_id",
        F.when(F.col("event_id") % 13 != 0, F.col("depth_start_m") - 500).alias("offset_m"),
        F.round(F.col("event_id") % 50 / 50.0, 4).alias("similarity_score"),
    )


@query(
    f"WITH {EVIDENCE} SELECT query_id, min(CASE WHEN offset_m > 0 THEN offset_m END) AS nearest_ahead_m, "
    "min(CASE WHEN offset_m > 0 THEN (offset_m, event_id) END).event_id AS nearest_ahead_event, count(offset_m) AS placed, "
    "count(*) - count(offset_m) AS unplaced, greatest(count(offset_m) - 7, 0) AS not_drawn FROM "
    "(SELECT query_id, event_id, offset_m FROM evidence) GROUP BY query_id".replace(
        "min(CASE WHEN offset_m > 0 THEN (offset_m, event_id) END).event_id",
        "min(CASE WHEN offset_m > 0 THEN {'o': offset_m, 'event_id': event_id} END).event_id",
    )
)
def q_evidence_radar(s, d):
    return K.evidence_radar(evidence(s, d))


@query(
    f"WITH {EVIDENCE} SELECT query_id, event_id, offset_m, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "
    "query_id ORDER BY abs(offset_m), event_id) AS r FROM evidence WHERE offset_m IS NOT NULL) WHERE r <= 7"
)
def q_nearest_markers(s, d):
    return K.nearest_markers(evidence(s, d)).select("query_id", "event_id", "offset_m", "rank")


@query(f"WITH {EVIDENCE} SELECT query_id, event_id, offset_m, similarity_score FROM evidence")
def q_sort_evidence(s, d):
    return K.sort_evidence(evidence(s, d)).select("query_id", "event_id", "offset_m", "similarity_score")


@query(f"WITH {INTERVALS} SELECT * FROM intervals")
def q_ordered_reads(s, d):
    return K.ordered(intervals(s, d), "well_id", "depth_top_m", "depth_base_m")


@query(
    "SELECT c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, CAST(s_nationkey AS BIGINT), 'supplier' FROM supplier "
    "UNION ALL SELECT n_name, NULL, CAST(n_nationkey AS BIGINT), NULL FROM nation"
)
def q_union_frames(s, d):
    c = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("kind"))
    p = table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("name"))
    return C.union_frames(c, p, n).select("name", "balance", "nation", "kind")


@query("SELECT vec_id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def q_check_dimension(s, d):
    e = table(s, d, "embeddings").select("vec_id", V.check_dimension("embedding", 64).alias("v"))
    total = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.size("v").alias("width"), F.round(total, 5).alias("total"))


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END AS l_quantity, l_returnflag FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'A'"
)
def q_write_and_read_features(s, d):
    """A table replaced, one of its partitions replaced, rows appended, and the needed columns read."""
    path = f"{checkpoint_folder(s)}/table-{uuid.uuid4().hex}"
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    O.write_table(df.limit(0), path, partition="l_returnflag")
    O.write_table(df, path, partition="l_returnflag")
    O.write_table(df.where("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 100), path, "replace_partitions", "l_returnflag")
    O.write_table(df.where("l_returnflag = 'A'").withColumn("l_quantity", -F.col("l_quantity")), path, "append", "l_returnflag")
    return R.read_features(s, path, ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_quantity"])
