"""Nearest, interval, band and radius joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.operators import joins as J
from catalog.base import (
    ASKED,
    HISTORY,
    INTERVALS,
    PLACES,
    SEGMENTS,
    TELE,
    asked,
    history,
    intervals,
    places,
    query,
    segments,
    table,
    tele,
    us,
)

# errors are the messages, every other event is telemetry with a depth
ASOF = (
    f"WITH {TELE}, m AS (SELECT event_id, well_name, \"timestamp\" AS ts FROM tele WHERE event_type = 'error'), t AS (SELECT well_name, "
    "\"timestamp\" AS tt, bit_depth_m FROM tele WHERE event_type <> 'error'), b AS (SELECT m.*, t.tt AS bt, t.bit_depth_m AS bd FROM m ASOF LEFT "
    "JOIN t ON m.well_name = t.well_name AND m.ts >= t.tt), f AS (SELECT m.event_id, t.tt AS ft, t.bit_depth_m AS fd FROM m ASOF LEFT JOIN t ON "
    "m.well_name = t.well_name AND m.ts <= t.tt), c AS (SELECT b.event_id, b.well_name, CASE WHEN ft IS NULL OR ts - bt <= ft - ts THEN bd ELSE "
    "fd END AS d, CASE WHEN ft IS NULL OR ts - bt <= ft - ts THEN ts - bt ELSE ft - ts END AS g FROM b JOIN f ON b.event_id = f.event_id) "
    "SELECT event_id, well_name, CASE WHEN g <= INTERVAL '6 hours' THEN d END AS depth_m, CASE WHEN g <= INTERVAL '6 hours' THEN "
    "'telemetry_time_join' ELSE 'unresolved' END AS depth_source FROM c"
)


@query(ASOF)
def q_recover_depths(s, d):
    t = tele(s, d)
    m = t.where("event_type = 'error'").select("event_id", "well_name", F.col("timestamp").alias("recorded_at"))
    ref = t.where("event_type <> 'error'").select("well_name", "timestamp", "bit_depth_m", F.lit(None).cast("double").alias("hole_depth_m"))
    return J.recover_depths(m, ref, tolerance_s=6 * 3600.0).select("event_id", "well_name", "depth_m", "depth_source")


@query(
    f"WITH {ASKED}, {INTERVALS}, r AS (SELECT query_id, i.*, row_number() OVER (PARTITION BY query_id ORDER BY depth_top_m, depth_base_m, "
    "formation_name, group_name) AS r FROM asked a JOIN intervals i ON a.well_id = i.well_id AND a.depth_m BETWEEN depth_top_m AND depth_base_m) "
    "SELECT a.query_id, a.well_id, a.depth_m, r.group_name, r.formation_name, r.depth_top_m, r.depth_base_m FROM asked a LEFT JOIN r ON "
    "a.query_id = r.query_id AND r.r = 1"
)
def q_formation_at(s, d):
    return J.formation_at(asked(s, d), intervals(s, d), width=50.0)


@query(
    f"WITH {SEGMENTS}, {INTERVALS}, n AS (SELECT segment_id, list_sort(list(DISTINCT nullif(formation_name, ''))) AS f, "
    "list_sort(list(DISTINCT nullif(group_name, ''))) AS g FROM segs s JOIN intervals i ON s.well_id = i.well_id AND depth_base_m >= segment_top_m AND "
    "depth_top_m <= segment_base_m GROUP BY segment_id) SELECT segment_id, array_to_string(f, ',') AS formations, array_to_string(g, ',') AS groups FROM n"
)
def q_formations_in_window(s, d):
    w = segments(s, d).select("segment_id", "well_id", F.col("segment_top_m").alias("lo"), F.col("segment_base_m").alias("hi"))
    out = J.formations_in_window(w, intervals(s, d), ["segment_id"], width=50.0)
    return out.select("segment_id", F.array_join("formations", ",").alias("formations"), F.array_join("groups", ",").alias("groups"))


NEAR = (
    f"WITH {TELE}, q AS (SELECT o_orderkey AS query_id, o_custkey % 150 AS well_name, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 450 END AS "
    "depth_m FROM orders), u AS (SELECT well_name, bit_depth_m AS p, arg_max(event_id, \"timestamp\") AS event_id, max(\"timestamp\") AS ts FROM tele "
    "GROUP BY 1, 2), b AS (SELECT q.*, u.p AS bp, u.event_id AS be, u.ts AS bt FROM q ASOF LEFT JOIN u ON q.well_name = u.well_name AND q.depth_m >= "
    "u.p), f AS (SELECT q.query_id, u.p AS fp, u.event_id AS fe, u.ts AS ft FROM q ASOF LEFT JOIN u ON q.well_name = u.well_name AND q.depth_m < u.p), "
    "c AS (SELECT b.query_id, b.well_name, b.depth_m, CASE WHEN bp IS NOT NULL AND (fp IS NULL OR depth_m - bp < fp - depth_m OR (depth_m - bp = fp - "
    "depth_m AND bt >= ft)) THEN be ELSE fe END AS e, CASE WHEN bp IS NOT NULL AND (fp IS NULL OR depth_m - bp <= fp - depth_m) THEN depth_m - bp ELSE "
    "fp - depth_m END AS g FROM b JOIN f ON b.query_id = f.query_id) "
)


def _orders_asked(s, d):
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 150).alias("well_name"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 450).alias("depth_m"),
    )


@query(
    NEAR + ", l AS (SELECT well_name, arg_max(event_id, \"timestamp\") AS e FROM tele GROUP BY 1) SELECT c.query_id, CASE WHEN c.depth_m IS NULL THEN "
    "l.e ELSE c.e END AS event_id, round(CASE WHEN c.depth_m IS NOT NULL THEN g END, 6) AS gap FROM c LEFT JOIN l ON c.well_name = l.well_name"
)
def q_telemetry_near_depth(s, d):
    t = tele(s, d).select("well_name", "bit_depth_m", F.col("timestamp").alias("recorded_at"), "event_id")
    out = J.telemetry_near_depth(_orders_asked(s, d), t, ["event_id"], well="well_name", width=70.0)
    return out.select("query_id", "event_id", F.round("gap", 6).alias("gap"))


@query(NEAR + "SELECT query_id, CAST(CASE WHEN g <= 25 THEN e END AS VARCHAR) AS event_id, round(CASE WHEN g <= 25 THEN g END, 6) AS gap FROM c")
def q_anomaly_near_depth(s, d):
    t = tele(s, d).select("well_name", "bit_depth_m", "event_id", "timestamp")
    out = J.near_within(
        _orders_asked(s, d), t, ["event_id"], 25.0, "well_name", r_depth="bit_depth_m", prefer=F.unix_micros("timestamp").cast("double"), width=70.0
    )
    return out.select("query_id", F.col("event_id").cast("string").alias("event_id"), F.round("gap", 6).alias("gap"))


@query(
    "WITH q AS (SELECT o_orderkey AS query_id, o_custkey % 100 AS well, round(o_totalprice / 5, 2) AS depth_m FROM orders), u AS (SELECT l_suppkey AS well, "
    "l_extendedprice AS p, min(l_discount) AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT q.*, u.p AS bp FROM q ASOF LEFT JOIN u ON q.well = u.well AND "
    "q.depth_m >= u.p), f AS (SELECT q.query_id, u.p AS fp FROM q ASOF LEFT JOIN u ON q.well = u.well AND q.depth_m < u.p) SELECT b.query_id, CASE WHEN bp "
    "IS NOT NULL AND depth_m - bp <= 10 AND (fp IS NULL OR depth_m - bp <= fp - depth_m) THEN bp WHEN fp - depth_m <= 10 THEN fp END AS depth FROM b JOIN f "
    "ON b.query_id = f.query_id"
)
def q_lithology_near_depth(s, d):
    q = table(s, d, "orders").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 100).alias("well_id"), F.round(F.col("o_totalprice") / 5, 2).alias("depth_m")
    )
    p = table(s, d, "lineitem").select(F.col("l_suppkey").alias("well_id"), F.col("l_extendedprice").alias("_d"), F.col("l_extendedprice").alias("depth"))
    out = J.near_within(q, p, ["depth"], 10.0, r_depth="_d", width=500.0)
    return out.select("query_id", "depth")


@query(
    f"WITH {ASKED}, {HISTORY}, m AS (SELECT query_id, depth_m, (well_id + k * 7) % 100 AS well_id, 'W' || ((well_id + k * 7) % 100) AS well_name, 0.9 - k * 0.1 AS "
    "score FROM asked, (SELECT unnest(range(1, 6)) AS k)) SELECT m.query_id, m.well_id, m.well_name, h.event_id, h.category, depth_start_m, round(m.score::DOUBLE, 4) AS "
    "similarity_score, round(depth_start_m - depth_m, 1) AS offset_m FROM m JOIN history h ON h.well_id = m.well_id WHERE h.category IS NOT NULL AND score >= 0.5 AND "
    "h.depth_start_m BETWEEN depth_m - 150 AND depth_m + 150"
)
def q_historical_evidence(s, d):
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    m = asked(s, d).select("query_id", "depth_m", "well_id", k.alias("k")).select(
        "query_id", "depth_m", ((F.col("well_id") + F.col("k") * 7) % 100).alias("well_id"), F.round(0.9 - F.col("k") * 0.1, 4).alias("score")
    ).withColumn("well_name", F.concat(F.lit("W"), F.col("well_id").cast("string")))
    out = J.historical_evidence(m, history(s, d))
    return out.select("query_id", "well_id", "well_name", "event_id", "category", "depth_start_m", "similarity_score", "offset_m")


DIST = (
    "6371.0088 * acos(least(1, greatest(-1, cos(radians(c.latitude)) * cos(radians(p.latitude)) * cos(radians(p.longitude) - radians(c.longitude)) + "
    "sin(radians(c.latitude)) * sin(radians(p.latitude)))))"
)


@query(
    f"WITH {PLACES}, n AS (SELECT c.well_id AS query_id, p.well_id, {DIST} AS km FROM places c JOIN places p ON c.well_id <> p.well_id WHERE c.longitude IS NOT NULL "
    "AND p.longitude IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY km, well_id) AS r FROM n WHERE km <= 50) SELECT query_id, "
    "well_id, round(km, 5) AS distance_km, CAST(r AS INT) AS rank FROM r WHERE r <= 10"
)
def q_wells_within(s, d):
    p = places(s, d)
    q = p.select(F.col("well_id").alias("query_id"), F.col("well_id").alias("query_well_id"), "latitude", "longitude")
    out = J.wells_within(q, p.select("well_id", "latitude", "longitude"), 50.0, 10)
    return out.select("query_id", "well_id", F.round("distance_km", 5).alias("distance_km"), "rank")


@query(
    "SELECT v.vec_id AS chunk_id, d.doc_id AS document_id, d.source AS title, s.s_name AS well_name FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN "
    "supplier s ON s.s_suppkey = d.doc_id % 150 WHERE v.vec_id % 5 <> 0"
)
def q_passages(s, d):
    v = F.col("vec_id")
    chunks = table(s, d, "embeddings").select(v.alias("chunk_id"), v.alias("document_id"), F.when(v % 5 != 0, F.col("embedding")).alias("embedding"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), (F.col("doc_id") % 150).alias("well_id"))
    wells = table(s, d, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_name").alias("well_name"))
    return J.passages(chunks, docs, wells).select("chunk_id", "document_id", "title", "well_name")


def _named_orders(s, d):
    return table(s, d, "orders").select("o_orderkey", F.format_string("Supplier#%09d", F.col("o_custkey") % 120).alias("well_name"))


def _named_wells(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_name").alias("well_name"))


@query("SELECT o_orderkey, s_name AS well_name, s_suppkey AS well_id FROM orders JOIN supplier ON s_name = printf('Supplier#%09d', o_custkey % 120)")
def q_attach_ids(s, d):
    return J.attach_ids(_named_orders(s, d), _named_wells(s, d))[0]


@query(
    "SELECT n AS well_name, count(*) AS rows FROM (SELECT printf('Supplier#%09d', o_custkey % 120) AS n FROM orders) WHERE n NOT IN (SELECT s_name FROM supplier) GROUP BY n"
)
def q_unmatched_names(s, d):
    return J.attach_ids(_named_orders(s, d), _named_wells(s, d))[1]


@query(
    f"WITH {PLACES} SELECT c_custkey, longitude, latitude FROM customer LEFT JOIN places ON well_name = printf('Supplier#%09d', c_custkey)"
)
def q_attach_positions(s, d):
    w = table(s, d, "customer").select("c_custkey", F.format_string("Supplier#%09d", "c_custkey").alias("join_name"))
    p = places(s, d).select(F.col("well_name").alias("join_name"), "latitude", "longitude")
    return J.attach_positions(w, p)[0].select("c_custkey", "longitude", "latitude")


@query(
    "SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'O' AND x.o_custkey = "
    "o.o_custkey AND x.o_orderpriority = o.o_orderpriority)"
)
def q_new_rows_only(s, d):
    o = table(s, d, "orders")
    new = o.where("o_orderstatus <> 'O'").select("o_custkey", "o_orderpriority", "o_orderkey")
    old = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority")
    return J.new_rows_only(new, old, ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE printf('Supplier#%09d', o_custkey % 120) IN (SELECT s_name FROM supplier)")
def q_known_wells_only(s, d):
    return J.known_wells_only(_named_orders(s, d), _named_wells(s, d)).select("o_orderkey")


@query(
    "SELECT o_orderkey AS event_id, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
)
def q_event_mitigations(s, d):
    e = table(s, d, "orders").select(F.col("o_orderkey").alias("event_id"))
    m = table(s, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_linenumber", "l_partkey")
    return J.event_mitigations(e, m).withColumns(
        {c: F.col(c).cast("string") for c in ("l_linenumber", "l_partkey")}
    )


@query(
    "SELECT e.event_id, p.p_partkey FROM events e JOIN part p ON e.user_id % 100 = p.p_partkey % 100 AND e.value BETWEEN p.p_retailprice - 900 AND p.p_retailprice - 900 + p.p_size"
)
def q_range_join(s, d):
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 100).alias("well_id"), "value")
    p = table(s, d, "part").select(
        "p_partkey", (F.col("p_partkey") % 100).alias("well_id"), (F.col("p_retailprice") - 900).alias("lo"), (F.col("p_retailprice") - 900 + F.col("p_size")).alias("hi")
    )
    return J.range_join(e, p, ["well_id"], "value", "lo", "hi", 20.0).select("event_id", "p_partkey")
