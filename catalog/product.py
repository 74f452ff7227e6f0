"""Analogue ranking, passage search, risk and the batch builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.operators import profile as P
from borelight.plans import builds as B
from borelight.plans import risk as K
from borelight.plans import similarity as M
from borelight.sources import writers as O
from catalog.base import (
    ASKED,
    CURVES,
    FIELD,
    HISTORY,
    INTERVALS,
    LOGS,
    TELE,
    TIES,
    asked,
    field,
    history,
    intervals,
    logs,
    query,
    rounded,
    segments,
    table,
    tele,
)

DOT = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT query_id, vec_id, "
    f"{DOT} AS similarity FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, round(similarity, 6) AS "
    "similarity, CAST(r AS INT) AS rank FROM r WHERE r <= 10"
)
def q_nearest_vectors(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(M.nearest_vectors(e.select("vec_id", "embedding"), q, 10, "vec_id"), 6, "similarity")


@query(
    "WITH q AS (SELECT b.item_id AS query_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), c AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 <> 0), s AS (SELECT query_id, vec_id AS chunk_id, "
    f"{DOT} AS x FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, chunk_id) AS r FROM s) SELECT query_id, chunk_id, round(x, 4) AS similarity, CAST(r AS INT) AS rank, d.text AS passage, d.source AS title, s.s_name AS "
    "well_name FROM r LEFT JOIN documents d ON d.doc_id = chunk_id LEFT JOIN supplier s ON s.s_suppkey = d.doc_id % 150 WHERE r <= 10 AND x >= 0.25"
)
def q_search_passages(s, d):
    v = F.col("vec_id")
    e = table(s, d, "embeddings")
    chunks = e.select(
        v.alias("chunk_id"), v.alias("document_id"), F.lit(1).alias("page_number"), F.when(v % 5 != 0, F.col("embedding")).alias("embedding")
    )
    chunks = chunks.join(table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text"), "document_id", "left")
    q = table(s, d, "benchmark").join(e, F.col("item_id") == v).select(F.col("item_id").alias("query_id"), "text", "embedding")
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), (F.col("doc_id") % 150).alias("well_id"))
    wells = table(s, d, "supplier").select(F.col("s_suppkey").alias("well_id"), F.col("s_name").alias("well_name"))
    return M.search_passages(q, chunks, docs, wells).select("query_id", "chunk_id", "similarity", "rank", "passage", "title", "well_name")


@query(
    "SELECT count(*) FILTER (WHERE vec_id % 5 <> 0) AS passages_searched, count(*) AS chunks_total, (count(*) FILTER (WHERE vec_id % 5 = 0)) || ' stored passage(s) have no embedding and were not searched.' AS note FROM embeddings"
)
def q_search_provenance(s, d):
    c = table(s, d, "embeddings").select(F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"))
    return M.search_provenance(c, "given").select("passages_searched", "chunks_total", "note")


BEHAVE = (
    f"{TELE}, prof AS (SELECT well_name AS well_id, median(flow_in_lpm) AS f, median(bit_rpm) AS b FROM tele WHERE flow_in_lpm > 30 AND well_name % 6 <> 5 GROUP BY 1)"
)


def profiles(s, d):
    t = tele(s, d).withColumn("operations_active", (F.col("flow_in_lpm") > 30) & (F.col("well_name") % 6 != 5))
    return P.behaviour_profile(t, ["flow_in_lpm", "bit_rpm"], "well_name").withColumnRenamed("well_name", "well_id")


HAV = "CASE WHEN w.latitude IS NOT NULL AND q.qlat IS NOT NULL THEN 2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(w.latitude - q.qlat) / 2), 2) + cos(radians(w.latitude)) * cos(radians(q.qlat)) * power(sin(radians(w.longitude - q.qlon) / 2), 2)))) END"


def analogue_sql(k=5, asked_cte="asked"):
    """Brute force over every (query, well, segment) for the small test scale."""
    jac = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
    return f"""
 q0 AS (SELECT a.query_id, a.well_id, coalesce(a.depth_m, w.total_depth_m, 0) AS depth_m, w.latitude AS qlat, w.longitude AS qlon FROM {asked_cte} a JOIN field w ON a.well_id = w.well_id),
 qv AS (SELECT query_id, embedding FROM (SELECT q0.query_id, s.embedding, row_number() OVER (PARTITION BY q0.query_id ORDER BY CASE WHEN segment_top_m <= depth_m AND segment_base_m >= depth_m THEN 0 ELSE 1 END,
   CASE WHEN segment_top_m <= depth_m AND segment_base_m >= depth_m THEN 0 ELSE abs((segment_top_m + segment_base_m) / 2 - depth_m) END, segment_top_m) AS r FROM q0 JOIN segs s ON s.well_id = q0.well_id) WHERE r = 1),
 qf AS (SELECT q0.query_id, list(DISTINCT formation_name) AS f, list(DISTINCT group_name) AS g FROM q0 JOIN intervals i ON i.well_id = q0.well_id AND depth_base_m >= greatest(0, depth_m - 50) AND depth_top_m <= depth_m + 50 GROUP BY 1),
 q AS (SELECT q0.*, qv.embedding, qf.f AS qf, qf.g AS qg, p.f AS qpf, p.b AS qpb FROM q0 LEFT JOIN qv ON qv.query_id = q0.query_id LEFT JOIN qf ON qf.query_id = q0.query_id LEFT JOIN prof p ON p.well_id = q0.well_id),
 best AS (SELECT query_id, well_id, segment_top_m, segment_base_m, dominant_formation, cosv FROM (SELECT q.query_id, s.*, least(1, greatest(0, (list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) + 1) / 2)) AS cosv,
   row_number() OVER (PARTITION BY q.query_id, s.well_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) DESC, segment_top_m) AS r FROM q JOIN segs s ON s.well_id <> q.well_id) WHERE r = 1),
 cf AS (SELECT b.query_id, b.well_id, list(DISTINCT formation_name) AS f, list(DISTINCT group_name) AS g FROM best b JOIN intervals i ON i.well_id = b.well_id AND depth_base_m >= b.segment_top_m AND depth_top_m <= b.segment_base_m GROUP BY 1, 2),
 comp AS (SELECT q.query_id, w.well_id, w.well_name, q.depth_m, b.segment_top_m, b.dominant_formation, b.cosv AS geology,
   CASE WHEN q.qf IS NOT NULL AND cf.f IS NOT NULL THEN greatest({jac.format(a='q.qf', b='cf.f')}, {jac.format(a='q.qg', b='cf.g')}) END AS formation,
   exp(-abs((b.segment_top_m + b.segment_base_m) / 2 - q.depth_m) / 300) AS depth,
   CASE WHEN q.qpf IS NOT NULL AND p.f IS NOT NULL THEN (exp(-abs(q.qpf - p.f) / 800) + exp(-abs(q.qpb - p.b) / 30)) / 2 END AS behaviour, {HAV} AS km
   FROM q JOIN field w ON w.well_id <> q.well_id JOIN best b ON b.query_id = q.query_id AND b.well_id = w.well_id LEFT JOIN cf ON cf.query_id = q.query_id AND cf.well_id = w.well_id LEFT JOIN prof p ON p.well_id = w.well_id),
 sc AS (SELECT *, exp(-km / 25) AS geography, (coalesce(geology * 0.3, 0) + coalesce(formation * 0.2, 0) + coalesce(depth * 0.15, 0) + coalesce(behaviour * 0.2, 0) + coalesce(exp(-km / 25) * 0.15, 0)) / ((geology IS NOT NULL)::INT * 0.3 +
   (formation IS NOT NULL)::INT * 0.2 + (depth IS NOT NULL)::INT * 0.15 + (behaviour IS NOT NULL)::INT * 0.2 + (km IS NOT NULL)::INT * 0.15) AS score FROM comp),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, well_id) AS r FROM sc),
 top AS (SELECT * FROM ranked WHERE r <= {k})"""


SCALES = {"flow_in_lpm": 800.0, "bit_rpm": 30.0}


def _analogues(s, d, q=None, k=5):
    return M.rank_analogues(q or asked(s, d), field(s, d), segments(s, d), intervals(s, d), profiles(s, d), k, scales=SCALES, bucket=50.0)


@query(
    f"WITH {FIELD}, {INTERVALS}, {ASKED}, {BEHAVE}, {analogue_sql()} SELECT query_id, well_id, well_name, round(score, 6) AS score, round(geology, 6) AS geology, round(formation, 6) AS formation, round(depth, 6) AS depth, round(behaviour, 6) AS "
    "drilling_behaviour, round(geography, 6) AS geography, round(km, 4) AS distance_km, segment_top_m, dominant_formation, concat_ws(',', CASE WHEN geology IS NULL THEN 'geology' END, CASE WHEN formation IS NULL THEN 'formation' END, CASE WHEN "
    "depth IS NULL THEN 'depth' END, CASE WHEN behaviour IS NULL THEN 'drilling_behaviour' END, CASE WHEN km IS NULL THEN 'geography' END) AS unavailable, CAST(r AS INT) AS rank FROM top"
)
def q_rank_analogues(s, d):
    out = rounded(_analogues(s, d), 6, "score", "geology", "formation", "depth", "drilling_behaviour", "geography")
    return out.select(
        "query_id", "well_id", "well_name", "score", "geology", "formation", "depth", "drilling_behaviour", "geography", F.round("distance_km", 4).alias("distance_km"),
        "segment_top_m", "dominant_formation", F.array_join("dimensions_unavailable", ",").alias("unavailable"), "rank",
    )


RISK_FIXED = "tel AS (SELECT well_name AS well_id, bit_depth_m, \"timestamp\" AS tm, flow_in_lpm * 3 AS p, bit_rpm / 2 - 25 AS g, event_type, flow_in_lpm / 500 AS score FROM tele)"


def _risk_frames(s, d):
    t = tele(s, d)
    channels = F.create_map(
        F.lit("standpipe_pressure_bar"), F.col("flow_in_lpm") * 3, F.lit("pit_gain_loss_m3"), F.col("bit_rpm") / 2 - 25
    )
    telemetry = t.select(F.col("well_name").alias("well_id"), F.col("timestamp").alias("recorded_at"), "bit_depth_m", channels.alias("channels"))
    scores = t.where("event_type = 'error'").select(
        F.col("well_name").alias("well_id"), F.col("timestamp").alias("recorded_at"), F.col("bit_depth_m").alias("depth_m"), (F.col("flow_in_lpm") / 500).alias("score")
    )
    return telemetry, scores


def risk(s, d):
    telemetry, scores = _risk_frames(s, d)
    return K.assess_risk(
        asked(s, d), field(s, d), telemetry, scores, segments(s, d), intervals(s, d), profiles(s, d), history(s, d), scales=SCALES, bucket=50.0, width=100.0
    )


IN_SQL = (
    "near AS (SELECT * FROM (SELECT a.query_id, a.well_id, a.depth_m AS asked_m, t.bit_depth_m, t.p, t.g, row_number() OVER (PARTITION BY a.query_id ORDER BY abs(t.bit_depth_m - a.depth_m) NULLS LAST, t.tm DESC) AS r FROM asked a LEFT JOIN tel t ON "
    "t.well_id = a.well_id) WHERE r = 1), inp AS (SELECT query_id, well_id, coalesce(asked_m, bit_depth_m) AS depth_m, CASE WHEN abs(bit_depth_m - coalesce(asked_m, bit_depth_m)) <= 25 THEN p END AS p, CASE WHEN abs(bit_depth_m - coalesce(asked_m, "
    "bit_depth_m)) <= 25 THEN g END AS g FROM near), ano AS (SELECT query_id, CASE WHEN gap <= 25 THEN score END AS score FROM (SELECT i.query_id, t.score, abs(t.bit_depth_m - i.depth_m) AS gap, row_number() OVER (PARTITION BY i.query_id ORDER BY "
    "abs(t.bit_depth_m - i.depth_m), t.tm DESC) AS r FROM inp i JOIN tel t ON t.well_id = i.well_id AND t.event_type = 'error') WHERE r = 1)"
)
RULES = "((p > 350)::INT + (g < -20)::INT + (g > 20)::INT) / 5"


@query(
    f"WITH {FIELD}, {ASKED}, {TELE}, {RISK_FIXED}, {IN_SQL} SELECT i.query_id, depth_m, p, g, round(a.score, 9) AS anomaly_score FROM inp i LEFT JOIN ano a ON a.query_id = i.query_id"
)
def q_resolve_inputs(s, d):
    telemetry, scores = _risk_frames(s, d)
    out = K.resolve_inputs(asked(s, d), telemetry, scores)
    return out.select(
        "query_id", "depth_m", F.col("measurements")["standpipe_pressure_bar"].alias("p"), F.col("measurements")["pit_gain_loss_m3"].alias("g"),
        F.round("anomaly_score", 9).alias("anomaly_score"),
    )


RISK = (
    f"WITH {FIELD}, {INTERVALS}, {HISTORY}, {ASKED}, {BEHAVE}, {RISK_FIXED}, {IN_SQL}, {analogue_sql(asked_cte='inp')}, "
    "ev AS (SELECT t.query_id, t.well_name, round(t.score, 4) AS sim, round(h.depth_start_m - i.depth_m, 1) AS off FROM top t JOIN inp i ON i.query_id = t.query_id JOIN history h ON h.well_id = t.well_id WHERE h.category IS NOT NULL AND t.score >= 0.5 AND "
    "h.depth_start_m BETWEEN i.depth_m - 150 AND i.depth_m + 150), es AS (SELECT query_id, count(*) AS n, min(abs(off)) AS nearest, max(sim) AS sim FROM ev GROUP BY 1), fin AS (SELECT i.query_id, i.depth_m, a.score AS an, greatest(0, 1 - es.nearest / 150) * "
    f"es.sim AS hi, CASE WHEN p IS NOT NULL THEN {RULES} END AS ru, coalesce(es.n, 0) AS evidence_count FROM inp i JOIN field f ON f.well_id = i.well_id LEFT JOIN ano a ON a.query_id = i.query_id LEFT JOIN es ON es.query_id = i.query_id), tot AS (SELECT *, "
    "coalesce((coalesce(an * 0.4, 0) + coalesce(hi * 0.4, 0) + coalesce(ru * 0.2, 0)) / nullif((an IS NOT NULL)::INT * 0.4 + (hi IS NOT NULL)::INT * 0.4 + (ru IS NOT NULL)::INT * 0.2, 0), 0) AS s FROM fin)"
)


@query(
    f"{RISK} SELECT query_id, depth_m, round(s, 6) AS score, CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.65 THEN 'HIGH' WHEN s >= 0.45 THEN 'MEDIUM' WHEN s >= 0.25 THEN 'LOW' ELSE 'INFO' END AS risk_level, (an IS NOT NULL OR hi IS NOT NULL OR ru IS NOT "
    "NULL) AS evaluated, evidence_count FROM tot"
)
def q_assess_risk(s, d):
    return rounded(risk(s, d).assessments.select("query_id", "depth_m", "score", "risk_level", "evaluated", "evidence_count"), 6, "score")


@query(f"{RISK} SELECT query_id, well_name, sim AS similarity_score, off AS offset_m, count(*) AS records FROM ev GROUP BY ALL")
def q_risk_evidence(s, d):
    return risk(s, d).evidence.groupBy("query_id", "well_name", "similarity_score", "offset_m").agg(F.count(F.lit(1)).alias("records"))


@query(
    f"WITH {LOGS} SELECT well, ok, ln, CAST(depth AS FLOAT)::DOUBLE AS depth, CAST(tax AS FLOAT)::DOUBLE AS tax FROM logs"
)
def q_narrow_features(s, d):
    out = O.narrow_features(logs(s, d), ["well", "ok", "ln", "depth", "tax"])
    return out.withColumns({"depth": F.col("depth").cast("double"), "tax": F.col("tax").cast("double")})


@query(
    f"WITH {LOGS}, x AS (SELECT * FROM logs WHERE depth IS NOT NULL) SELECT well, ok, ln, depth, qty, round((disc - lag(disc) OVER w) / nullif(depth - lag(depth) OVER w, 0), 7) AS disc_grad, "
    "round(avg(disc) OVER (PARTITION BY well ORDER BY depth, ok, ln ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 7) AS disc_roll300m_mean FROM x WINDOW w AS (PARTITION BY well ORDER BY depth, ok, ln)"
)
def q_prepare_logs(s, d):
    df = logs(s, d).drop("group_name", "formation_name")
    got = B.prepare_logs(df, "well", "depth", excluded=TIES, windows_m=(300.0,), ties=TIES, sentinels=(-999.0,), curves=list(CURVES), spacing=300.0)
    out = got.features.select("well", *TIES, "depth", "qty", "disc_grad", "disc_roll300m_mean")
    return rounded(out, 7, "disc_grad", "disc_roll300m_mean")
