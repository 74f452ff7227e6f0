"""Profiles, counts, metrics and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.operators import clean as C
from borelight.operators import metrics as M
from borelight.operators import profile as P
from borelight.operators import quantiles as Q
from borelight.sources import registry as R
from catalog.base import LOGS, PLACES, TELE, logs, places, query, rounded, table, tele, us
from catalog.cleaning import UNIT_OF, UNIT_SQL, _with_unit
from catalog.timeline import STATE, _state


def _profile_sql(cols):
    parts = []
    for c, kind in cols.items():
        num = kind != "string"
        x = f"CAST({c} AS DOUBLE)"
        stats = f"min({x}), max({x}), round(avg({x}), 6), round(stddev_samp({x}), 6)" if num else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*), 6) AS null_fraction, {stats} FROM logs"
        )
    head = ", ".join(["\"column\"", "dtype", "non_null", "null_count", "null_fraction", "\"min\"", "\"max\"", "mean", "std"])
    return f"WITH {LOGS}, p({head}) AS ({' UNION ALL '.join(parts)}) SELECT * FROM p"


@query(_profile_sql({"well": "bigint", "depth": "double", "qty": "double", "group_name": "string", "formation_name": "string"}))
def q_profile_columns(s, d):
    out = P.profile_columns(logs(s, d).select("well", "depth", "qty", "group_name", "formation_name"))
    return rounded(out, 6, "mean", "std")


@query(
    "WITH v AS (SELECT 'p_brand' AS \"column\", p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part), n AS (SELECT \"column\", value, count(*) AS "
    "rows FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY rows DESC, value) AS r, count(*) OVER (PARTITION BY \"column\") AS "
    "distinct_values FROM n) SELECT \"column\", value, rows, CAST(r AS INT) AS rank, distinct_values FROM r WHERE r <= 10"
)
def q_profile_categories(s, d):
    return P.profile_categories(table(s, d, "part"), ["p_brand", "p_type"])


@query(
    "SELECT 'l_returnflag' AS \"column\", count(DISTINCT l_returnflag) AS distinct_values FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem"
)
def q_distinct_counts(s, d):
    return P.distinct_counts(table(s, d, "lineitem"), ["l_returnflag", "l_suppkey"])


@query("SELECT p_brand, count(*) AS rows FROM part GROUP BY p_brand ORDER BY rows DESC, p_brand LIMIT 30")
def q_top_values(s, d):
    return P.top_values(table(s, d, "part"), "p_brand", 30)


@query(f"WITH {LOGS} SELECT well, count(*) AS rows, min(depth) AS depth_min, max(depth) AS depth_max FROM logs GROUP BY well")
def q_well_depth_ranges(s, d):
    return P.well_depth_ranges(logs(s, d))


@query(
    f"WITH {LOGS}, n AS (SELECT well, count(*) AS r FROM logs GROUP BY well) SELECT count(*) AS wells, min(r) AS rows_min, median(r) AS rows_median, max(r) AS rows_max FROM n"
)
def q_rows_per_well(s, d):
    return P.rows_per_well(logs(s, d))


@query(
    f"WITH {LOGS} SELECT 'qty' AS curve, round(count(qty) / count(*), 9) AS coverage FROM logs UNION ALL SELECT 'tax', round(count(tax) / count(*), 9) FROM logs"
)
def q_curve_coverage(s, d):
    return rounded(P.curve_coverage(logs(s, d), ["qty", "tax"]), 9, "coverage")


@query(
    f"WITH {LOGS}, w AS (SELECT well, count(qty) > 0 AS q, count(CASE WHEN depth > 104000 THEN tax END) > 0 AS t FROM logs GROUP BY well) SELECT 'qty' AS curve, count(*) FILTER "
    "(WHERE q) AS wells FROM w UNION ALL SELECT 'deep', count(*) FILTER (WHERE t) FROM w"
)
def q_curve_well_presence(s, d):
    df = logs(s, d).withColumn("deep", F.when(F.col("depth") > 104000, F.col("tax")))
    return P.curve_well_presence(df, ["qty", "deep"])


CODES = "CASE l_linenumber WHEN 1 THEN 30000 WHEN 2 THEN 65000 WHEN 3 THEN 65030 WHEN 4 THEN 12345 END"


def _codes():
    n = F.col("l_linenumber")
    return F.when(n == 1, 30000).when(n == 2, 65000).when(n == 3, 65030).when(n == 4, 12345)


@query(
    f"WITH n AS (SELECT {CODES} AS code, count(*) AS rows FROM lineitem GROUP BY 1) SELECT CAST(code AS VARCHAR) AS code, rows, round(rows / sum(rows) OVER (), 6) AS fraction, CASE "
    "code WHEN 30000 THEN 'Sandstone' WHEN 65000 THEN 'Shale' WHEN 65030 THEN 'Sandstone/Shale' ELSE 'UNKNOWN_CODE' END AS name, round(max(rows) OVER () / min(rows) OVER (), 9) AS "
    "imbalance FROM n"
)
def q_class_distribution(s, d):
    out = P.class_distribution(table(s, d, "lineitem").select(_codes().alias("code")), "code")
    return rounded(out, 9, "imbalance").withColumn("code", F.col("code").cast("string"))


@query(
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates, round((count(*) - (SELECT count(*) FROM (SELECT "
    "DISTINCT l_orderkey, l_linenumber FROM lineitem))) / count(*), 9) AS fraction FROM lineitem"
)
def q_duplicate_keys(s, d):
    return rounded(P.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), 9, "fraction").withColumns(
        {"rows": F.col("rows").cast("long"), "duplicates": F.col("duplicates").cast("long")}
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_key_violations(s, d):
    return P.key_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) < 5")
def q_short_wells(s, d):
    return P.short_wells(table(s, d, "orders"), "o_custkey", 5)


@query(f"WITH {LOGS} SELECT count(*) - count(qty) AS null_depth_rows FROM logs")
def q_null_depth_rows(s, d):
    return P.null_depth_rows(logs(s, d), "qty")


@query(
    f"WITH {LOGS} SELECT 'qty' AS \"column\", min(qty) AS \"min\", max(qty) AS \"max\", round(1 - count(qty) / count(*), 6) AS null_fraction FROM logs UNION ALL SELECT 'depth', min(depth), max(depth), 0.0 FROM logs"
)
def q_value_range(s, d):
    return P.value_range(logs(s, d), ["qty", "depth"])


@query(
    f"WITH e AS (SELECT event_type AS mnemonic, user_id, {UNIT_OF} AS unit, CASE WHEN value > 10 THEN value END AS value FROM events) SELECT mnemonic, count(DISTINCT user_id) AS logs, "
    "count(*) AS rows, round(count(value) / count(*), 4) AS populated, string_agg(DISTINCT e.unit, ',') AS units, string_agg(DISTINCT coalesce(canonical, e.unit), ',') AS "
    f"canonical_units, bool_and(u.unit IS NOT NULL OR e.unit = 'm') AS all_known FROM e LEFT JOIN {UNIT_SQL} ON e.unit = u.unit GROUP BY mnemonic"
)
def q_channel_inventory(s, d):
    long = _with_unit(s, d).withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    out = P.channel_inventory(long, C.unit_table(s), "user_id", "event_type")
    return out.select(
        F.col("event_type").alias("mnemonic"), "logs", F.col("rows").cast("long").alias("rows"), "populated", F.array_join("units", ",").alias("units"),
        F.array_join("canonical_units", ",").alias("canonical_units"), "all_known",
    )


@query("SELECT 'furlongs' AS unit, count(*) AS rows FROM events WHERE event_type = 'signup'")
def q_unknown_units(s, d):
    return P.unknown_units(_with_unit(s, d), C.unit_table(s))


@query(
    "SELECT l_suppkey AS well_id, count(*) AS stations, min(l_extendedprice) AS md_min, max(l_extendedprice) AS md_max, max(l_quantity) AS tvd_max, max(l_tax) AS inclination_max, "
    "array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS station_types FROM lineitem GROUP BY 1"
)
def q_trajectory_summary(s, d):
    df = table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("well_id"), F.col("l_extendedprice").alias("md_m"), F.col("l_quantity").alias("tvd_m"),
        F.col("l_tax").alias("inclination_deg"), F.col("l_returnflag").alias("station_type"),
    )
    return P.trajectory_summary(df).withColumn("station_types", F.array_join("station_types", ","))


@query(
    "SELECT role, count(*) AS messages, count(CASE WHEN turn > 1 THEN turn END) AS with_depth, min(CASE WHEN turn > 1 THEN turn END)::DOUBLE AS depth_min, max(CASE WHEN turn > 1 THEN turn END)::DOUBLE AS depth_max, "
    "median(length(text)) AS median_text_length, count(DISTINCT turn) AS message_types FROM conversations GROUP BY role"
)
def q_message_summary(s, d):
    c = table(s, d, "conversations").select(
        "role", F.when(F.col("turn") > 1, F.col("turn")).cast("double").alias("md_m"), F.col("turn").alias("message_type"), "text", F.lit(None).cast("timestamp").alias("recorded_at")
    )
    return P.message_summary(c, "role").select("role", "messages", "with_depth", "depth_min", "depth_max", "median_text_length", "message_types")


@query("SELECT role, turn, count(*) AS rows FROM conversations GROUP BY ALL")
def q_message_types(s, d):
    return P.message_types(table(s, d, "conversations"), "role", "turn")


BEHAVE = (
    f"WITH {TELE}, a AS (SELECT * FROM tele WHERE flow_in_lpm > 30), m AS (SELECT well_name, median(flow_in_lpm) AS f, median(bit_rpm) AS b FROM a GROUP BY 1) SELECT well_name, "
    "unnest(['flow_in_lpm', 'bit_rpm']) AS key, round(unnest([f, b]), 6) AS value FROM m"
)


def _behave(s, d, **kw):
    t = tele(s, d).withColumn("operations_active", F.col("flow_in_lpm") > 30).withColumn("none", F.lit(None).cast("double"))
    out = P.behaviour_profile(t, ["flow_in_lpm", "bit_rpm", "none"], "well_name", **kw)
    return rounded(out.select("well_name", F.explode("profile")), 6, "value")


@query(BEHAVE)
def q_behaviour_profile(s, d):
    return _behave(s, d)


@query(BEHAVE)
def q_behaviour_profile_split(s, d):
    """The same medians with every well treated as too large for one task."""
    return _behave(s, d, max_rows=20)


@query(
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM "
    "lineitem GROUP BY 1"
)
def q_group_quantiles(s, d):
    out = Q.group_quantiles(table(s, d, "lineitem"), ["l_returnflag"], ["l_extendedprice"], [0.1, 0.5, 0.99], max_rows=5000)
    return out.select("l_returnflag", *[F.round(F.col("l_extendedprice")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


@query(
    f"WITH {PLACES} SELECT name, count FROM (SELECT 'wells' AS name, count(*) AS count FROM places UNION ALL SELECT 'wells_with_position', count(longitude) FROM places UNION ALL SELECT "
    "'wells_with_telemetry', count(*) FILTER (WHERE well_id % 2 = 0) FROM places UNION ALL SELECT 'telemetry_samples', count(*) FROM events UNION ALL SELECT 'drilling_events', count(*) FROM "
    "orders UNION ALL SELECT 'well_embeddings', count(*) FROM embeddings UNION ALL SELECT 'risk_alerts', count(*) FROM labels UNION ALL SELECT 'engineer_actions', count(*) FROM benchmark)"
)
def q_status_counts(s, d):
    w = places(s, d).select("well_id", F.col("longitude").alias("latitude"), (F.col("well_id") % 2 == 0).alias("has_telemetry"))
    return P.status_counts(w, *[table(s, d, t) for t in ("events", "orders", "embeddings", "labels", "benchmark")])


@query(
    f"WITH {PLACES} SELECT (count(*) - count(longitude)) || ' of the wells cannot be placed: no coordinates, so neither distances nor a map can use them.' AS warning FROM places HAVING "
    "count(*) > count(longitude)"
)
def q_status_warnings(s, d):
    w = places(s, d).select("well_id", F.col("longitude").alias("latitude"), F.lit(True).alias("has_telemetry"))
    none = table(s, d, "events")
    return P.status_warnings(P.status_counts(w, none, none, none, none, none), table(s, d, "orders"))


@query("SELECT count(*) AS chunks_total, count(*) FILTER (WHERE vec_id % 3 <> 0) AS chunks_embedded, TRUE AS searchable FROM embeddings")
def q_corpus_status(s, d):
    return P.corpus_status(table(s, d, "embeddings").select(F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding")))


@query(
    "SELECT count(*) FILTER (WHERE doc_id % 3 <> 0) AS embedded, count(DISTINCT CASE WHEN doc_id % 3 <> 0 THEN source END) AS documents_covered, round(avg(CASE WHEN doc_id % 3 <> 0 THEN "
    "length(text) END), 6) AS mean_characters FROM documents"
)
def q_embedding_report(s, d):
    c = table(s, d, "documents").select(F.col("source").alias("document_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.lit(1)).alias("embedding"))
    return rounded(P.embedding_report(c), 6, "mean_characters")


@query(f"WITH {PLACES} SELECT count(*) FILTER (WHERE longitude IS NULL) AS unmapped FROM places")
def q_unmapped_count(s, d):
    return P.unmapped_count(places(s, d).select(F.col("longitude").alias("latitude")))


@query(
    "SELECT source AS document_id, count(*) AS pages_processed, count(*) FILTER (WHERE doc_id % 10 <> 0 AND length(trim(text)) > 0) AS pages_with_text, CAST(sum(CASE WHEN doc_id % 10 <> 0 THEN "
    "length(text) ELSE 0 END) AS BIGINT) AS characters, round(avg(doc_id % 7 / 7.0::DOUBLE), 4) AS confidence_mean, round(min(doc_id % 7 / 7.0::DOUBLE), 4) AS confidence_min FROM documents GROUP BY 1"
)
def q_page_summary(s, d):
    p = table(s, d, "documents").select(
        F.col("source").alias("document_id"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text"), (F.col("doc_id") % 7 / 7.0).alias("confidence")
    )
    return P.page_summary(p)


@query("SELECT source AS document_id, lang AS method, count(*) AS pages FROM documents GROUP BY ALL")
def q_page_methods(s, d):
    return P.page_methods(table(s, d, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("method")))


SCORED = f"{STATE}, sc AS (SELECT *, flow_in_lpm > 120 AS is_anomaly, flow_in_lpm / 500 AS anomaly_score FROM flags)"


def _scored(s, d):
    return _state(s, d).withColumn("is_anomaly", F.col("flow_in_lpm") > 120).withColumn("anomaly_score", F.col("flow_in_lpm") / 500)


@query(f"{SCORED} SELECT well_name, count(*) AS rows, count(*) FILTER (WHERE is_anomaly) AS anomalies, round(avg(is_anomaly::INT), 4) AS rate FROM sc GROUP BY 1")
def q_anomaly_rates(s, d):
    return P.anomaly_rates(_scored(s, d), ["well_name"])


@query(
    f"{SCORED}, x AS (SELECT 'circulating' AS state, is_anomaly FROM sc WHERE circulating UNION ALL SELECT 'rotating', is_anomaly FROM sc WHERE rotating UNION ALL SELECT 'tripping', "
    "is_anomaly FROM sc WHERE tripping) SELECT state, count(*) AS rows, count(*) FILTER (WHERE is_anomaly) AS anomalies, round(avg(is_anomaly::INT), 4) AS rate FROM x GROUP BY 1"
)
def q_anomaly_rates_by_state(s, d):
    return P.anomaly_rates_by_state(_scored(s, d))


@query(
    "SELECT round(min(value / 500), 4) AS \"min\", round(quantile_cont(value / 500, 0.5), 4) AS p50, round(quantile_cont(value / 500, 0.9), 4) AS p90, round(quantile_cont(value / 500, 0.99), 4) AS "
    "p99, round(max(value / 500), 4) AS \"max\" FROM events"
)
def q_score_distribution(s, d):
    return P.score_distribution(table(s, d, "events").withColumn("anomaly_score", F.col("value") / 500))


SPLIT = "CASE WHEN l_suppkey % 10 < 7 THEN 'train' WHEN l_suppkey % 10 = 7 THEN 'validation' ELSE 'test' END"


def _split(s, d):
    k = F.col("s_suppkey") % 10
    split = F.when(k < 7, "train").when(k == 7, "validation").otherwise("test")
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("well"), split.alias("split"))
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("well"), (F.floor(F.col("l_extendedprice") / 100) + 1).alias("lithology"))
    return rows, a


@query(
    f"SELECT {SPLIT} AS split, CAST(floor(l_extendedprice / 100) AS BIGINT) + 1 AS lithology, count(*) AS rows, count(DISTINCT l_suppkey) AS wells FROM lineitem GROUP BY 1, 2"
)
def q_split_coverage(s, d):
    return P.split_coverage(*_split(s, d))


@query(
    f"WITH x AS (SELECT DISTINCT {SPLIT} AS split, CAST(floor(l_extendedprice / 100) AS BIGINT) + 1 AS lithology FROM lineitem) SELECT s.split, c.lithology FROM (SELECT DISTINCT split FROM x) s, "
    "(SELECT DISTINCT lithology FROM x) c WHERE (s.split, c.lithology) NOT IN (SELECT (split, lithology) FROM x)"
)
def q_absent_from_split(s, d):
    return P.absent_from_split(*_split(s, d))


@query("SELECT o_orderpriority AS reason, count(*) AS mentions FROM orders GROUP BY 1")
def q_exclusion_reasons(s, d):
    return P.exclusion_reasons(table(s, d, "orders").select(F.col("o_orderpriority").alias("reason")))


@query(
    "SELECT count(*) AS labelled, 'supervised' AS mode, count(*) || ' labelled events meet the threshold of 200' AS reason FROM orders WHERE o_orderpriority <> '5-LOW'"
)
def q_risk_mode(s, d):
    return P.risk_mode(table(s, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("category")))


@query("SELECT DISTINCT l_suppkey AS well FROM lineitem WHERE l_suppkey IN (SELECT user_id FROM events)")
def q_shared_keys(s, d):
    a = table(s, d, "lineitem").select(F.col("l_suppkey").alias("well"))
    return P.shared_keys(a, table(s, d, "events").select(F.col("user_id").alias("well")), ["well"])


# ------------------------------------------------------------------ classification

CONF = "conf AS (SELECT l_linenumber AS a, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE CAST(l_suppkey % 8 AS INT) END AS p, count(*) AS n FROM lineitem GROUP BY 1, 2)"
CLASSES = (
    f"{CONF}, lab AS (SELECT a AS code FROM conf UNION SELECT p FROM conf), cl AS (SELECT code, CAST(coalesce((SELECT sum(n) FROM conf WHERE a = code), 0) AS BIGINT) AS support, "
    "CAST(coalesce((SELECT sum(n) FROM conf WHERE p = code), 0) AS BIGINT) AS guessed, CAST(coalesce((SELECT sum(n) FROM conf WHERE a = code AND p = code), 0) AS BIGINT) AS hits FROM lab), pr AS "
    "(SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM cl), f AS (SELECT *, CASE WHEN precision + "
    "recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"
)


def _conf(s, d):
    p = F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber")).otherwise((F.col("l_suppkey") % 8).cast("int"))
    return M.confusion(table(s, d, "lineitem").select(F.col("l_linenumber").alias("actual"), p.alias("predicted")))


@query(f"WITH {CONF} SELECT a AS actual, p AS predicted, n FROM conf")
def q_confusion(s, d):
    return _conf(s, d)


@query(
    f"WITH {CLASSES} SELECT code, CAST(code AS VARCHAR) AS name, support, guessed, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support >= 9000 AS reliable FROM f"
)
def q_per_class_metrics(s, d):
    out = M.per_class_metrics(_conf(s, d), min_support=9000)
    return rounded(out, 9, "precision", "recall", "f1").withColumns({c: F.col(c).cast("long") for c in ("support", "guessed", "hits")})


@query(
    f"WITH {CLASSES}, t AS (SELECT sum(support)::DOUBLE AS n, sum(hits) / sum(support) AS po, sum(support::DOUBLE * guessed) / (sum(support)::DOUBLE * sum(support)) AS pe, avg(f1) AS mf, sum(f1 * support) / "
    "sum(support) AS wf, avg(CASE WHEN support > 0 THEN recall END) AS ba, count(*) AS k FROM f) SELECT 'all' AS split, CAST(n AS BIGINT) AS samples, k AS classes_evaluated, round(po, 4) AS accuracy, "
    "round(ba, 4) AS balanced_accuracy, round(mf, 4) AS macro_f1, round(wf, 4) AS weighted_f1, round((po - pe) / (1 - pe), 4) AS cohen_kappa FROM t"
)
def q_classification_metrics(s, d):
    return M.classification_metrics(_conf(s, d), "all").withColumn("samples", F.col("samples").cast("long"))


@query(
    "WITH n AS (SELECT quality AS c, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT arg_max(c, n * 1000 - c) AS c, max(n) AS m, sum(n) AS s, count(*) AS k FROM n) SELECT c AS predicted_class, "
    "round(m / s, 4) AS accuracy, round(2 * (m / s) / (m / s + 1) / k, 4) AS macro_f1, round(1.0 / k, 4)::DOUBLE AS balanced_accuracy FROM t"
)
def q_majority_baseline(s, d):
    return M.majority_baseline(table(s, d, "labels"), "quality")


@query("SELECT round(sum(CASE WHEN quality = toxic THEN 0 WHEN quality = 1 THEN 2.5 ELSE 4 END) / count(*), 4) AS penalty FROM labels")
def q_penalty_score(s, d):
    conf = M.confusion(table(s, d, "labels"), "quality", "toxic")
    return M.penalty_score(conf, M.penalty_table(s, [[0.0, 4.0], [2.5, 0.0]], [0, 1]))


@query("SELECT count(*) AS labelled, count(*) FILTER (WHERE quality = toxic) AS matched, count(*) FILTER (WHERE quality = toxic) / count(*) AS agreement FROM labels WHERE doc_id % 3 <> 0")
def q_label_agreement(s, d):
    df = table(s, d, "labels").select(F.col("toxic").alias("lithology_code"), F.when(F.col("doc_id") % 3 != 0, F.col("quality")).alias("actual_code"))
    return M.label_agreement(df)


FOLDS = "fs AS (SELECT l_returnflag AS model, l_linenumber AS fold, avg(l_discount) * 4 + avg(l_tax) AS score FROM lineitem GROUP BY 1, 2)"


def _folds(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold")).agg(
        (F.avg("l_discount") * 4 + F.avg("l_tax")).alias("macro_f1")
    )


@query(
    f"WITH {FOLDS}, x AS (SELECT model, count(*) AS folds, round(avg(score), 4) AS macro_f1_mean, round(stddev_samp(score), 4) AS macro_f1_std, round(min(score), 4) AS macro_f1_min, round(max(score), 4) AS "
    "macro_f1_max FROM fs GROUP BY model) SELECT *, CAST(row_number() OVER (ORDER BY macro_f1_mean DESC, model) AS INT) AS rank FROM x"
)
def q_fold_summary(s, d):
    return M.fold_summary(_folds(s, d))


@query(
    f"WITH {FOLDS}, p AS (SELECT fold, max(CASE WHEN model = 'A' THEN score END) - max(CASE WHEN model = 'R' THEN score END) AS x FROM fs GROUP BY fold) SELECT 'A' AS best, 'R' AS runner_up, round(avg(x), 4) AS "
    "mean_difference, count(*) FILTER (WHERE x > 0) AS folds_won, count(*) AS folds_total, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS paired_t_statistic FROM p"
)
def q_compare_models(s, d):
    return M.compare_models(_folds(s, d), "A", "R").drop("caveat")


@query(
    f"WITH {FOLDS} SELECT fold, round(max(CASE WHEN model = 'A' THEN score END) - max(CASE WHEN model = 'R' THEN score END), 4) AS difference FROM fs GROUP BY fold"
)
def q_fold_differences(s, d):
    return M.fold_differences(_folds(s, d), "A", "R")


@query(
    f"WITH {FOLDS}, x AS (SELECT model, round(avg(score), 4) AS m, round(stddev_samp(score), 4) AS sd FROM fs GROUP BY model), w AS (SELECT arg_min(model, rk) AS winner, max(sd) AS widest FROM (SELECT *, row_number() "
    "OVER (ORDER BY m DESC, model) AS rk FROM x)), p AS (SELECT round(avg(x), 4) AS d FROM (SELECT max(CASE WHEN model = 'A' THEN score END) - max(CASE WHEN model = 'R' THEN score END) AS x FROM fs GROUP BY fold)) "
    "SELECT winner, 'A' AS selected_model, d AS mean_difference, widest AS widest_fold_spread, abs(d) > widest AS separable FROM w, p"
)
def q_cv_verdict(s, d):
    f = _folds(s, d)
    return M.cv_verdict(M.fold_summary(f), M.compare_models(f, "A", "R"), "A").drop("conclusion")


VERSIONS = (
    "ver AS (SELECT o_orderpriority AS algorithm, o_orderkey AS version, o_orderdate AS trained_at, o_totalprice / 600000 AS v, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey / 200000.0::DOUBLE END AS h FROM orders)"
)


@query(
    f"WITH {VERSIONS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY trained_at DESC, version DESC) AS r FROM ver) WHERE r = 1), o AS (SELECT arg_max(algorithm, v) AS selected_model, "
    "arg_max(version, v) AS version, round(max(v), 6) AS validation_macro_f1, count(*) AS candidates, arg_max(algorithm, h) AS holdout_best FROM l) SELECT *, holdout_best <> selected_model AS disagreement_warning FROM o"
)
def q_select_model(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("algorithm"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("trained_at"), F.lit("trained").alias("status"),
        (F.col("o_totalprice") / 600000).alias("validation_macro_f1"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") / 200000.0).alias("holdout_macro_f1"),
    )
    return rounded(M.select_model(o), 6, "validation_macro_f1")


def _versions(s, d):
    return table(s, d, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("trained_at"), F.col("o_totalprice").alias("score")
    )


@query("SELECT o_orderpriority AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1".replace("(o_orderdate, o_orderkey)", "epoch_us(o_orderdate)::HUGEINT * 100000000 + o_orderkey"))
def q_latest_models(s, d):
    return R.latest(_versions(s, d)).select("name", "version")


@query("SELECT o_orderpriority AS name, count(*) AS versions, epoch_us(max(o_orderdate)) AS last_trained_at FROM orders GROUP BY 1")
def q_list_models(s, d):
    return R.list_models(_versions(s, d)).withColumn("last_trained_at", us("last_trained_at"))


@query("SELECT o_orderkey AS version FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_model_versions(s, d):
    return R.versions(_versions(s, d), "1-URGENT").select("version")
