"""Splits, folds, models and anomaly scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from borelight.plans import anomaly as A
from borelight.plans import lithology as L
from catalog.base import query, rounded, table, tele


def _labelled(s, d):
    code = F.when(F.col("l_extendedprice") > 104500, 90000).when(F.col("l_quantity") > 25, 30000).otherwise(65000)
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("well"), F.col("l_extendedprice").alias("depth"), "l_quantity", "l_discount",
        F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"), code.alias("lithology"),
    )


@query(
    "WITH n AS (SELECT count(DISTINCT l_suppkey) AS w FROM lineitem) SELECT 'train' AS split, w - CAST(round(w * 0.15) AS BIGINT) * 2 AS wells FROM n UNION ALL SELECT 'validation', CAST(round(w * 0.15) AS BIGINT) FROM n UNION ALL "
    "SELECT 'test', CAST(round(w * 0.15) AS BIGINT) FROM n"
)
def q_well_splits(s, d):
    out = L.well_splits(_labelled(s, d))
    return out.groupBy("split").agg(F.count_distinct("well").alias("wells"))


@query(
    "WITH RECURSIVE n AS (SELECT l_suppkey AS well, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, well) - 1 AS r FROM n), "
    "g AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS BIGINT) AS well, CAST(NULL AS BIGINT) AS p UNION ALL "
    "SELECT i + 1, list_transform(load, lambda x, j: x + CASE WHEN j = h.q THEN r.n ELSE 0 END), r.well, h.q FROM (SELECT *, list_position(load, list_min(load)) AS q FROM g) h JOIN r ON r.r = h.i) "
    "SELECT well, CAST(p - 1 AS INT) AS fold FROM g WHERE i > 0"
)
def q_group_folds(s, d):
    return L.group_folds(_labelled(s, d), 5)


@query("SELECT CAST(round_even(count(DISTINCT s_suppkey) * 0.15, 0) AS BIGINT) AS wells FROM supplier")
def q_early_stop_wells(s, d):
    out = L.early_stop_wells(table(s, d, "supplier").select(F.col("s_suppkey").alias("well")), 0.15)
    return out.agg(F.count_distinct("well").alias("wells"))


@query(
    "WITH m AS (SELECT median(CASE WHEN l_tax > 0.01 THEN l_tax END) AS t, median(l_quantity) AS q FROM lineitem) SELECT l_suppkey AS well, l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0.01 THEN l_tax ELSE t END AS l_tax, "
    "(l_tax <= 0.01)::INT::DOUBLE AS l_tax_missing FROM lineitem, m"
)
def q_impute_with_indicators(s, d):
    df = table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("well"), "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax")
    )
    return L.impute_with_indicators(df, ["l_quantity", "l_tax"], max_rows=20000)[0]


@query(
    "WITH n AS (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_returnflag, round((SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c), 9) AS weight FROM lineitem JOIN n USING (l_returnflag)"
)
def q_balanced_weights(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return rounded(L.balanced_weights(df, "l_returnflag"), 9, "weight")


DEV = ("value", "k", "sum")


@query(
    "WITH e AS (SELECT event_id, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events), f AS (SELECT *, value * 2 + k AS \"sum\" FROM e), st AS (SELECT median(value) AS mv, median(k) AS mk, median(\"sum\") AS ms, "
    "stddev_samp(value) AS sv, stddev_samp(k) AS sk, stddev_samp(\"sum\") AS ss FROM f), x AS (SELECT event_id, unnest(['value', 'k', 'sum']) AS feature, unnest([0, 1, 2]) AS p, unnest([abs(value - mv) / sv, abs(k - mk) / sk, "
    "abs(\"sum\" - ms) / ss]) AS dv FROM f, st), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dv DESC, p) AS r FROM x) SELECT event_id, CAST(r AS INT) AS rank, feature, round(dv, 3) AS contribution FROM r WHERE r <= 2"
)
def q_deviation_attribution(s, d):
    df = table(s, d, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    df = df.withColumn("sum", F.col("value") * 2 + F.col("k"))
    out = A.deviation_attribution(df, list(DEV), 2, max_rows=3000)
    return out.select("event_id", F.posexplode("contributing_features").alias("p", "c")).select(
        "event_id", (F.col("p") + 1).alias("rank"), "c.feature", "c.contribution"
    )


CHANNELS = ["flow_in_lpm", "bit_rpm", "bit_depth_m"]
LITHOLOGY = ["depth", "l_quantity", "l_discount", "l_tax"]


def _forest_rows(s, d):
    return tele(s, d).select("event_id", "well_name", *CHANNELS)


@query()
def q_isolation_forest(s, d):
    rows = _forest_rows(s, d)
    f = A.fit_isolation_forest(rows, CHANNELS, ["event_id"])
    return rounded(A.score_isolation_forest(rows, f).select("event_id", "is_anomaly", "anomaly_score"), 6, "anomaly_score")


@query()
def q_score_anomalies(s, d):
    t = tele(s, d).withColumn("operations_active", F.col("flow_in_lpm") > 20)
    out, _ = A.score_anomalies(t, CHANNELS, ties=["event_id"])
    return out.select("event_id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), F.size("contributing_features").alias("n"))


@query()
def q_train_and_predict_lithology(s, d):
    df = _labelled(s, d)
    m = L.train_lithology(df, LITHOLOGY)
    return L.predict_lithology(m, df).select("well", "depth", "lithology_code", "lithology_name", "probability", "actual_code")


@query()
def q_train_boosted_lithology(s, d):
    df = _labelled(s, d)
    m = L.train_lithology(df.where("well % 5 > 0"), LITHOLOGY, "boosted", validation=df.where("well % 5 = 0"))
    return L.evaluate(m, df.where("well % 5 = 0"), split="validation")


@query()
def q_cross_validate(s, d):
    return L.cross_validate(_labelled(s, d), LITHOLOGY, ["random_forest", "boosted"]).drop("fit_seconds")
