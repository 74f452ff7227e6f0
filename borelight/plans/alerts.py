"""Alert raising with cooldown and depth window, as a fold over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borelight.functions import scalars as S
from borelight.operators.skew import HOT_ROWS, run_starts
from borelight.params import DEFAULTS, RISK_LEVELS


def match_alert(open_alerts: list, at: int, depth, cooldown_us: int, window: float):
    """Newest open alert the new reading belongs to, or None. Drops alerts past the cooldown.

    `open_alerts` holds (raised_at in microseconds, depth or None, ...) oldest first.
    """
    while open_alerts and open_alerts[0][0] < at - cooldown_us:
        open_alerts.pop(0)
    for alert in reversed(open_alerts):
        if depth is None or alert[1] is None or abs(alert[1] - depth) <= window:
            return alert
    return None


def qualifying(assessments: DataFrame, raise_at: str = DEFAULTS.raise_at, levels=RISK_LEVELS) -> DataFrame:
    rank = sorted(levels, key=levels.get).index(raise_at) + 1
    return assessments.where(S.level_rank("risk_level", levels) >= rank)


def alert_decisions(
    assessments: DataFrame,
    cooldown_s: int = DEFAULTS.cooldown_s,
    window: float = DEFAULTS.alert_depth_window_m,
    raise_at: str = DEFAULTS.raise_at,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each assessment that may raise: the alert it opens or adds to.

    A pause longer than the cooldown cuts a well's history into stretches that cannot affect each other.
    Stretches are sorted by Spark and streamed through the fold; a task keeps only the open alerts.
    Input: assessment_id, well_id, assessed_at, depth_m, risk_level.
    """
    rows = qualifying(assessments, raise_at).select(
        "assessment_id", "well_id", "risk_level", F.col("depth_m").cast("double").alias("depth_m"), "assessed_at"
    )
    pause = F.col("_prev").isNull() | (
        F.unix_micros("assessed_at") - F.unix_micros("_prev") > cooldown_s * 1_000_000
    )
    rows = run_starts(
        rows, ["well_id", "risk_level"], ["assessed_at", "assessment_id"], pause, "_stretch", max_rows,
        {"assessed_at": "_prev"},
    )
    key = ["well_id", "risk_level", "_stretch"]
    rows = (
        rows.withColumn("_us", F.unix_micros("assessed_at"))
        .repartition(*key)
        .sortWithinPartitions(*key, "assessed_at", "assessment_id")
        .select("assessment_id", "well_id", "risk_level", "depth_m", "assessed_at", "_us", F.to_json("_stretch").alias("_s"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    cooldown_us = cooldown_s * 1_000_000

    def fold(batches):
        current, opened = None, []
        for pdf in batches:
            owner, new = [], []
            ids = pdf["assessment_id"].tolist()
            depths = [None if pd.isna(d) else d for d in pdf["depth_m"]]
            stretches = zip(pdf["well_id"].tolist(), pdf["risk_level"].tolist(), pdf["_s"].tolist())
            for i, (stretch, at, d) in enumerate(zip(stretches, pdf["_us"].tolist(), depths)):
                if stretch != current:
                    current, opened = stretch, []
                hit = match_alert(opened, at, d, cooldown_us, window)
                new.append(hit is None)
                if hit is None:
                    hit = (at, d, ids[i])
                    opened.append(hit)
                owner.append(hit[2])
            yield pdf.drop(columns=["_us", "_s"]).assign(alert_id=owner, is_new=new)

    schema = (
        f"assessment_id {kinds['assessment_id']}, well_id {kinds['well_id']}, risk_level string, depth_m double, "
        f"assessed_at timestamp, alert_id {kinds['assessment_id']}, is_new boolean"
    )
    return rows.mapInPandas(fold, schema)


def batch_alerts(assessments: DataFrame, max_rows: int = HOT_ROWS, **rules) -> DataFrame:
    """Alerts of a whole history: the opening assessment, its key and how often it recurred."""
    d = alert_decisions(assessments, max_rows=max_rows, **rules)
    first = lambda c: F.max(F.when(F.col("is_new"), F.col(c)))
    out = d.groupBy("alert_id", "well_id", F.col("risk_level").alias("level")).agg(
        first("assessed_at").alias("raised_at"),
        first("depth_m").alias("depth_m"),
        F.count(F.lit(1)).alias("occurrence_count"),
    )
    title = F.concat(
        F.col("level"), F.lit(" risk indicator"),
        F.when(F.col("depth_m").isNotNull(), F.format_string(" at %.0f m MD", F.col("depth_m"))).otherwise(""),
    )
    return out.select(
        "alert_id", "well_id", "level", "raised_at", "depth_m", "occurrence_count",
        S.dedupe_key("well_id", "level", "depth_m").alias("dedupe_key"), title.alias("title"),
        F.lit("open").alias("status"), F.col("alert_id").alias("assessment_id"),
    )


def alert_explanation(alerts: DataFrame, assessments: DataFrame) -> DataFrame:
    """Alerts with the stored assessment that raised them, read back and not recomputed."""
    keep = [c for c in assessments.columns if c not in alerts.columns or c == "assessment_id"]
    return alerts.join(assessments.select(*keep), "assessment_id", "left")


DECISIONS = ("accepted", "rejected", "investigating", "resolved")


def check_decisions(actions: DataFrame) -> None:
    bad = actions.where(F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS)).limit(1).collect()
    if bad:
        raise ValueError(f"decision must be one of {DECISIONS}")


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with the status their latest decision (other than investigating) gives them."""
    check_decisions(actions)
    status = F.when(F.col("decision").isin("accepted", "rejected"), "reviewed").when(
        F.col("decision") == "resolved", "closed"
    )
    last = (
        actions.where(F.col("decision") != "investigating")
        .groupBy("alert_id")
        .agg(F.max_by(status, F.struct("recorded_at", "decision")).alias("_status"))
    )
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def training_actions(actions: DataFrame) -> DataFrame:
    """Recorded decisions, marked as available for training."""
    check_decisions(actions)
    return actions.withColumn("available_for_training", F.lit(True))
