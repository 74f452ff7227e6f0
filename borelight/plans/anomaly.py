"""Isolation forest, deviation attribution and the anomaly batch job."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borelight.operators.clean import uninformative_channels
from borelight.operators.materialise import materialised
from borelight.operators.quantiles import group_quantiles
from borelight.operators.skew import HOT_ROWS, spread
from borelight.operators.topk import top_deviations
from borelight.operators.windows import rolling_time_stats, score_range_normalise, time_feature_names
from borelight.params import ANOMALY_CHANNELS, DEFAULTS


@dataclass
class Forest:
    """Fitted trees as flat arrays (at most trees x (2 x samples - 1) nodes), with scaling and cut-off."""

    features: list[str]
    centre: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    nodes: list = field(default_factory=list)
    samples: int = 256
    offset: float = 0.0
    low: float = 0.0
    high: float = 0.0


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among `n` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """One random tree: columns feature, threshold, left, right, depth (path length at a leaf)."""
    rows, work = [], [(np.arange(len(x)), 0, -1, 0)]
    while work:
        idx, level, parent, side = work.pop()
        me = len(rows)
        rows.append([-1, 0.0, -1, -1, level + path_norm(len(idx))])
        if parent >= 0:
            rows[parent][2 + side] = me
        if level >= limit or len(idx) <= 1:
            continue
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[idx, f] <= cut
        if left.all() or not left.any():
            continue
        rows[me][0], rows[me][1] = f, cut
        work.append((idx[left], level + 1, me, 0))
        work.append((idx[~left], level + 1, me, 1))
    return pd.DataFrame(rows, columns=["feature", "threshold", "left", "right", "depth"])


def _prepared(df: DataFrame, features: list[str], centre, mean, scale):
    return [
        (F.coalesce(F.col(f).cast("double"), F.lit(float(c))) - F.lit(float(m))) / F.lit(float(s))
        for f, c, m, s in zip(features, centre, mean, scale)
    ]


def fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    row_key: list[str],
    trees: int = DEFAULTS.trees,
    samples: int = DEFAULTS.samples_per_tree,
    contamination: float = DEFAULTS.contamination,
    min_rows: int = DEFAULTS.min_training_rows,
    seed: int = 42,
    max_rows: int = HOT_ROWS,
) -> Forest:
    """Fit on all rows of `df`: exact medians, deviations and cut-off, one small sample per tree.

    The sample of a tree is the `samples` rows with the smallest hash of (row key, tree). Rows that
    cannot be among them are left out before the shuffle by a generous bound on the hash.
    """
    n = df.count()
    if n < min_rows:
        raise ValueError(f"{n} active rows; {min_rows} are required")
    med = group_quantiles(df, [], features, [0.5], max_rows).first()
    centre = np.array([(med[f][0] if med[f] is not None and med[f][0] is not None else 0.0) for f in features])
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(float(c))) for f, c in zip(features, centre)]
    stats = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled)],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled)],
    ).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(features))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(features))])
    x = F.array(*_prepared(df, features, centre, mean, scale))
    take = min(samples, n)
    share = min(1.0, 8.0 * take / n + 64.0 / n)
    bound = int((share - 0.5) * (2**64 - 1)) if share < 1.0 else 2**63 - 1
    bound = max(-(2**63), min(2**63 - 1, bound))
    picks = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.struct(t.alias("tree"), F.xxhash64(*row_key, t, F.lit(seed)).alias("h")),
        ),
        lambda p: p["h"] <= F.lit(bound),
    )
    cand = df.select(x.alias("x"), F.explode(picks).alias("_p")).select("x", "_p.tree", "_p.h")
    w = Window.partitionBy("tree").orderBy("h")
    drawn = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= take).select("tree", "h", "x")
    limit = int(np.ceil(np.log2(max(take, 2))))

    def grow(key, pdf):
        pdf = pdf.sort_values("h")
        tree = _grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, int(key[0])]), limit)
        tree.insert(0, "node", np.arange(len(tree)))
        tree.insert(0, "tree", int(key[0]))
        return tree

    grown = drawn.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, threshold double, left int, right int, depth double"
    ).toPandas()
    nodes = [
        g.sort_values("node")[["feature", "threshold", "left", "right", "depth"]].to_numpy()
        for _, g in grown.groupby("tree", sort=True)
    ]
    forest = Forest(list(features), centre, mean, scale, nodes, take)
    raw = materialised(_score(df, forest, "_s").select("_s"))  # every row meets every tree once; the quantiles read the scores
    q = group_quantiles(raw, [], ["_s"], [0.0, contamination, 1.0], max_rows).first()["_s"]
    forest.offset = q[1]
    forest.low, forest.high = q[0] - q[1], q[2] - q[1]
    return forest


def _score(df: DataFrame, forest: Forest, name: str) -> DataFrame:
    """Append minus the isolation score (higher is more ordinary) as column `name`."""
    norm = path_norm(forest.samples)
    parts = [
        (t[:, 0].astype("int64"), t[:, 1], t[:, 2].astype("int64"), t[:, 3].astype("int64"), t[:, 4])
        for t in forest.nodes
    ]

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        m = np.stack(v.to_numpy())
        rows, total = np.arange(len(m)), np.zeros(len(m))
        for feat, cut, left, right, depth in parts:
            at = np.zeros(len(m), dtype="int64")
            live = rows
            while len(live):
                here = at[live]
                f = feat[here]
                inner = f >= 0
                live, here, f = live[inner], here[inner], f[inner]
                at[live] = np.where(m[live, f] <= cut[here], left[here], right[here])
            total += depth[at]
        return pd.Series(-np.power(2.0, -total / (len(parts) * norm if norm else 1.0)))

    df = spread(df)
    x = F.array(*_prepared(df, forest.features, forest.centre, forest.mean, forest.scale))
    return df.withColumn(name, score(x))


def score_isolation_forest(df: DataFrame, forest: Forest, stored_range: bool = False) -> DataFrame:
    """Add raw_score (below 0 is anomalous), is_anomaly and anomaly_score in [0, 1].

    With `stored_range` the score range of the fit is used and clipped, so rows can be scored as they come.
    """
    out = _score(df, forest, "_s").withColumn("raw_score", F.col("_s") - F.lit(forest.offset)).drop("_s")
    out = out.withColumn("is_anomaly", F.col("raw_score") < 0)
    if not stored_range:
        return score_range_normalise(materialised(out))
    span = forest.high - forest.low
    value = F.lit(0.0) if span <= 0 else (F.lit(forest.high) - F.col("raw_score")) / F.lit(span)
    return out.withColumn("anomaly_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def deviation_attribution(
    df: DataFrame, features: list[str], n: int = DEFAULTS.attribution_top, max_rows: int = HOT_ROWS, medians: dict | None = None
) -> DataFrame:
    """Per row, the features furthest from their median (`medians`: feature -> [median], where they are known) in standard deviations of all rows."""
    med = medians or group_quantiles(df, [], features, [0.5], max_rows).first()
    std = df.agg(*[F.stddev_samp(F.col(f).cast("double")).alias(f) for f in features]).first()
    usable = [f for f in features if std[f] and med[f] is not None and med[f][0] is not None]
    pairs = [(f, F.abs(F.col(f) - F.lit(med[f][0])) / F.lit(std[f])) for f in usable]
    if not pairs:
        kind = "array<struct<feature:string,contribution:double,unit:string>>"
        return df.withColumn("contributing_features", F.array().cast(kind))
    return df.withColumn("contributing_features", top_deviations(pairs, n))


def score_anomalies(
    telemetry: DataFrame, channels: list[str] | None = None, well: str = "well_name", at: str = "timestamp",
    ties: list[str] | None = None, windows: dict[str, int] | None = None, max_rows: int = HOT_ROWS, **fit_options,
) -> tuple[DataFrame, Forest]:
    """Rolling features over all rows, then fit and score on the operationally active ones."""
    have = [c for c in (channels or ANOMALY_CHANNELS) if c in telemetry.columns]
    flat = {r["channel"] for r in uninformative_channels(telemetry, have).where("constant").collect()}
    usable = [c for c in have if c not in flat]
    rows = rolling_time_stats(telemetry, usable, windows, well, at, ties, max_rows)
    features = time_feature_names(usable, windows)
    active = materialised(rows.where(F.col("operations_active")))
    forest = fit_isolation_forest(active, features, [well, at, *(ties or [])], max_rows=max_rows, **fit_options)
    known = {f: [c] for f, c in zip(forest.features, forest.centre.tolist(), strict=True)}  # of the same rows; without values there is no deviation either
    scored = deviation_attribution(score_isolation_forest(active, forest), features, max_rows=max_rows, medians=known)
    keep = [c for c in telemetry.columns]
    return scored.select(*keep, "raw_score", "anomaly_score", "is_anomaly", "contributing_features"), forest
