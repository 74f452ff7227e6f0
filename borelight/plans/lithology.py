"""Whole-well splits and folds, lithology models and their evaluation."""

from __future__ import annotations

import time
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borelight.functions.scalars import lithology_name
from borelight.operators.clean import decimate_by_depth
from borelight.operators.materialise import materialised
from borelight.operators.metrics import classification_metrics, confusion
from borelight.operators.quantiles import group_quantiles
from borelight.operators.skew import HOT_ROWS, broadcast_if_small, broadcast_within, global_rank, ordered_rank, with_one_row
from borelight.params import DEFAULTS
from borelight.plans.boosting import FIT, UNUSED, WATCH, fit_boosted
from borelight.plans.cells import COUNTED_ROWS
from borelight.plans.forest import Forest, fit_forest

SPLITS = ("train", "validation", "test")
FOREST_MEMORY_MB = 1024  # of a task for the counts of open nodes: fewer passes over the rows
FOREST_ROWS = 500_000  # a task of a forest's passes, at most about
SIDE_BY_SIDE = 3  # forests that are fitted at once


def well_splits(
    df: DataFrame,
    well: str = "well",
    target: str = "lithology",
    fractions: dict[str, float] | None = None,
    seed: int = DEFAULTS.split_seed,
    rare_max_wells: int = DEFAULTS.rare_class_max_wells,
) -> DataFrame:
    """(well, split): whole wells, rare classes spread over the splits first, quotas kept.

    Only wells with a rare class (at most `rare_max_wells` per class) are placed one by one. The others
    fill the remaining quotas in hash order, ranked by Spark.
    """
    fractions = fractions or DEFAULTS.split_fractions
    total = sum(fractions.values())
    if abs(total - 1.0) > 1e-8:
        raise ValueError(f"Split fractions must sum to 1.0, got {total}")
    spark = df.sparkSession
    pairs = df.groupBy(well, target).agg(F.count(F.lit(1)).alias("_n"))
    wells = pairs.select(well).distinct()
    n = wells.count()
    quota = {s: int(round(n * f)) for s, f in fractions.items()}
    quota[SPLITS[0]] += n - sum(quota.values())

    known = pairs.where(F.col(target).isNotNull())
    per_class = known.groupBy(target).agg(F.count(F.lit(1)).alias("_wells"))
    rare = per_class.where(F.col("_wells") <= rare_max_wells)
    members = (
        known.join(F.broadcast(rare), target)
        .select(target, "_wells", well, F.xxhash64(F.col(well), F.lit(seed)).alias("_h"))
        .orderBy("_wells", target, "_h", well)
        .collect()
    )
    of_well: dict = {}
    for r in members:
        of_well.setdefault(r[well], set()).add(r[target])
    placed: dict = {}
    used = dict.fromkeys(quota, 0)
    seen: dict = {}
    for r in members:
        if r[well] in placed:
            continue
        free = [s for s in SPLITS if quota[s] > used[s]] or list(SPLITS)
        here = seen.setdefault(r[target], dict.fromkeys(quota, 0))
        pick = min(free, key=lambda s: (here[s], used[s] - quota[s]))
        placed[r[well]] = pick
        used[pick] += 1
        for c in of_well[r[well]]:
            seen.setdefault(c, dict.fromkeys(quota, 0))[pick] += 1
    kind = df.schema[well].dataType.simpleString()
    fixed = spark.createDataFrame(list(placed.items()), f"`{well}` {kind}, split string")
    rest = global_rank(
        wells.join(F.broadcast(fixed), well, "left_anti").withColumn("_seed", F.lit(seed)), [well, "_seed"], "_rank"
    )
    edge, expr = 0, None
    for s in SPLITS:
        edge += max(0, quota[s] - used[s])
        expr = F.when(F.col("_rank") <= edge, s) if expr is None else expr.when(F.col("_rank") <= edge, s)
    rest = rest.select(well, expr.otherwise(SPLITS[0]).alias("split"))
    return fixed.unionByName(rest)


def _dealt(classes: list[tuple[int, int]], k: int) -> list[tuple]:
    """Which folds the wells of each size go to: (size, first rank, after the last rank, folds in turn), ranks counted over falling sizes.

    `classes`: (size, wells) by falling size. Every well goes to the lightest fold, the first of equals. Wells of one size s are dealt in bulk:
    fold i takes its next ones at loads load[i], load[i] + s, ..; in the order of (whole multiples of s, rest, fold) these are the picks.
    """
    load, at, out = [0] * k, 0, []
    for size, wells in classes:
        levels = sorted({x // size for x in load})
        left = wells
        for n, level in enumerate(levels):
            turn = sorted((i for i in range(k) if load[i] // size <= level), key=lambda i: (load[i] % size, i))
            picks = left if n + 1 == len(levels) else min(left, len(turn) * (levels[n + 1] - level))
            if not picks:
                break
            out.append((size, at, at + picks, turn))
            for j, i in enumerate(turn):
                load[i] += size * (picks // len(turn) + (j < picks % len(turn)))
            at += picks
            left -= picks
    return out


def group_folds(df: DataFrame, k: int = 5, well: str = "well", use_splits: tuple = ()) -> DataFrame:
    """(well, fold): whole wells; by falling size, then name, each goes to the fold with the fewest rows so far, the first of equals.

    Wells are counted per size, so what is decided in turn grows with the distinct sizes (at most the root of twice the rows) and not
    with the wells; their ranks come from a range sort. Fewer wells than `k`: as many folds as wells.
    """
    if "test" in use_splits:
        raise ValueError("use_splits contains 'test': selecting on the test wells would invalidate their numbers")
    sizes = df.groupBy(well).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_rank(sizes, [F.desc("_n"), F.col(well).asc_nulls_first()], "_r")
    classes = sorted(((r["_n"], r["_w"]) for r in ranked.groupBy("_n").agg(F.count(F.lit(1)).alias("_w")).collect()), reverse=True)
    runs = _dealt(classes, max(1, min(k, sum(w for _, w in classes))))
    turns = df.sparkSession.createDataFrame(runs, "_size long, _from long, _to long, _turn array<int>")
    on = (F.col("_n") == F.col("_size")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))
    fold = F.element_at("_turn", ((F.col("_r") - F.col("_from")) % F.size("_turn") + 1).cast("int"))
    return ranked.join(broadcast_within(turns, len(runs)), on).select(well, fold.alias("fold"))


def early_stop_wells(wells: DataFrame, fraction: float = 0.15, seed: int = 42, well: str = "well") -> DataFrame:
    """Whole wells set aside for early stopping, at least one."""
    one = wells.select(well).distinct().withColumn("_seed", F.lit(seed))
    count = one.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction).cast("int")).alias("n"))
    ranked = with_one_row(global_rank(one, [well, "_seed"], "_rank"), count, "_c")
    return ranked.where(F.col("_rank") <= F.col("_c.n")).select(well)


def impute_with_indicators(
    df: DataFrame, features: list[str], fitted: dict[str, tuple] | None = None, max_rows: int = HOT_ROWS
) -> tuple[DataFrame, list[str], dict[str, tuple]]:
    """Fill with the fitted medians and mark filled values where the fit data had gaps.

    Returns the frame, its feature names and the fit (feature -> (median, had gaps)).
    """
    if fitted is None:
        med = group_quantiles(df, [], features, [0.5], max_rows).first()
        gaps = df.agg(*[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features]).first()
        fitted = {
            f: (0.0 if med[f] is None or med[f][0] is None else med[f][0], gaps[f] > 0) for f in features
        }
    none = {f: F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features}
    marks = [f for f in features if fitted[f][1]]
    out = df.select(
        *[c for c in df.columns if c not in features],
        *[F.when(none[f], F.lit(fitted[f][0])).otherwise(F.col(f).cast("double")).alias(f) for f in features],
        *[none[f].cast("double").alias(f"{f}_missing") for f in marks],
    )
    return out, [*features, *[f"{f}_missing" for f in marks]], fitted


def balanced_weights(df: DataFrame, target: str = "lithology", name: str = "weight") -> DataFrame:
    """Row weight n / (classes x rows of the class)."""
    n = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
    whole = n.agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("classes"))
    w = with_one_row(n, whole, "_w").select(
        F.col(target).alias("_t"), (F.col("_w.rows") / (F.col("_w.classes") * F.col("_c"))).alias(name)
    )
    return df.join(F.broadcast(w), F.col(target) == F.col("_t")).drop("_t")


class LithologyModel:
    """A fitted classifier with its imputation (forest) and class codes."""

    def __init__(self, kind, model, features, inputs, fitted, codes, seconds, excluded):
        self.kind, self.model, self.features, self.inputs = kind, model, features, inputs
        self.fitted, self.codes, self.seconds, self.excluded = fitted, codes, seconds, excluded

    def transform(self, df: DataFrame) -> DataFrame:
        for f in self.features:
            if f not in df.columns:
                df = df.withColumn(f, F.lit(None).cast("double"))
        codes = F.array(*[F.lit(int(c)) for c in self.codes])
        if self.kind == "boosted":  # knows unknown values itself
            raw = self.model.transform(df)
            best = F.array_max("probability")
        else:
            raw = self.model.transform(impute_with_indicators(df, self.features, self.fitted)[0])
            best = F.array_max("probability" if isinstance(self.model, Forest) else vector_to_array("probability"))
        out = raw.withColumn("lithology_code", F.element_at(codes, F.col("prediction").cast("int") + 1))
        return out.withColumn("probability", F.round(best, 4)).drop("_features", "rawPrediction", "prediction")


def _label(codes: list[int], target: str):
    """The class index of a row, -1 for a code that is not known."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(target).cast("int")) - 1, F.lit(-1)).cast("int")


def _codes(rows: DataFrame, target: str) -> list[int]:
    return sorted(r[0] for r in rows.select(F.col(target).cast("int")).distinct().collect())


def train_lithology(
    train: DataFrame, features: list[str], kind: str = "random_forest", target: str = "lithology",
    validation: DataFrame | None = None, trees: int = 150, depth: int = 18, min_leaf: int = 25, rounds: int = 100,
    seed: int = 42, max_rows: int = HOT_ROWS, patience: int = 50, boosted_depth: int = 6,
) -> LithologyModel:
    """Balanced random forest, or one softmax ensemble of boosted trees.

    A forest of many rows is grown over the counts of binned rows (`fit_forest`), one of few rows or of more cells than a task holds is MLlib's.
    Boosting scores the whole validation wells after every round and keeps the rounds up to the best macro F1, which `patience` rounds
    do not beat. Validation rows of a class the training rows do not have are left out and counted.
    """
    start = time.perf_counter()
    rows = train.where(F.col(target).isNotNull())
    codes = _codes(rows, target)
    if kind == "boosted":
        both = rows.select(*features, _label(codes, target).alias("_label"), F.array(F.lit(FIT)).alias("_roles"))
        if validation is not None:
            watch = validation.where(F.col(target).isNotNull()).select(*features, _label(codes, target).alias("_label"), F.array(F.lit(WATCH)).alias("_roles"))
            both = both.unionByName(watch)
        model = fit_boosted(both, features, len(codes), 1, rounds, min(depth, boosted_depth), patience=patience, seed=seed)[0]
        return LithologyModel(kind, model, features, features, None, codes, time.perf_counter() - start, model.excluded)
    if kind != "random_forest":
        raise ValueError(f"unknown model kind {kind!r}")
    ready, inputs, fitted = impute_with_indicators(rows, features, max_rows=max_rows)
    ready = balanced_weights(ready, target).withColumn("_label", _label(codes, target).cast("double"))
    if rows.count() >= COUNTED_ROWS and (forest := fit_forest(ready, inputs, len(codes), trees, depth, min_leaf, seed)) is not None:
        return LithologyModel(kind, forest, features, inputs, fitted, codes, time.perf_counter() - start, 0)
    # every level of MLlib's trees goes through the rows again: they are imputed and weighted once, and dealt evenly, however few tasks have read them
    ready = materialised(ready.select(*inputs, "weight", "_label"))
    ready = ready.repartition(max(train.sparkSession.sparkContext.defaultParallelism, -(-ready.count() // FOREST_ROWS)))
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=FOREST_MEMORY_MB, cacheNodeIds=False,
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_features"), forest]).fit(ready)
    return LithologyModel(kind, model, features, inputs, fitted, codes, time.perf_counter() - start, 0)


def predict_lithology(
    model: LithologyModel, df: DataFrame, step: float | None = 5.0, well: str = "well", depth: str = "depth",
    target: str | None = "lithology",
) -> DataFrame:
    """Code, name and probability on decimated rows, next to the label where there is one."""
    rows = decimate_by_depth(df, step, depth) if step else df
    out = model.transform(rows)
    actual = F.col(target).cast("int") if target and target in df.columns else F.lit(None).cast("int")
    return out.select(
        well, depth, "lithology_code", lithology_name("lithology_code").alias("lithology_name"), "probability",
        actual.alias("actual_code"),
    )


def evaluate(model: LithologyModel, df: DataFrame, target: str = "lithology", split: str = "") -> DataFrame:
    out = model.transform(df.where(F.col(target).isNotNull()))
    return classification_metrics(confusion(out.withColumn("_a", F.col(target).cast("int")), "_a", "lithology_code"), split)


def fold_roles(folds: DataFrame, k: int, early_stop_fraction: float, well: str = "well") -> DataFrame:
    """(well, fold, _roles): what the well's rows are to the model of each fold; wells set aside for early stopping come from its training wells."""
    aside = None
    for m in range(k):
        some = early_stop_wells(folds.where(F.col("fold") != m), early_stop_fraction, 42 + m, well).select(well, F.lit(m).alias("_m"))
        aside = some if aside is None else aside.unionByName(some)
    aside = aside.groupBy(F.col(well).alias("_well")).agg(F.collect_set("_m").alias("_aside"))
    watches = lambda m: F.coalesce(F.array_contains("_aside", m), F.lit(False))
    role = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: F.when(m == F.col("fold"), UNUSED).when(watches(m), WATCH).otherwise(FIT))
    return folds.join(aside, F.col(well).eqNullSafe(F.col("_well")), "left").select(well, "fold", role.alias("_roles"))


def cross_validate(
    df: DataFrame, features: list[str], kinds: list[str], k: int = 5, well: str = "well", target: str = "lithology",
    early_stop_fraction: float = 0.15, use_splits: tuple = (), rounds: int = 100, patience: int = 50, boosted_depth: int = 6, **model_options,
) -> DataFrame:
    """Scores per (model, fold); every model sees the same folds of whole wells.

    Folds are dealt once and written with the rows. Boosted models of all folds grow together over one set of binned rows, in which a row has a role in each
    fold; forests are fitted and models judged side by side. `fit_seconds` is a fold's share of the time of its kind.
    """
    folds = materialised(group_folds(df, k, well, use_splits))
    size = folds.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(well)).alias("wells"), F.max("fold").alias("last")).first()
    if size["rows"] != size["wells"]:
        raise ValueError("a well is in more than one fold")
    n = size["last"] + 1
    roles = materialised(fold_roles(folds, n, early_stop_fraction, well))
    labelled = df.where(F.col(target).isNotNull()).select(*dict.fromkeys([well, target, *features]))
    rows = materialised(labelled.join(broadcast_if_small(roles.withColumnRenamed(well, "_w")), F.col(well).eqNullSafe(F.col("_w"))).drop("_w"))
    codes = _codes(rows, target)
    parts = []
    for kind in kinds:
        start = time.perf_counter()
        if kind == "boosted":
            fitted = fit_boosted(rows.withColumn("_label", _label(codes, target)), features, len(codes), n, rounds, boosted_depth, patience=patience)
            models = [LithologyModel(kind, m, features, features, None, codes, 0.0, m.excluded) for m in fitted]
        else:
            with ThreadPool(SIDE_BY_SIDE) as pool:
                models = pool.map(lambda m: train_lithology(rows.where(F.col("fold") != m).drop("fold", "_roles"), features, kind, target, **model_options), range(n))
        seconds = (time.perf_counter() - start) / n

        def judged(fold):
            scores = evaluate(models[fold], rows.where(F.col("fold") == fold), target)
            names = (F.lit(kind).alias("model"), F.lit(fold).alias("fold"), "macro_f1", "accuracy", "balanced_accuracy", F.lit(seconds).alias("fit_seconds"))
            return materialised(scores.select(*names))

        with ThreadPool(SIDE_BY_SIDE) as pool:
            parts += pool.map(judged, range(n))
    return reduce(DataFrame.unionByName, parts)
