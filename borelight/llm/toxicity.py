"""Toxicity by a chain of linear classifiers: each category sees the probabilities of the ones before it."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelight.llm.shingles import shingle_set

SAMPLE = 8000  # labelled rows that the models are fitted on, about
FOLDS = 4
TERMS = 400  # words a category
STEPS = 300
PENALTY = 3e-5
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Logistic regression over `size` word flags (row, column pairs), dense columns and a bias, by Adam steps on all rows."""
    width = size + dense.shape[1] + 1
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], minlength=len(y)) + dense @ w[size:-1] + w[-1]
        g = (logistic(z) - y) / len(y)
        grad = np.concatenate([np.bincount(cols, g[rows], minlength=size), dense.T @ g, [g.sum()]]) + PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


class Chain:
    """Fitted models: for each category its words' weights, the weights of earlier probabilities and a bias."""

    def __init__(self, names: list[str], models: list[tuple[dict[str, float], np.ndarray, float]], threshold: float = 0.5):
        self.names, self.models, self.threshold = names, models, threshold

    def probabilities(self, there: set[str]) -> list[float]:
        out: list[float] = []
        for weight, earlier, bias in self.models:
            z = bias + sum(weight[w] for w in weight.keys() & there) + float(np.dot(earlier, out))
            out.append(float(logistic(np.float64(z))))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the two neighbouring probabilities where F1 is best; 0.5 if all rows are positive; beyond any if none is."""
    if not len(y) or y.max() == 0:
        return 2.0
    if y.min() == 1:
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.r_[p[1:] != p[:-1], True]
    right = np.cumsum(y)
    f1 = np.where(last, 2 * right / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def telling_words(sample: DataFrame, flags: list[str]) -> list[list[str]]:
    """For each category up to TERMS words whose share among its documents differs most from their share elsewhere (z over 4)."""
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in flags]).first()
    counts = sample.select(F.explode("words").alias("word"), *flags).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in flags])
    out = []
    for c in flags:
        yes, no = totals[c] or 0, (totals["n"] or 0) - (totals[c] or 0)
        if not yes or not no:
            out.append([])
            continue
        share = F.col("n") / totals["n"]
        z = (F.col(c) / yes - (F.col("n") - F.col(c)) / no) / F.sqrt(share * (1 - share) * (1 / yes + 1 / no))
        best = counts.where((F.col("n") >= 5) & (F.col("n") < totals["n"])).withColumn("z", F.abs(z)).where("z > 4")
        out.append([r["word"] for r in best.orderBy(F.desc("z"), "word").limit(TERMS).collect()])
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> Chain:
    """Fit on about SAMPLE labelled documents, chosen by a hash of their id; of near copies (equal least shingle hash) one is used.

    Categories (name: condition on the labels) go in order. Models of a later category are trained on out-of-fold probabilities
    of the earlier ones (without positive labels a chain rejects nothing; a document's probability comes from a model that has not seen its fold). Folds are trained in tasks.
    """
    spark = docs.sparkSession
    names = list(categories)
    flags = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]).where(" and ".join(f"{n} is not null" for n in names))
    flags = flags.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    total = max(1, flags.count())
    cut = min(1.0, SAMPLE / total)
    chosen = flags.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(cut * (1 << 20)))
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about SAMPLE rows of numbers

    def features(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [int(s[0].astype(np.int64)) if len(s := shingle_set(t, 2)) else 0 for t in texts]
            columns = [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n) for n in names)], names=["doc_id", "key", "words", *names])

    schema = "doc_id long, key long, words array<string>, " + ", ".join(f"{n} int" for n in names)
    sample = both.select(F.col("doc_id").cast("long"), "text", *names).mapInArrow(features, schema)
    ids = sample.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    sample = sample.join(ids, ["key", "doc_id"])
    terms = telling_words(sample, names)
    vocabulary = sorted({w for t in terms for w in t})
    flat = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    data = sample.select("doc_id", F.array_intersect("words", flat).alias("words"), *names).orderBy("doc_id").toPandas()
    y = {n: data[n].to_numpy(float) for n in names}
    fold = (data["doc_id"].to_numpy(np.int64) * 2654435761 >> 7) % FOLDS
    held_words = [set(w) for w in data["words"]]
    earlier = np.zeros((len(data), 0))
    models = []
    for name, own in zip(names, terms, strict=True):
        column = {w: k for k, w in enumerate(own)}
        pairs = [(r, column[w]) for r, there in enumerate(held_words) for w in sorted(there & column.keys())]
        rows, cols = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        task = spark.sparkContext.broadcast((rows, cols, earlier, y[name], fold, len(own)))

        def train(batches, task=task):
            rows, cols, dense, y, fold, size = task.value
            for batch in batches:
                for k in batch["fold"]:
                    use = fold != k
                    new = np.cumsum(use) - 1
                    seen = use[rows]
                    w = fit_linear(new[rows[seen]], cols[seen], dense[use], y[use], size)
                    yield batch[batch["fold"] == k].assign(w=[w.tolist()])

        jobs = spark.range(-1, FOLDS, 1, FOLDS + 1).withColumnRenamed("id", "fold")  # fold -1: all rows
        fitted = {r["fold"]: np.array(r["w"]) for r in jobs.mapInPandas(train, "fold long, w array<double>").collect()}
        out = np.zeros(len(data))
        for k in range(FOLDS):
            w = fitted[k]
            z = np.bincount(rows, w[cols], minlength=len(data)) + earlier @ w[len(own) : -1] + w[-1] if len(data) else out
            out[fold == k] = logistic(z)[fold == k] if len(data) else out
        w = fitted[-1]
        models.append((dict(zip(own, w.tolist(), strict=False)), w[len(own) : -1], float(w[-1])))
        earlier = np.column_stack([earlier, out])
    return Chain(names, models, best_threshold(earlier[:, -1], y[names[-1]]))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the probability of each category (p_<name>) and `rejected`: the last category reaches the
    threshold at which out-of-fold predictions were best (F1).

    Whole texts are scored, once each; nothing is shuffled. Null and empty texts have no words and get the bias alone. Rows
    repeat and null ids pass on. No rows: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches):
        c = shared.value
        for batch in batches:
            p = [c.probabilities(words(t.as_py())) for t in batch.column("text")]
            columns = [pa.array([x[k] for x in p], pa.float64()) for k in range(len(c.names))]
            last = pa.array([x[-1] >= c.threshold for x in p], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, last], names=["doc_id", *(f"p_{n}" for n in c.names), "rejected"])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)


def accepted(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of `docs`, all columns, whose last category stays below the chain's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.probabilities(words(t.as_py()))[-1] < shared.value.threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def categories() -> dict[str, Column]:
    """The two categories that the labels know: poor first, toxic last."""
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
