"""Operator 9, toxicity: non-negative positive-unlabelled learning of a numpy classifier.

Confirmed toxic examples are the positives; texts without regard to their labels are the unlabelled ones. With the class prior p,
the risk is p * R(positive as 1) + max(0, R(unlabelled as 0) - p * R(positive as 0)); where the second part is negative, a step
goes against its gradient, so that the fit doesn't turn the correction into overfitting. The prior is the share of toxic ones
among the labelled training rows, or a parameter.

Features are hashed words and word prefixes of the whole text (log of 1 + count). Of those, Spark counts in how many positives and
in how many unlabelled texts each occurs, and keeps the ``max_features`` that tell them apart best (z score of both shares).
Training takes at most ``max_positive`` and ``max_unlabelled`` documents, chosen by a hash of doc_id (of rows with one doc_id the
alphabetically first text); scoring takes all rows.

Defined results: null and empty texts have no features and get the score of the intercept; rows with null doc_id are scored but
never trained on; without any labelled toxic training row every score is the prior (0 without labels). Scores depend on the
text only. An empty table gives an empty result. Other columns pass through ``score`` unchanged, but one that has the score's name,
in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, table
from .hashed_text import WordFeatures

BITS = 22


class Model:
    def __init__(self, features: list[int], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        features, weights, bias = self.features, self.weights, self.bias

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            reader = WordFeatures(BITS, {h: i for i, h in enumerate(features)})

            def one(text: str | None) -> float:
                z = bias + sum(weights[i] * np.log1p(n) for i, n in sorted(reader.of_text(text).items()))
                return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

            return texts.map(one, na_action=None).astype("float64")

        return score

    def score(self, docs: DataFrame, column: str = "score") -> DataFrame:
        small_batches(docs.sparkSession)
        return docs.withColumn(column, self.scorer()(F.col("text").cast("string")))


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk, prior * R(positive as 1) and R(unlabelled as 0) - prior * R(positive as 0), and their gradients."""
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -500, 500))) for x in (p, u))
    loss_of_one = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    negative = -np.log1p(-np.clip(su, 0, 1 - 1e-12)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-12)).mean()
    return loss_of_one, negative, prior * (p.T @ (sp - 1)) / len(p), (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative risk (Adam on full batches)."""
    p, u = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, as_one, as_zero = risk_gradient(p, u, w, prior)
        g = as_one + as_zero if negative >= 0 else -as_zero
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 10_000, max_features: int = 400, prior: float | None = None, seed: int = 7) -> Model:
    """docs: the rows that may be learned from (doc_id, text); labels: doc_id, toxic. Rows of the fit are bounded by both maxima."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(ids, "doc_id", "left_semi")
    share = known.agg(F.avg("toxic")).first()[0]
    prior = share if prior is None else prior
    if not share:
        return Model([], np.zeros(0), -500.0 if not prior else float(np.log(prior / (1 - prior))))
    order = lambda salt: (F.xxhash64("doc_id", F.lit(seed + salt)), F.col("doc_id"))
    chosen = known.filter("toxic = 1").orderBy(*order(0)).limit(max_positive).select("doc_id", F.lit(1).alias("part")).unionAll(ids.orderBy(*order(1)).limit(max_unlabelled).select("doc_id", F.lit(0).alias("part")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", "text")

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = WordFeatures(BITS)
        for b in batches:
            found = [np.fromiter(reader.of_text(t), np.int64) for t in b.text]
            yield pd.DataFrame({"part": np.repeat(b.part.to_numpy(), [len(f) for f in found]), "feature": np.concatenate([*found, np.zeros(0, np.int64)])})

    n = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    seen = rows.mapInPandas(present, "part int, feature long").groupBy("feature").agg(F.sum(F.col("part")).alias("a"), F.sum(1 - F.col("part")).alias("b"))
    every = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(every * (1 - every) * (1 / n1 + 1 / n0))
    best = seen.filter("a >= 2").withColumn("z", z).filter(F.abs("z") > 4).orderBy(F.abs("z").desc(), "feature").limit(max_features)
    features = sorted(r.feature for r in best.collect())
    k = len(features)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = WordFeatures(BITS, {h: i for i, h in enumerate(features)})
        for b in batches:
            out = []
            for t in b.text:
                x = np.zeros(k, np.float32)
                for i, c in reader.of_text(t).items():
                    x[i] = np.log1p(c)
                out.append(x.tobytes())
            yield pd.DataFrame({"part": b.part, "x": out})

    read = rows.mapInPandas(dense, "part int, x binary").toPandas().sort_values(["part", "x"])
    x = np.array([np.frombuffer(v, np.float32) for v in read.x], np.float64).reshape(len(read), k)
    part = read.part.to_numpy()
    return Model(features, *nnpu(x[part == 1], x[part == 0], float(np.clip(prior, 1e-4, 1 - 1e-4))))


def fold_model(docs: DataFrame, labels: DataFrame) -> Model:
    """A model that has learned from the rows that aren't held out only."""
    return fit(docs.filter(~is_held_out()), labels.filter(~is_held_out()))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    (name,) = fresh(docs, "score")
    return model.score(docs, name).filter(F.col(name) < threshold).drop(name)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fold_model(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
