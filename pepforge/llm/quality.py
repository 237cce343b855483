"""Operator 2, quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features is shared by all grades; ordered thresholds t_1 < ... < t_K cut its score s, so that
P(grade > k) = 1 / (1 + exp(t_k - s)). This gives the expected grade, and the tail probability of reaching a wanted grade, by which
documents are selected. Thresholds stay ordered as t_1 plus sums of exponentials.

Training takes at most ``max_rows`` rated documents, chosen by a hash of doc_id (of rows with one doc_id the alphabetically first
text); scoring takes all rows and their whole texts. Ratings are integers of any kind; grades are their ranks among those seen.

Defined results: null and empty texts have only the features of an empty text; rows with null doc_id or rating are never trained
on; with one rating or none, every expected grade is that rating (0.0 without ratings) and the tail is 1.0 where it reaches
the wanted grade. An empty table gives an empty result. Other columns pass through ``score`` unchanged, but those named
expected_grade or tail_probability, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, small_batches, table
from .hashed_text import TextFeatures

BITS = 18


class Model:
    """ratings: the grades' ratings in order; thresholds: one fewer."""

    def __init__(self, ratings: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.ratings, self.weights, self.thresholds = ratings, weights, thresholds

    def scorer(self, wanted: int):
        ratings, weights, thresholds = np.array(self.ratings or [0], float), self.weights, self.thresholds
        above = int(np.searchsorted(ratings, wanted))  # the grade to reach

        @F.pandas_udf("expected_grade double, tail_probability double")
        def score(texts: pd.Series) -> pd.DataFrame:
            reader, out = TextFeatures(BITS), []
            for text in texts:
                own = reader.of_text(text)
                s = weights[own].sum() / np.sqrt(len(own)) if len(weights) else 0.0
                tails = 1 / (1 + np.exp(np.clip(thresholds - s, -500, 500)))
                grade = ratings[0] + (np.diff(ratings) * tails).sum()
                tail = 1.0 if above == 0 else 0.0 if above > len(tails) else tails[above - 1]
                out.append((float(grade), float(tail)))
            return pd.DataFrame(out, columns=["expected_grade", "tail_probability"])

        return score

    def score(self, docs: DataFrame, wanted: int) -> DataFrame:
        """docs with expected_grade and tail_probability, the probability of a rating of at least wanted."""
        small_batches(docs.sparkSession)
        made = ("expected_grade", "tail_probability")
        (new,) = fresh(docs, "__score")
        scored = docs.withColumn(new, self.scorer(wanted)(F.col("text").cast("string")))
        return scored.select(*[quoted(c) for c in docs.columns if c.lower() not in made], *[F.col(f"{new}.{c}").alias(c) for c in made])


def cumulative_link(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grade: np.ndarray, n_columns: int, n_grades: int, steps: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood (Adam on full batches); the features are given as coordinates."""
    n = len(grade)
    share = np.array([(grade > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_columns), t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, gaps = free[:n_columns], np.exp(free[n_columns + 1 :])
        cuts = np.concatenate([[-np.inf], free[n_columns] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(rows, values * w[columns], minlength=n)
        upper, lower = (1 / (1 + np.exp(-np.clip(cuts[grade + i] - s, -500, 500))) for i in (1, 0))
        chance = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance  # of log chance by both cuts
        by_score = (du - dl) / n
        by_cut = np.array([dl[grade == k + 1].sum() - du[grade == k].sum() for k in range(n_grades - 1)]) / n
        tails = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(columns, values * by_score[rows], minlength=n_columns) + ridge * w, tails[:1], tails[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n_columns], free[n_columns] + np.concatenate([[0], np.cumsum(np.exp(free[n_columns + 1 :]))])


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = 8000, seed: int = 11) -> Model:
    """docs: doc_id, text; ratings: doc_id, rating. Of several ratings of a document the largest counts."""
    small_batches(docs.sparkSession)
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("rating").cast("int").alias("rating")).filter("doc_id IS NOT NULL AND rating IS NOT NULL").groupBy("doc_id").agg(F.max("rating").alias("rating"))
    chosen = rated.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "rating").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TextFeatures(BITS)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "rating": b.rating, "own": [reader.of_text(t).astype(np.int32).tobytes() for t in b.text]})

    read = rows.mapInPandas(features, "doc_id long, rating int, own binary").toPandas().sort_values(["doc_id", "own"])
    held = sorted(set(read.rating))
    if len(held) < 2:
        return Model([int(x) for x in held], np.zeros(0), np.zeros(0))
    own = [np.frombuffer(x, np.int32) for x in read.own]
    sizes = np.array([len(x) for x in own])
    at = np.repeat(np.arange(len(own)), sizes)
    weights, thresholds = cumulative_link(at, np.concatenate(own), 1 / np.sqrt(sizes)[at], np.searchsorted(held, read.rating), 1 << BITS, len(held))
    return Model([int(x) for x in held], weights, thresholds)


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """A graded rating from both labels: 0 for low quality, 1 for good but toxic text, 2 for good clean text."""
    return F.when(F.col(quality) == 0, 0).when(F.col(quality) == 1, F.when(F.col(toxic) == 1, 1).otherwise(2))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's expected grade, its probability of a rating of 1 or more (good text), and whether it is selected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", graded().alias("rating")))
    scored = model.score(docs, 1)
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))
