"""Scores of parameter sweeps: scaling, composite score, best rows, modes and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..store import kept, spread

#: The weights of the composite score's scaled metrics (fixed values); fewer sequences are better, so that one is turned round.
WEIGHTS = {"total_sequences": 0.1, "max_length": 0.1, "N50": 0.3, "coverage": 0.5}
INVERTED = ("total_sequences",)


def min_max(column: str, low: Column, high: Column, inverted: bool = False) -> Column:
    """The column scaled to 0..1 between low and high; 0 where these are equal."""
    scaled = F.when(high == low, F.lit(0.0)).otherwise((F.col(column) - low) / F.nullif(high - low, F.lit(0).cast("double")))
    return 1 - scaled if inverted else scaled


def with_scaled(rows: DataFrame, by: list[str], weights: dict[str, float] = WEIGHTS, inverted: tuple[str, ...] = INVERTED) -> DataFrame:
    """rows with {metric}_scaled within each group. The groups' bounds are aggregated and joined, so the rows aren't dealt by group."""
    bounds = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*[f(m).alias(f"__{m}_{n}") for m in weights for n, f in (("low", F.min), ("high", F.max))])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = rows.join(spread(bounds), same, "left")
    return both.select(*rows.columns, *[min_max(m, F.col(f"__{m}_low"), F.col(f"__{m}_high"), m in inverted).alias(f"{m}_scaled") for m in weights])


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    parts = [w * F.col(f"{m}_scaled") for m, w in weights.items()]
    return sum(parts[1:], parts[0])


def scored(*tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All tables by column name, with scaled metrics and composite_score, in no order; metrics are scaled within each method."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    return with_scaled(rows, by or ["ass_method"]).withColumn("composite_score", composite())


def composite_scores(*tables: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same, best first."""
    return scored(*tables, by=by).orderBy(F.col("composite_score").desc())


def best_per(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row with the largest score of each group (null scores last); of equals the first by tie. Aggregated before the shuffle."""
    order = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), order).alias("__best")).select(*[F.col(f"__best.{c}").alias(c) for c in rows.columns])


def modes(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The most frequent value of each column and group, nulls aside; of equals the smallest."""
    return rows.groupBy(*by).agg(*[F.mode(c, True).alias(f"{c}_mode") for c in columns])


def with_config(rows: DataFrame, key: str = "source") -> DataFrame:
    return rows.withColumns(P.config_parts(key))


def best_config_modes(scores: DataFrame, run: str = "run", category: str = "category", key: str = "source") -> DataFrame:
    """The parameters that are most often the best ones of a run, by category."""
    best = with_config(best_per(scores, [run], "composite_score", key), key)
    return modes(best, [category], [name for name, _ in P.KEY_PARTS])


def max_per(rows: DataFrame, by: str, metric: str) -> DataFrame:
    return rows.groupBy(by).agg(F.max(metric).alias(metric))


def in_order(rows: DataFrame, wanted: list[str], key: str, fill: float = 0.0) -> DataFrame:
    """rows for the wanted keys in the given order, missing ones filled."""
    names = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(k).alias(key)) for i, k in enumerate(wanted)])
    dimension = rows.sparkSession.range(1).select(F.inline(names))
    return dimension.join(rows, key, "left").na.fill(fill)


def pivot_max(rows: DataFrame, index: list[str], columns: list[str], value: str, domain: list[str]) -> DataFrame:
    """Wide: the largest value by index and the combined column key. domain: the keys, so that Spark needn't look for them."""
    keyed = rows.withColumn("__key", F.concat_ws("_", *[F.col(c).cast("string") for c in columns]))
    return keyed.groupBy(*index).pivot("__key", domain).agg(F.max(value))


def pivot_max_filled(rows: DataFrame, index: list[str], columns: list[str], value: str) -> DataFrame:
    """Long: (index, columns, value) for every pair of seen index and column keys; holes get the mean of the cells of the same first
    index key. The keys' domains are a sweep's parameters, so few."""
    cells = kept(rows.groupBy(*index, *columns).agg(F.max(value).alias(value)), "cells")
    grid = cells.select(*index).distinct().join(spread(cells.select(*columns).distinct()))
    full = grid.join(cells, [*index, *columns], "left")
    return full.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(index[0]))))


def paired_runs(scores: DataFrame, run: str = "run", score: str = "composite_score") -> DataFrame:
    """(idx, chain, mono, poly): scores of monoclonal and polyclonal runs side by side, for the numbers that have all four runs."""
    rows = scores.withColumns({"kind": F.regexp_extract(run, r"^(pama|ma)(\d+)(heavy|light)$", 1), "idx": F.regexp_extract(run, r"^(pama|ma)(\d+)(heavy|light)$", 2), "chain": F.regexp_extract(run, r"^(pama|ma)(\d+)(heavy|light)$", 3)}).filter("kind <> ''")
    both = rows.groupBy("idx", "chain").agg(F.max(F.when(F.col("kind") == "ma", F.col(score))).alias("mono"), F.max(F.when(F.col("kind") == "pama", F.col(score))).alias("poly"))
    whole = both.filter("mono IS NOT NULL AND poly IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("idx")))
    return whole.filter("n = 2").drop("n")


def subset_of(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, within): whether all values of each key are among those of held (value)."""
    known = held.select(F.col("value"), F.lit(True).alias("__known")).distinct()
    return rows.select(key, "value").distinct().join(known, "value", "left").groupBy(key).agg(F.bool_and(F.coalesce("__known", F.lit(False))).alias("within"))
