"""The data behind the figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..store import kept


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(column, n) without nulls, most frequent first."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def missing_shares(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Counts and percentages of valid and missing values; 0 without rows."""
    by = rows.groupBy(*(keys or [])).agg(F.count(column).alias("valid"), (F.count(F.lit(1)) - F.count(column)).alias("missing"), F.count(F.lit(1)).alias("total"))
    share = lambda c: F.coalesce(F.round(100 * F.col(c) / F.nullif(F.col("total"), F.lit(0)), 2), F.lit(0.0))
    return by.withColumns({"valid_percent": share("valid"), "missing_percent": share("missing")})


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, n): bins of equal width, each without its right edge but the last with it; values outside are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    own = rows.filter(F.col(column).between(low, high)).withColumn("bin", at)
    return own.groupBy(*(keys or []), "bin").agg(F.count(F.lit(1)).alias("n"))


def mapped_by_bin(rows: DataFrame, column: str, flag: str, bin_of: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, mapped, unmapped, n): by the boolean flag; rows whose bin is null are left out."""
    own = rows.withColumn("bin", bin_of.cast("int")).filter("bin IS NOT NULL")
    return own.groupBy(*(keys or []), "bin").agg(F.count(F.when(F.col(flag), 1)).alias("mapped"), F.count(F.when(~F.col(flag), 1)).alias("unmapped"), F.count(F.lit(1)).alias("n"))


def stacked_histogram(rows: DataFrame, column: str, flag: str, low: float, high: float = 1.0, width: float = 0.02) -> DataFrame:
    """(bin, mapped, unmapped, n) of the values from low on, the last bin with its right edge; values above high are left out."""
    bins = max(1, math.ceil((high + width / 10 - low) / width))
    bin_of = F.when((F.col(column) >= low) & (F.col(column) <= high), F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)))
    return mapped_by_bin(rows, column, flag, bin_of)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows, sorted before, with their place from 1.

    Sorting deals rows by ranges, so the place within a partition and the number of rows in those before it make the place; no
    task sees more than its range. The sorted rows are kept in between, as ranges could be cut elsewhere when they are read twice.
    """
    held = kept(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    firsts = sizes.select("__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return held.join(F.broadcast(firsts), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before")


def ratio_bins(rows: DataFrame, column: str, flag: str, bins: int = 20) -> DataFrame:
    """Mapped and unmapped rows of bins [i/bins, (i+1)/bins) and their ratio, null without unmapped ones; 1 itself is in none."""
    bin_of = F.when((F.col(column) >= 0) & (F.col(column) < 1), F.floor(F.col(column) * bins))
    out = mapped_by_bin(rows, column, flag, bin_of)
    return out.withColumn("ratio", F.col("mapped") / F.nullif(F.col("unmapped"), F.lit(0))).withColumn("centre", (F.col("bin") + 0.5) / bins)


def percent_bins(rows: DataFrame, column: str, flag: str, width: float = 0.05) -> DataFrame:
    """Percent mapped of right-closed bins (i*w, (i+1)*w] up to 0.95 as published: 0 and what is above that are left out."""
    n = math.floor(1 / width + 1e-9) - 1
    bin_of = F.when((F.col(column) > 0) & (F.col(column) <= n * width), F.ceil(F.col(column) / width) - 1)
    out = mapped_by_bin(rows, column, flag, bin_of)
    return out.withColumns({"mapped_percent": 100 * F.col("mapped") / F.col("n"), "unmapped_percent": 100 * F.col("unmapped") / F.col("n"), "centre": (F.col("bin") + 0.5) * width})


def first_crossing(points: DataFrame, x: str, y: str, level: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, crossing): where the line through the points first meets the level, from either side; nulls never do. Few points a group."""
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(x)
    steps = points.withColumns({"__x": F.lag(x).over(order), "__y": F.lag(y).over(order)})
    met = ((F.col("__y") < level) & (F.col(y) >= level)) | ((F.col("__y") > level) & (F.col(y) <= level))
    at = P.crossing_x(F.col("__x"), F.col("__y"), F.col(x), F.col(y), F.lit(level))
    return steps.filter(met).groupBy(*(keys or [])).agg(F.min(F.struct(F.col(x).alias("x"), at.alias("at"))).alias("c")).select(*(keys or []), F.col("c.at").alias("crossing"))


def first_overtaking(points: DataFrame, x: str, a: str, b: str) -> DataFrame:
    """(crossing): where a first overtakes b."""
    ahead = points.withColumn("__d", F.col(a) - F.col(b))
    order = Window.partitionBy(F.lit(1)).orderBy(x)
    steps = ahead.withColumns({"__x": F.lag(x).over(order), "__e": F.lag("__d").over(order)}).filter("__e < 0 AND __d >= 0")
    at = P.crossing_x(F.col("__x"), F.col("__e"), F.col(x), F.col("__d"), F.lit(0.0))
    return steps.agg(F.min(F.struct(F.col(x).alias("x"), at.alias("at"))).alias("c")).select(F.col("c.at").alias("crossing")).filter("crossing IS NOT NULL")


def box_stats(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*keys).agg(q.alias("q"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most")).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "least", "most")


def kernel_density(rows: DataFrame, key: str, column: str, points: int = 500, floor: float = 1e-6) -> DataFrame:
    """(key, x, log_density): Gaussian kernel estimate with Scott's bandwidth on a grid over each group's range; groups of one row or
    without spread are left out. Rows with equal values are counted first."""
    stats = rows.filter(F.col(column).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp(column).alias("__sd"), F.min(column).alias("__low"), F.max(column).alias("__high")).filter("__n > 1 AND __sd > 0")
    step = (F.col("__high") - F.col("__low")) / (points - 1)
    grid = stats.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("__low") + F.col("__i") * step)
    h = F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2))
    counted = rows.filter(F.col(column).isNotNull()).groupBy(key, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    z = (F.col("x") - F.col("__v")) / h
    dense = F.sum(F.col("__m") * F.exp(-z * z / 2)) / (F.first("__n") * F.first(h) * math.sqrt(2 * math.pi))
    return grid.join(counted, key).groupBy(key, "__i", "x").agg(dense.alias("d")).select(key, "x", F.log10(F.col("d") + floor).alias("log_density"))


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, rank): values by frequency, most frequent first; of equals the first by name. A vocabulary is small."""
    counts = value_counts(rows, column)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), column)))


def top_sets(ranks: DataFrame, column: str) -> DataFrame:
    """(top, column): for each i the i most frequent values."""
    most = ranks.withColumn("most", F.max("rank").over(Window.partitionBy(F.lit(1))))
    return most.withColumn("top", F.explode(F.sequence("rank", "most"))).select("top", column)
