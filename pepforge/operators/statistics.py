"""Statistics of assemblies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from .mapping import covered_length


def n_statistic(seqs: DataFrame, keys: list[str], length: str = "length", shares: dict[str, float] | None = None) -> DataFrame:
    """(keys, N50, N90): the first length, from long to short, with which the running sum reaches half and nine tenths of all.

    Rows are counted by length before the running sum, so a group's window holds its distinct lengths only.
    """
    shares = shares or {"N50": 0.5, "N90": 0.9}
    by = seqs.groupBy(*keys, length).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(F.col(length).desc())
    by = by.withColumns({"__sum": F.sum(F.col(length) * F.col("__n")).over(order), "__all": F.sum(F.col(length) * F.col("__n")).over(Window.partitionBy(*keys))})
    return by.groupBy(*keys).agg(*[F.max(F.when(F.col("__sum") >= F.col("__all") * s, F.col(length))).cast("int").alias(n) for n, s in shares.items()])


def assembly_statistics(mapped: DataFrame, reference_length: int | Column, keys: list[str] | None = None, strict: bool = False, identity: bool = True) -> DataFrame:
    """One row of statistics for each group of mapped sequences (start, end, mismatches_pos, identity_score).

    As published, positions count as closed and from 1 although they are half-open and from 0: a length is one more, coverage counts
    the position before the start and divides by the reference's length + 1. strict gives the exact values.
    total_mismatches is the number of distinct offsets at which any sequence has one. Without rows and keys: one row with
    total_sequences 0 and nulls.
    """
    keys = keys or []
    one = [] if keys else ["__all"]
    rows = mapped if keys else mapped.withColumn("__all", F.lit(1))
    by = keys or one
    shift = 0 if strict else 1
    rows = rows.withColumns({"length": F.col("end") - F.col("start") + shift, "__from": F.col("start") - shift})
    size = F.lit(reference_length) if isinstance(reference_length, int) else reference_length
    figures = [F.count("start").alias("total_sequences"), F.avg("length").alias("average_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length")]
    if identity:
        figures += [F.avg("identity_score").alias("mean_identity"), F.median("identity_score").alias("median_identity"), F.count(F.when(F.size("mismatches_pos") == 0, 1)).alias("perfect_matches")]
    out = rows.groupBy(*by).agg(*figures).join(n_statistic(rows, by), by, "left").join(covered_length(rows, by, "__from", "end"), by, "left")
    if identity:
        offsets = rows.select(*by, F.explode("mismatches_pos").alias("offset")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("total_mismatches"))
        out = out.join(offsets, by, "left").withColumn("total_mismatches", F.coalesce("total_mismatches", F.lit(0)).cast("long"))
    out = out.withColumns({"reference_start": F.lit(0), "reference_end": (size + shift).cast("int"), "coverage": F.col("covered") / (size + shift)}).drop("covered")
    if keys:
        return out
    return mapped.sparkSession.range(1).withColumn("__all", F.lit(1)).drop("id").join(out, "__all", "left").drop("__all").withColumn("total_sequences", F.coalesce("total_sequences", F.lit(0)).cast("long"))


def consensus_statistics(consensus: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Of consensus sequences (gaps as '-'): how many, longest and shortest run of gaps, percent without gaps, lengths."""
    runs = P.gap_runs(seq)
    rows = consensus.withColumns({"__long": F.array_max(runs), "__short": F.array_min(runs), "__n": F.length(seq)})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_fasta_files"),
        zero(F.max("__long")).alias("longest_gap"),
        zero(F.min("__short")).alias("shortest_gap"),
        F.coalesce(F.round(100 * F.avg(F.when(F.col("__long").isNull(), 1.0).otherwise(0.0)), 2), F.lit(0.0)).alias("percent_without_gaps"),
        zero(F.max("__n")).alias("max_consensus_length"),
        zero(F.min("__n")).alias("min_consensus_length"),
        F.coalesce(F.round(F.avg("__n"), 2), F.lit(0.0)).alias("avg_consensus_length"),
    )
