"""Position-specific frequencies and consensus sequences of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residue_counts(aligned: DataFrame, keys: list[str], seq: str = "aligned") -> DataFrame:
    """(keys, pos, aa, n): how often each residue stands at each position (from 1); the gap '-' too."""
    rows = aligned.filter(F.length(seq) > 0).select(*keys, F.posexplode(F.split(seq, "")).alias("pos", "aa"))
    return rows.groupBy(*keys, (F.col("pos") + 1).alias("pos"), "aa").agg(F.count(F.lit(1)).alias("n"))


def pssm(aligned: DataFrame, keys: list[str], seq: str = "aligned") -> DataFrame:
    """(keys, pos, aa, freq): each residue's share of the position's residues, gaps left out; a position of gaps only has one row
    with a null residue and 0."""
    counts = residue_counts(aligned, keys, seq)
    residue = F.col("aa") != "-"
    total = counts.groupBy(*keys, "pos").agg(F.sum(F.when(residue, F.col("n"))).alias("total"))
    rows = total.join(counts.filter(residue), [*keys, "pos"], "left")
    return rows.select(*keys, "pos", "aa", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("freq"))


def pssm_wide(matrix: DataFrame, keys: list[str], residues: list[str]) -> DataFrame:
    """A column for each residue."""
    return matrix.groupBy(*keys, "pos").pivot("aa", residues).agg(F.first("freq")).na.fill(0.0, residues)


def consensus(matrix: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """(keys, seq): at each position the most frequent residue if its share is above the threshold (of equals the first), else '-'."""
    best = matrix.groupBy(*keys, "pos").agg(F.max(F.struct("freq", (-F.ascii(F.coalesce("aa", F.lit("-")))).alias("order"), "aa")).alias("b"))
    best = best.select(*keys, "pos", F.when(F.col("b.freq") > threshold, F.col("b.aa")).otherwise("-").alias("aa"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"]), "").alias("seq"))
