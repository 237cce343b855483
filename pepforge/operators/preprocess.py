"""Cleaning and filtering of peptide-spectrum matches (PSMs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import peptides as P
from .overlap import containing

#: Part of the description of the contaminant that is the sample itself in BSA runs (a fixed value of the contaminant list).
BSA_RECORD = "Bovine serum albumin precursor"


def clean_psms(psms: DataFrame, proteases: Iterable[str]) -> DataFrame:
    """psms (experiment_name, preds, log_probs, ...) with protease, conf and cleaned_preds; rows without prediction go."""
    kept = psms.filter(F.col("preds").isNotNull()).withColumn("log_probs", P.clean_log_prob("log_probs"))
    return kept.withColumns({"protease": P.protease("experiment_name", proteases), "conf": P.confidence("log_probs"), "cleaned_preds": P.without_modifications("preds")})


def by_confidence(psms: DataFrame, tie: str | None = None) -> DataFrame:
    """Most confident first; equal ones by the tie column."""
    return psms.orderBy(F.col("conf").desc(), *([tie] if tie else []))


def over_confidence(psms: DataFrame, least: float) -> DataFrame:
    """Strictly above, as for assembly."""
    return psms.filter(F.col("conf") > least)


def confidence_from(psms: DataFrame, least: float) -> DataFrame:
    """At least, as for the figures."""
    return psms.filter(F.col("conf") >= least)


def confidence_between(psms: DataFrame, least: float, most: float) -> DataFrame:
    return psms.filter(F.col("conf").between(least, most))


def contaminants_for(run: str, contaminants: DataFrame) -> DataFrame:
    """The contaminant records that count for a run: in BSA runs albumin itself isn't one."""
    return contaminants.filter(~F.contains(F.col("description"), F.lit(BSA_RECORD))) if run == "bsa" else contaminants


def without_contaminants(psms: DataFrame, contaminants: DataFrame, run: str = "", seq: str = "cleaned_preds", normalize: bool = False, seed: int = 4) -> DataFrame:
    """psms but those whose sequence is part of a contaminant's. contaminants: (description, seq).

    The search is an equi-join on seeds, see ``containing``. normalize also turns I into L in the contaminants.
    """
    held = contaminants_for(run, contaminants).select((P.normalized("seq") if normalize else F.col("seq")).alias("holder"))
    bad = containing(psms.select(F.col(seq).alias("part")).distinct(), held, seed).select("part").distinct()
    return psms.join(bad, psms[seq] == bad.part, "left_anti")


def with_mapped(psms: DataFrame, protein: str | Column, seq: str = "cleaned_preds") -> DataFrame:
    """The string flag mapped ('True' or 'False') and beside it the boolean is_mapped."""
    protein = F.lit(protein) if isinstance(protein, str) else protein
    return psms.withColumns({"mapped": P.mapped_flag(seq, protein), "is_mapped": F.contains(protein, F.col(seq))})


def size_over(seqs: DataFrame, least: int, seq: str = "seq") -> DataFrame:
    return seqs.filter(F.length(seq) > least)


def by_length(seqs: DataFrame, seq: str = "seq", tie: str | None = None) -> DataFrame:
    """Longest first, equal ones alphabetically, then by the tie column."""
    return seqs.orderBy(F.length(seq).desc(), seq, *([tie] if tie else []))


def counted(rows: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows (n) and of those that each step leaves."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"))
    for name, left in steps.items():
        counts = counts.join(left.agg(F.count(F.lit(1)).alias(name)))
    return counts
