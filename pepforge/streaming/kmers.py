"""Incremental k-mer counts of a stream of sequences (beyond the batch workflow)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import kmer_counts, kmer_rows


def streaming_kmer_counts(stream: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A streaming aggregate; run it in update or complete mode."""
    return kmer_counts(kmer_rows(stream.select(seq), k, seq))
