"""The training-data pipeline: STAGES in order, each over all rows that the one before kept.

All but the last return the columns of documents. Each decision takes effect: toxic documents go, repeated lines go from the texts
(n_chars follows), one document of each near-duplicate group stays, contaminated documents go, and the mix tells the words to take
of each document that is left. Nulls, empty texts, ties, repeated rows and empty tables: as the operators' docstrings define. Further
columns of documents, whatever their names, pass through all stages, but mixing replaces size, source_size, target and taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepforge.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from pepforge.llm.common import fresh, quoted, saved, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.7 or more; learns from rows that aren't held out only."""
    return toxicity.drop_toxic(docs, toxicity.fold_model(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]  # the input's own, which the operator would replace
    aside = dict(zip(made, fresh(docs, *[f"own_{c}" for c in made]), strict=True))
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).select(*[F.col(quoted(aside.get(c, c))).alias(c) for c in docs.columns])
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8."""
    return near_dedup.near_dedup(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, source_size, target and taken."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage's scores can't be expressed in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
