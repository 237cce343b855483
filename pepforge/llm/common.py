"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pepforge.store import kept as saved
from pepforge.store import shared_dir, unsaved

__all__ = ["ASCII_SPACE", "fresh", "quoted", "saved", "shared_dir", "small_batches", "table", "unsaved"]

#: The characters of [\x20\x09-\x0D]; bytes.split() and bytes.strip() use the same set.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark (the folder may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Python workers take batches of so many rows and 64 MB at most, so that long texts don't fill their memory.

    Plans run later than they are made, so the limit stays for the session; the rows are only ever lowered, and no result depends on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each wanted one that no column of df has, whatever its case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as select() and col() take it, whatever characters it holds."""
    return f"`{name.replace('`', '``')}`"
