"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a new temporary folder if they are one process
    (local mode, as in tests); on a cluster that is an error, as a folder of one machine would lose tables."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def kept(df: DataFrame, name: str = "table", by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """df written as Parquet and read again, which cuts the lineage of iterative plans and survives lost executors. by: columns that
    become folders, so that filters on them leave the others unread."""
    path = f"{shared_dir(df.sparkSession)}/pepforge-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path, compression=codec)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.pepforge_path = path
    return held


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, kept, to be broadcast in joins if it has few rows; beyond that Spark joins it as any other."""
    held = kept(df, "small")
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held


def unsaved(*held: DataFrame | None) -> None:
    """Deletes tables of kept() that no plan to come reads; what wasn't returned by kept() itself is left alone."""
    for df in held:
        if path := getattr(df, "pepforge_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
