"""Readers of the workflow's files; all paths are read by Spark, so they can be in any store and be globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import peptides as P
from . import schema
from .writers import FOLDER

FILE = "_metadata.file_path"


def psms(spark: SparkSession, path: str, columns: str = schema.PSM) -> DataFrame:
    """A CSV file with header; the columns are found by their names, and none is inferred."""
    wanted = [f.name for f in spark.createDataFrame([], columns).schema]
    rows = spark.read.option("header", True).csv(path)
    typed = spark.createDataFrame([], columns).schema
    return rows.withColumns({n: F.col(n).try_cast(typed[n].dataType.simpleString()) for n in wanted if n in rows.columns})


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, id, description, seq): one row for each record, multi-line sequences joined, blank lines tolerated.

    Files are split at the records by Spark's text reader (line separator: newline and >), so a large file is many tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.col(FILE)).withColumn("n", F.monotonically_increasing_id())
    record = F.regexp_replace(F.regexp_replace("value", r"^\s*>?", ""), "\r", "")
    rows = raw.withColumn("record", record).filter(F.length(F.trim("record")) > 0)
    header = F.substring_index("record", "\n", 1)
    body = F.regexp_replace(F.substr("record", F.length(header) + 1), r"\s", "")
    return rows.select("file", "n", F.regexp_extract(header, r"^(\S*)", 1).alias("id"), F.trim(header).alias("description"), body.alias("seq"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster membership: tab-separated, without header."""
    return spark.read.schema(schema.CLUSTERS).csv(path, sep="\t")


def tables_with_origin(spark: SparkSession, path: str, sep: str = ",", origin: str = "source_folder", pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Delimited files with header, and a column that the pattern takes from each file's path."""
    rows = spark.read.option("header", True).csv(path, sep=sep)
    return rows.withColumn(origin, F.regexp_extract(F.col(FILE), pattern, 1))


def packed_tables(spark: SparkSession, path: str, columns: str, sep: str = ",", origin: str = "source_folder") -> DataFrame:
    """tables_with_origin of what write_packed_csv wrote; the headers must match columns."""
    rows = spark.read.schema(f"{FOLDER} string, {columns}").csv(path, sep=sep, header=True, enforceSchema=False)
    return rows.withColumnRenamed(FOLDER, origin)


def with_category(rows: DataFrame, run: str = "run") -> DataFrame:
    """rows with the run's category."""
    return rows.withColumn("category", P.category(run))


def stats_json(spark: SparkSession, path: str, columns: str = schema.ASSEMBLY_STATS, lines: bool = False) -> DataFrame:
    """A pretty-printed JSON object a file, with source (the configuration's folder), method, sequence_type and run from the path.

    Folders look like {run}/comb_{method}_.../statistics/{type}_stats.json; the method of others is 'other'. lines: many
    objects a file, one a line.
    """
    rows = spark.read.schema(columns).json(path, multiLine=not lines).withColumn("path", F.col(FILE))
    method = F.regexp_extract("path", r"/comb_(dbg|greedy)[^/]*/", 1)
    return rows.withColumns({"source": F.regexp_extract("path", r"/(comb_[^/]+)/", 1), "ass_method": F.when(method == "", "other").otherwise(method), "sequence_type": F.regexp_extract("path", r"/([^/]+)_stats\.json$", 1), "run": F.regexp_extract("path", r"/([^/]+)/comb_[^/]+/", 1)}).drop("path")


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SCORES).csv(path, header=True, enforceSchema=False)


def json_value(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(value): a whole JSON file as the given type."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("value"))


def sample_metadata(spark: SparkSession, path: str, run: str, chain: str = "") -> DataFrame:
    """(protein, chain, proteases) of the first entry of the run with that chain; an error when read if there is none."""
    entries = json_value(spark, path, schema.METADATA).select(F.filter(F.element_at("value", run), lambda x: x["chain"] == chain).alias("found"))
    first = F.coalesce(F.get("found", F.lit(0)), F.raise_error(F.lit(f"no metadata for run {run!r} and chain {chain!r}")))
    return entries.select(first.alias("entry")).select("entry.*")


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(method, parameter, values) of a parameter grid."""
    return json_value(spark, path, schema.GRID).select(F.explode("value").alias("method", "p")).select("method", F.explode("p").alias("parameter", "values"))


def colors(spark: SparkSession, path: str, category: str) -> DataFrame:
    """(name, color) for a category like 'Antibodies_dbg': by what stands before the first _, in lower case."""
    own = F.element_at("value", F.lower(F.substring_index(F.lit(category), "_", 1)))
    return json_value(spark, path, schema.COLORS).select(F.explode(own).alias("name", "color"))


def missing_folders(spark: SparkSession, path: str, expected: DataFrame, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """The expected folders (folder) that hold none of the files under path."""
    there = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", pattern, 1).alias("folder")).distinct()
    return expected.join(there, "folder", "left_anti")


def without_tables(expected: DataFrame, there: DataFrame) -> DataFrame:
    """missing_folders for packed tables: the expected folders (folder) of which there has no row."""
    return expected.join(there.select("folder").distinct(), "folder", "left_anti")


def consensus_by_folder(spark: SparkSession, path: str, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(folder, seqs) of all FASTA files under path."""
    rows = fasta(spark, path).withColumn("folder", F.regexp_extract("file", pattern, 1))
    return rows.groupBy("folder").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
