"""Writers of the workflow's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import peptides as P

#: Columns of a sequence line.
LINE = 60


def fasta_text(name: Column | str, description: Column | str, seq: Column | str) -> Column:
    """A FASTA record, its sequence wrapped."""
    wrapped = F.array_join(F.regexp_extract_all(P.col(seq), F.lit(f".{{1,{LINE}}}"), F.lit(0)), "\n")
    return F.concat(F.lit(">"), F.rtrim(F.concat_ws(" ", P.col(name), P.col(description))), F.lit("\n"), wrapped)


def write_fasta(records: DataFrame, path: str, order: str = "n", by: list[str] | None = None) -> None:
    """records (name, description, seq) in their order; by: one folder for each value, each written by a task of its own."""
    by = by or []
    rows = records.select(*by, order, fasta_text("name", "description", "seq").alias("value"))
    if by:
        rows.repartition(*by).sortWithinPartitions(*by, order).drop(order).write.mode("overwrite").partitionBy(*by).text(path)
    else:
        rows.orderBy(order).drop(order).write.mode("overwrite").text(path)


def mapped_description() -> Column:
    """The description of a mapped contig, of its columns (sequence, start, end, mismatches_pos, identity_score). Halves are rounded
    to even."""
    return F.format_string("length: %d start: %d end: %d mismatches: %d identity: %.2f", F.length("sequence"), "start", "end", F.size("mismatches_pos"), P.rounded_half_even("identity_score", 2))


def write_clusters(members: DataFrame, path: str) -> None:
    """members (cluster, contig): tab-separated, without header."""
    members.select("cluster", "contig").write.mode("overwrite").csv(path, sep="\t")


def write_json(stats: DataFrame, path: str, by: list[str] | None = None) -> None:
    """An object a row; by: partitioned folders."""
    stats.write.mode("overwrite").partitionBy(*(by or [])).json(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",", by: list[str] | None = None) -> None:
    """Delimited files with header; by: partitioned folders."""
    rows.write.mode("overwrite").partitionBy(*(by or [])).csv(path, header=True, sep=sep)


#: The column of packed tables that names a row's folder.
FOLDER = "__folder"


def write_packed_csv(rows: DataFrame, path: str, folder: Column, sep: str = ",") -> None:
    """Tables of very many folders in a few delimited files with header: each row bears its folder's name, so that files grow in number
    with the tasks and not with the folders."""
    write_csv(rows.select(folder.alias(FOLDER), *rows.columns), path, sep)


def merged_tables(*tables: DataFrame) -> DataFrame:
    """All rows, by column name; a table without a column has nulls there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
