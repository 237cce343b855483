"""The engine's expressions as SQL functions of a session, and windows as a table function for lateral calls."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Name, parameters, result and body of each.
FUNCTIONS = (
    ("normalize_seq", "s STRING", "STRING", "translate(s, 'I', 'L')"),
    ("strip_mods", "s STRING", "STRING", r"regexp_replace(s, '\\(.*?\\)', '')"),
    ("kmers", "s STRING, k INT", "ARRAY<STRING>", "coalesce(regexp_extract_all(s, concat('(?s)(?=(.{', k, '})).'), 1), array())"),
    ("merge_overlap", "a STRING, b STRING, n INT", "STRING", "concat(a, substring(b, n + 1))"),
    ("gap_runs", "s STRING", "ARRAY<INT>", "transform(regexp_extract_all(s, '-+', 0), x -> length(x))"),
)


class KmerTable:
    """kmer_table(seq, k): a row (at, kmer) for each window of k letters, places from 0; none for null or shorter sequences."""

    def eval(self, seq: str | None, k: int | None) -> Iterator[tuple[int, str]]:
        if seq is not None and k is not None and k > 0:
            for at in range(len(seq) - k + 1):
                yield at, seq[at : at + k]


def register(spark: SparkSession) -> None:
    spark.udtf.register("kmer_table", F.udtf(KmerTable, returnType="at int, kmer string"))
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
