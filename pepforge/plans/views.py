"""The workflow's inputs as projections of the driver's tables, for Spark and as SQL with the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trailing tokens that play the proteases in the projected experiment names.
PROTEASES = ["click", "error", "purchase", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(c: Column | str) -> Column:
    """A-Z only. Other characters go before the case is changed, as engines differ on the case of non-ASCII letters."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


SQL_LETTERS = "upper(regexp_replace({}, '[^A-Za-z]', '', 'g'))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): whole texts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), letters("text").alias("seq"))


def sentences(spark: SparkSession, sf_dir: str, name: str, key: str, least: int = 12) -> DataFrame:
    """(id, n, seq): all sentences of at least so many letters."""
    parts = table(spark, sf_dir, name).select(F.col(key).alias("id"), F.posexplode(F.split("text", r"[.\n]")).alias("n", "s"))
    return parts.select("id", F.col("n").cast("long").alias("n"), letters("s").alias("seq")).filter(F.length("seq") >= least)


def sql_sentences(name: str, key: str, least: int = 12) -> str:
    parts = f"SELECT {key} AS id, unnest(string_split_regex(text, '[.\\n]')) AS s, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 AS n FROM {name}"
    return f"(SELECT id, CAST(n AS BIGINT) AS n, {SQL_LETTERS.format('s')} AS seq FROM ({parts}) WHERE length({SQL_LETTERS.format('s')}) >= {least})"


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): the sentences of benchmark, numbered. From the 1000th of a text on the numbers are above all others', as its
    thousand would reach into the next text's."""
    id = F.when(F.col("n") < 1000, F.col("id") * 1000 + F.col("n")).otherwise(F.lit(1 << 62) + numbered())
    return sentences(spark, sf_dir, "benchmark", "item_id").select(id.alias("id"), "seq")


def numbered() -> Column:
    """One number for the n-th part of the text id, that no other has (n is an index, below 2**31); an error for an id that is too large."""
    return F.col("id") * (1 << 31) + F.col("n")


def document_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq): the sentences of documents, all that aren't empty."""
    return sentences(spark, sf_dir, "documents", "doc_id", 1).select(numbered().alias("id"), "seq")


#: Bytes of UTF-8 that letters() drops, but for what bounds sentences, and what the others become: A-Z, and one bound.
DROPPED = bytes(i for i in range(256) if i >= 128 or not (chr(i).isalpha() or chr(i) in ".\n"))
LETTER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq): the same sentences as of document_peptides() by bytes, which takes a small part of the regular expressions' time. Those that a task
    meets together more than once are there once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                texts = batch.column(0).slice(i, 1000).drop_null().cast(pa.large_binary()).to_pylist()
                found = {s for text in texts for s in text.translate(LETTER, DROPPED).split(b".")} - {b""}
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], ["seq"])

    return table(spark, sf_dir, "documents").select("text").mapInArrow(rows, "seq string")


def document_size(spark: SparkSession, sf_dir: str) -> int:
    """The bytes of all texts of documents."""
    return table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0


SQL_DOCUMENT_PEPTIDES = f"(SELECT id * {1 << 31} + n AS id, seq FROM {sql_sentences('documents', 'doc_id', 1)})"


SQL_PEPTIDES = f"(SELECT id * 1000 + n AS id, seq FROM {sql_sentences('benchmark', 'item_id')})"


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, protein): whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", letters("text").alias("protein"))


SQL_PROTEINS = f"(SELECT item_id, {SQL_LETTERS.format('text')} AS protein FROM benchmark)"


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, experiment_name, preds, log_probs) from events."""
    e = table(spark, sf_dir, "events")
    coded = F.translate(F.col("event_id").cast("string"), "0123456789", "ACDEFGHIKL")
    preds = F.concat(F.upper("event_type"), F.lit("(+"), F.col("user_id").cast("string"), F.lit(")"), coded)
    return e.select(F.col("event_id").alias("row_id"), F.concat_ws("_", F.lit("exp"), "event_type", F.col("user_id").cast("string")).alias("experiment_name"), F.when(F.col("event_id") % 20 != 0, preds).alias("preds"), F.when(F.col("event_id") % 7 == 0, -1.0).otherwise(-F.col("value") / 100).alias("log_probs"))


SQL_PSMS = """(SELECT event_id AS row_id, 'exp_' || event_type || '_' || user_id AS experiment_name,
  CASE WHEN event_id % 20 <> 0 THEN upper(event_type) || '(+' || user_id || ')' || translate(CAST(event_id AS VARCHAR), '0123456789', 'ACDEFGHIKL') END AS preds,
  CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE -value / 100 END AS log_probs FROM events)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, start, end, id, identity_score, mismatches_pos) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    start = F.pmod("l_partkey", F.lit(500)).cast("int")
    wrong = F.filter(F.array(F.lit(0), F.lit(2), F.lit(5)), lambda x: x < F.col("l_discount") * 60)
    return li.select(F.col("l_suppkey").alias("grp"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_orderkey").alias("id"), (1 - F.col("l_discount")).alias("identity_score"), wrong.alias("mismatches_pos"))


SQL_INTERVALS = """(SELECT l_suppkey AS grp, CAST(l_partkey % 500 AS INT) AS "start", CAST(l_partkey % 500 AS INT) + CAST(l_quantity AS INT) AS "end", l_orderkey AS id,
  1 - l_discount AS identity_score, list_filter([0, 2, 5], lambda x: x < l_discount * 60) AS mismatches_pos FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ass_method, source, total_sequences, max_length, N50, coverage) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    k = F.pmod("l_suppkey", F.lit(5))
    number = F.pmod("l_suppkey", F.lit(4)).cast("string")
    run = F.when(k == 0, "bsa").when(k == 1, F.concat(F.lit("NB"), number)).when(k == 2, F.concat(F.lit("BIND"), number)).when(k == 3, F.concat(F.lit("ma"), number, F.when(F.col("l_returnflag") == "A", "heavy").otherwise("light"))).otherwise(F.concat(F.lit("pama"), number, F.when(F.col("l_returnflag") == "A", "heavy").otherwise("light")))
    method = F.when(F.col("l_linestatus") == "F", "dbg").otherwise("greedy")
    source = F.concat(F.lit("comb_"), method, F.lit("_c0.9"), F.pmod("l_orderkey", F.lit(4)).cast("string"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("_ks"), (6 + F.pmod("l_partkey", F.lit(2))).cast("string"))).otherwise(""), F.lit("_ts"), F.pmod("l_partkey", F.lit(11)).cast("string"), F.lit("_mo"), (3 + F.pmod("l_orderkey", F.lit(2))).cast("string"), F.lit("_mi0."), (6 + F.pmod("l_orderkey", F.lit(4))).cast("string"), F.lit("_mm"), (8 + F.pmod("l_partkey", F.lit(7))).cast("string"))
    return li.select(run.alias("run"), method.alias("ass_method"), source.alias("source"), F.pmod("l_partkey", F.lit(97)).alias("total_sequences"), F.col("l_quantity").cast("int").alias("max_length"), F.pmod("l_suppkey", F.lit(53)).alias("N50"), F.col("l_discount").alias("coverage"))


SQL_SCORES = """(SELECT CASE l_suppkey % 5 WHEN 0 THEN 'bsa' WHEN 1 THEN 'NB' || l_suppkey % 4 WHEN 2 THEN 'BIND' || l_suppkey % 4
    WHEN 3 THEN 'ma' || l_suppkey % 4 || CASE WHEN l_returnflag = 'A' THEN 'heavy' ELSE 'light' END
    ELSE 'pama' || l_suppkey % 4 || CASE WHEN l_returnflag = 'A' THEN 'heavy' ELSE 'light' END END AS run,
  CASE WHEN l_linestatus = 'F' THEN 'dbg' ELSE 'greedy' END AS ass_method,
  'comb_' || CASE WHEN l_linestatus = 'F' THEN 'dbg' ELSE 'greedy' END || '_c0.9' || l_orderkey % 4 || CASE WHEN l_linestatus = 'F' THEN '_ks' || (6 + l_partkey % 2) ELSE '' END
    || '_ts' || l_partkey % 11 || '_mo' || (3 + l_orderkey % 2) || '_mi0.' || (6 + l_orderkey % 4) || '_mm' || (8 + l_partkey % 7) AS source,
  l_partkey % 97 AS total_sequences, CAST(l_quantity AS INT) AS max_length, l_suppkey % 53 AS "N50", l_discount AS coverage FROM lineitem)"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln, id, aligned): customer names, all of one length, zeros as gaps."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("aln"), F.col("c_custkey").alias("id"), F.translate("c_name", "0#", "--").alias("aligned"))


SQL_ALIGNED = "(SELECT c_mktsegment AS aln, c_custkey AS id, translate(c_name, '0#', '--') AS aligned FROM customer)"
