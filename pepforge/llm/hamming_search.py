"""Operator 3, exact top-k search: incremental multi-index hashing for binary codes.

A code is cut into segments of such a width that about ``PER_VALUE`` codes share a segment's value; the index has a posting list for
each value (long ones in several rows). A round at radius r looks up, for each query and for one or more segments, all values at
distance r from the query's (an equi-join on segment and value) and verifies what the lists hold by the full Hamming distance. When radius r is done for the first t of m segments, every code at distance
m * r + t - 1 or less has been found, as otherwise these would differ in more than r bits and the others in r or more. A query ends
when that covers its k-th distance; rounds go on for the other queries only. So radii with many values grow segment by segment.

Rows with one code are one entry with its k smallest ids, so a vector shared by many rows is looked up once; queries with one code
are one query. A pair is taken in the first round and segment in which it shows, so none counts twice. Every probe carries the
distance (and id) that its query's k-th answer has so far, and only codes that come before it are given on, so what a query yields
is bounded by what improves its answer, not by the lists that it looks up or by how Spark deals them.

Defined results: a null vector has no code, is no query and in no result; vectors shorter than ``bits`` are filled up with zeros,
longer ones cut; a null or NaN component is a 0 bit; ties are ordered by id; rows with a null id are not found and not queries;
repeated ids count once. Fewer than k rows with a code: all are returned; no rows or no queries: no result. Other columns than
the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table, unsaved

#: Values of a radius up to which all segments are looked up in one round.
AT_ONCE = 150
#: Codes that share a segment's value on average, and most entries of an index row.
PER_VALUE, LIST = 3, 500


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str, bits: int) -> DataFrame:
    """(id, code): the signs of the components, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b.vector:
                x = np.zeros(bits, bool)
                v = np.asarray(v, np.float64)[:bits]
                x[: len(v)] = v > 0
                out.append(np.packbits(x).tobytes())
            yield pd.DataFrame({"id": b.id, "code": out})

    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    return own.mapInPandas(run, "id long, code binary")


def words_of(codes: Iterable[bytes]) -> np.ndarray:
    """A row of 64-bit words for each code, zeros after its end."""
    held = [c + bytes(-len(c) % 8) for c in codes]
    return np.frombuffer(b"".join(held), ">i8").astype(np.int64).reshape(len(held), -1)


def bits_of(words: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), -1), axis=1)[:, :bits]


class Segments:
    def __init__(self, bits: int, width: float):
        self.bits, self.n = bits, max(1, round(bits / width))
        edges = [bits * i // self.n for i in range(self.n + 1)]
        self.spans = list(zip(edges, edges[1:], strict=False))
        self.width = max(z - a for a, z in self.spans)

    def values(self, codes: pd.Series) -> list[np.ndarray]:
        b = bits_of(words_of(codes), self.bits).astype(np.int64)
        return [b[:, a:z] @ (1 << np.arange(z - a, dtype=np.int64)) for a, z in self.spans]

    def index(self, codes: DataFrame) -> DataFrame:
        """(segment, value, words, n, first_id): the codes with that value, their words one after the other."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                words = list(words_of(b.code))
                for j, v in enumerate(self.values(b.code)):
                    yield pd.DataFrame({"segment": j, "value": v, "w": words, "n": b.n, "first_id": b.first_id})

        rows = codes.select("code", "n", "first_id").mapInPandas(run, "segment int, value long, w array<long>, n long, first_id long")
        size = rows.groupBy("segment", "value").agg(F.ceil(F.count(F.lit(1)) / LIST).alias("lists"))
        rows = rows.join(size, ["segment", "value"]).withColumn("list", F.pmod(F.xxhash64("first_id"), F.col("lists")))
        lists = rows.groupBy("segment", "value", "list").agg(F.collect_list(F.struct("w", "n", "first_id")).alias("p"))
        part = lambda f: F.transform("p", lambda x: x[f])
        return lists.select("segment", "value", F.flatten(part("w")).alias("words"), part("n").alias("n"), part("first_id").alias("first_id"))

    def rounds(self) -> Iterator[tuple[int, list[int]]]:
        """Radius and segments of each round: all at once while a radius has few values."""
        for radius in range(self.width + 1):
            if comb(self.width, radius) <= AT_ONCE:
                yield radius, list(range(self.n))
            else:
                yield from ((radius, [j]) for j in range(self.n))

    def probes(self, queries: DataFrame, radius: int, segments: list[int]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            masks = [np.array([sum(1 << i for i in c) for c in combinations(range(z - a), radius)], np.int64) for a, z in self.spans]
            for b in batches:
                values = self.values(b["query"])
                for j in segments:
                    v = values[j]
                    for i in range(0, len(b), 64):
                        own = v[i : i + 64, None] ^ masks[j]
                        asked = {c: np.repeat(b[c].to_numpy()[i : i + 64], len(masks[j])) for c in ("query", "far", "far_id")}
                        yield pd.DataFrame({"segment": j, "value": own.ravel(), **asked})

        # dealt over all tasks, as each query becomes many rows
        tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return queries.select("query", "far", "far_id").repartition(tasks).mapInPandas(run, "segment int, value long, query binary, far int, far_id long")

    def new_pairs(self, found: DataFrame, radius: int, k: int) -> DataFrame:
        """The pairs that show first in this round and segment and come before the query's bound (far, far_id), with their full
        distance; of a batch the k first of each query."""
        schema = "query binary, code binary, n long, first_id long, distance int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, ns, words = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("first_id", "n", "words"))
                if not len(ids):
                    continue
                row = np.repeat(np.arange(b.num_rows), b.column("first_id").value_lengths().to_numpy(zero_copy_only=False))
                queries = b.column("query").to_pylist()
                words = words.reshape(len(ids), -1)
                differs = bits_of(words ^ words_of(queries)[row], self.bits)
                d = np.stack([differs[:, a:z].sum(axis=1) for a, z in self.spans], axis=1)
                at = np.arange(self.n)[None, :]
                segment = b.column("segment").to_numpy(zero_copy_only=False)[row]
                far, far_id = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("far", "far_id"))
                whole = d.sum(axis=1)
                nearer = (whole < far) | ((whole == far) & (ids < far_id))
                first = np.flatnonzero(nearer & ((d > radius) | ((at >= segment[:, None]) & (d >= radius))).all(axis=1))
                name = np.unique(np.array(queries, dtype=object), return_inverse=True)[1][row]
                order = first[np.lexsort((ids[first], whole[first], name[first]))]
                start = np.searchsorted(name[order], name[order])
                order = order[np.arange(len(order)) - start < k]
                codes = [w.astype(">i8").tobytes()[: -(-self.bits // 8)] for w in words[order]]
                yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in row[order]], pa.binary()), pa.array(codes, pa.binary()), pa.array(ns[order]), pa.array(ids[order]), pa.array(whole[order].astype(np.int32))], ["query", "code", "n", "first_id", "distance"])

        return found.select("segment", "query", "far", "far_id", "words", "n", "first_id").mapInArrow(run, schema)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The k first codes of each query; as each has an id at least, they hold the k first ids."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first_id", "code"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def bounded(queries: DataFrame, found: DataFrame, k: int, bits: int) -> DataFrame:
    """(query, far, far_id): only codes at a distance under far, or at far with a first id under far_id, can be among the answers.

    found: the k first codes of each query. far is the distance up to which they have k ids; far_id the first id of the k-th code,
    if that is at this distance.
    """
    by = Window.partitionBy("query")
    rows = found.withColumn("ids", F.sum("n").over(by.orderBy("distance"))).withColumn("place", F.row_number().over(by.orderBy("distance", "first_id", "code")))
    far = rows.groupBy("query").agg(F.min(F.when(F.col("ids") >= k, F.col("distance"))).alias("far"), F.max(F.when(F.col("place") == k, F.struct("distance", "first_id"))).alias("last"))
    open_end = F.lit((1 << 63) - 1)
    far_id = F.when(F.col("last.distance") == F.col("far"), F.col("last.first_id")).otherwise(open_end)
    return queries.select("query").join(far, "query", "left").select("query", F.coalesce("far", F.lit(bits + 1)).alias("far"), F.coalesce(far_id, open_end).alias("far_id"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", width: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) of the k rows of vectors whose codes are nearest to each row of queries.

    width: bits of a segment; by default log2(number of codes / PER_VALUE), from 4 to 20.
    """
    rows = saved(binary_codes(vectors, id_col, vector_col, bits).distinct(), "codes")
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = saved(rows.withColumn("place", place).filter(F.col("place") <= k), "code-ids")
    codes = saved(ids.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), "distinct-codes")
    asked = saved(binary_codes(queries, id_col, vector_col, bits).distinct().withColumnsRenamed({"id": "query_id", "code": "query"}), "queries")
    cut = Segments(bits, width or float(np.clip(np.log2(max(2, codes.count() / PER_VALUE)), 4, 20)))
    index = saved(cut.index(codes), "segments")
    everything = F.lit((1 << 63) - 1)
    active = saved(asked.select("query").distinct().select("query", F.lit(bits + 1).alias("far"), everything.alias("far_id")), "active")
    found = None
    for radius, segments in cut.rounds():
        # Spark takes the probes for as small as the queries; so it mustn't broadcast them
        probed = cut.probes(active, radius, segments).hint("merge").join(index, ["segment", "value"])
        new = cut.new_pairs(probed, radius, k)
        before = found, active
        found = saved(nearest(new if found is None else found.unionAll(new), k), "found")
        covered = cut.n * radius + segments[-1]
        active = saved(bounded(active, found, k, bits).filter(F.col("far") > covered), "active")
        unsaved(*before)
        if not active.limit(1).count():
            break
    named = found.join(ids.select("code", "id"), "code")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    ranked = named.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "id", "distance")
    return asked.join(ranked, "query").select("query_id", "rank", "id", "distance")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows, by the Hamming distance of sign codes, of each row of embeddings whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = top_k(rows, rows.filter("vec_id % 50 = 0"))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


ORACLE_OP3 = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.b, c.b), lambda x: abs(x[1] - x[2]))) AS BIGINT) AS distance
  FROM c q, c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
