"""Operator 12, ranked lexical search: a K2-treap over the grid of terms and documents.

``build_index`` deals the documents into segments of about ``segment_words`` words. In a segment, terms are rows (most frequent first, so
that full and nearly empty rows lie apart), documents are columns (by doc_id), and a cell is the impact of a term in a document, which no
query changes. The grid is a quadtree of non-empty cells only: a node has a mask of its four quadrants and the greatest impact below
it, kept as the difference to its parent's; both are compressed. Segments are rows of a Parquet table in the shared folder.

``search`` goes through each segment with every item. An item's terms are paths of rows that go down jointly: a range of documents is at
one node for each term, and the weighted sum of these nodes' maxima bounds every score in the range. Ranges wait in a heap, the best
bound first (of equals the smallest doc_id); a few of the best at once are halved, and a range that has come down to one document has its
exact score. It ends when the best bound left can't enter the item's k best so far, which a task carries from segment to segment.
A task gives on k rows an item; these are ranked by Spark.

Two passes over the texts make the index (the corpus' counts come first, as impacts need them), and the index holds every term's document
frequency. Items are handled in blocks of about ``block_chars`` code points, the only thing that goes through the driver; a larger set of
items takes more passes over the index.

Terms: ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. Weight and impact are the contract's (see ``weight``, ``impacts``).

Defined results: null or empty texts have no terms and are in no answer; rows with one doc_id each have a place of their own, null
doc_ids come last among equal scores; rows of one item_id are one item (a null item_id, too); an item without a matching document, an
empty table of documents or of items gives no row. Ties go by doc_id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import saved, small_batches, table

#: Byte by byte: A-Z to a-z, and what no term holds to a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEGMENT = "terms binary, dfs binary, doc_ids array<long>, sizes array<long>, masks binary, drops binary"

#: How many quadrants a mask has, whether it has one (at 4 * mask + quadrant), and how many of its quadrants come before that.
FULL = np.array([m.bit_count() for m in range(16)], np.uint8)
HAS = np.array([m >> q & 1 > 0 for m in range(16) for q in range(4)])
BEFORE = np.array([(m & ((1 << q) - 1)).bit_count() for m in range(16) for q in range(4)])

#: Rows are so many times (as a power of 2) further apart than columns, so that the paths of terms part while ranges are still wide.
STRETCH = 3

LAST_ID = 2**63 - 1  # stands for null


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What tf occurrences in a document of n terms count, before the term's weight: below 1000000."""
    m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Each bit of x at twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def packed(x: bytes) -> bytes:
    """Compressed in the task, so that a row of the index is small wherever Spark holds it; its size comes first."""
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def unpacked(b: bytes) -> bytes:
    return pa.decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: small numbers leave planes of zeros. Impacts have three bytes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    low = np.frombuffer(b, np.uint8).reshape(3, -1)
    out = low[2].astype(np.int32)
    for plane in (low[1], low[0]):
        out <<= 8
        out |= plane
    return out


def bounded_batches(spark) -> None:
    """Rows of the index are large, so fewer bytes of them go to a Python worker at once than the other operators send."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def treap(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> dict:
    """The quadtree's levels from the root down: sizes, masks (all levels but the cells), and the maxima's drops from their parents'."""
    height = max(1, int(max(rows.max(), cols.max())).bit_length())
    code = spread_bits(rows) << np.uint64(1) | spread_bits(cols)
    order = np.argsort(code)
    code, top = code[order], values[order].astype(np.int64)
    masks, drops, sizes = [], [], [len(code)]
    for _ in range(height):
        quadrant, above = (code & np.uint64(3)).astype(np.uint8), code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        best = np.maximum.reduceat(top, first)
        masks.append(np.bitwise_or.reduceat(np.left_shift(np.uint8(1), quadrant), first))
        drops.append(np.repeat(best, np.diff(first, append=len(code))) - top)
        code, top = above[first], best
        sizes.append(len(code))
    drops.append(top)  # the root's own
    return {"sizes": sizes[::-1], "masks": packed(np.concatenate(masks[::-1]).tobytes()), "drops": packed(planes(np.concatenate(drops[::-1])))}


def segment(doc_ids: list[int | None], docs: list[np.ndarray], terms: list[bytes], n_docs: int, n_terms: int) -> dict:
    """One row of the index. docs: each document's terms as numbers."""
    by_id = sorted(range(len(docs)), key=lambda d: (doc_ids[d] is None, doc_ids[d] or 0))
    sizes = np.array([len(docs[d]) for d in by_id], np.int64)
    cells, tf = np.unique(np.repeat(np.arange(len(docs), dtype=np.int64), sizes) * len(terms) + np.concatenate([docs[d] for d in by_id]), return_counts=True)
    col, term = cells // len(terms), cells % len(terms)
    dfs = np.bincount(term, minlength=len(terms))
    by_df = np.argsort(-dfs, kind="stable")
    row = np.empty(len(terms), np.int64)
    row[by_df] = np.arange(len(terms))
    tree = treap(row[term] << STRETCH, col, impacts(tf, sizes[col], n_docs, n_terms))
    return {"terms": packed(b" ".join([terms[i] for i in by_df.tolist()])), "dfs": dfs[by_df].astype("<i4").tobytes(), "doc_ids": [doc_ids[d] for d in by_id], **tree}


def counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in batches:
            for text in b.column(0):
                n = len(terms_of(text.as_py()))
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_pylist([{"docs": n_docs, "terms": n_terms}], pa.schema([("docs", pa.int64()), ("terms", pa.int64())]))

    bounded_batches(docs.sparkSession)
    row = docs.select(F.col("text").cast("string")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build_index(docs: DataFrame, segment_words: int = 500_000) -> tuple[DataFrame, int]:
    """(index, documents with terms)."""
    n_docs, n_terms = counts(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("terms", pa.binary()), ("dfs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("masks", pa.binary()), ("drops", pa.binary())])

        def new() -> tuple:
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            return numbers, [], [], 0

        numbers, ids, own, n = new()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                ids.append(doc)
                own.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                n += len(words)
                if n >= segment_words:
                    yield pa.RecordBatch.from_pylist([segment(ids, own, list(numbers), n_docs, n_terms)], schema)
                    numbers, ids, own, n = new()
        if own:
            yield pa.RecordBatch.from_pylist([segment(ids, own, list(numbers), n_docs, n_terms)], schema)

    bounded_batches(docs.sparkSession)
    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SEGMENT), "treap-index"), n_docs


class Treap:
    """A segment, its levels one after the other: mask, first child and greatest impact of every node."""

    def __init__(self, row: dict):
        self.ids = np.array([LAST_ID if d is None else d for d in row["doc_ids"]], np.int64)
        sizes = row["sizes"]
        self.height = len(sizes) - 1
        n, masks = sum(sizes), np.frombuffer(unpacked(row["masks"]), np.uint8)
        children = FULL[masks].astype(np.int32)
        # beyond the nodes: one that stands for a term that isn't in a range
        self.none = n
        self.masks = np.zeros(n + 1, np.uint8)
        self.masks[: len(masks)] = masks * np.uint8(4)
        self.first = np.zeros(n + 1, np.int32)
        self.first[: len(masks)] = np.cumsum(children) - children + 1  # the root is 0, so the first child of all is 1
        self.tops = np.append(from_planes(unpacked(row["drops"])), np.int32(0))
        at = 0
        for upper, lower in zip(sizes, sizes[1:], strict=False):
            below = slice(at + upper, at + upper + lower)
            self.tops[below] = np.repeat(self.tops[at : at + upper], children[at : at + upper]) - self.tops[below]
            at += upper

    def search(self, rows: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int, at_once: int = 128) -> None:
        """Puts (score, -doc_id) of documents into best, a heap of the k best, the worst first."""
        bits = (((rows << STRETCH)[None, :] >> np.arange(self.height - 1, -1, -1)[:, None]) & 1) * 2  # each level's quadrants of the rows
        nodes = np.zeros(len(rows), np.int64)
        heap = [(-int(weights.sum() * self.tops[0]), 0, 0, 0, nodes)]
        ids, n_cols = self.ids, len(self.ids)
        while heap:
            taken = []
            while heap and len(taken) < at_once:
                top = heap[0]
                if len(best) == k and (-top[0], -int(ids[top[1]])) <= best[0]:
                    heap.clear()
                    break
                taken.append(heapq.heappop(heap))
            if not taken:
                return
            depth = np.array([x[3] for x in taken])
            held = np.stack([x[4] for x in taken])
            col = np.array([x[1] for x in taken], np.int64)
            quadrants, begin = self.masks[held] + bits[depth], self.first[held]
            for half in (0, 1):
                own = quadrants + half
                child = np.where(HAS[own], begin + BEFORE[own], self.none)
                bound = self.tops[child] @ weights
                at = col + (half << (self.height - 1 - depth))
                ok = (bound > 0) & (at < n_cols)
                if len(best) == k:
                    ok &= bound >= best[0][0]
                for i in np.flatnonzero(ok).tolist():
                    if depth[i] + 1 < self.height:
                        heapq.heappush(heap, (-int(bound[i]), int(at[i]), -int(depth[i]), int(depth[i]) + 1, child[i]))
                    else:
                        found = (int(bound[i]), -int(ids[at[i]]))
                        if len(best) < k:
                            heapq.heappush(best, found)
                        elif found > best[0]:
                            heapq.heapreplace(best, found)


def frequencies(index: DataFrame, wanted) -> dict[bytes, int]:
    """The documents that hold each wanted term (a broadcast set). Reads the index's terms only."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[bytes, int] = defaultdict(int)
        for b in batches:
            for terms, dfs in zip(b.column(0), b.column(1), strict=True):
                for t, n in zip(unpacked(terms.as_py()).split(), np.frombuffer(dfs.as_py(), "<i4").tolist(), strict=True):
                    if t in wanted.value:
                        total[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    rows = index.select("terms", "dfs").mapInArrow(held, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["term"]): r["n"] for r in rows}


def searcher(block, k: int, kind: pa.DataType):
    """Each segment against a block: [(item_id, [(term, weight), ...]), ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", kind), ("doc_id", pa.int64()), ("score", pa.int64())])
        items = block.value
        wanted = {t for _, terms in items for t, _ in terms}
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                tree = Treap(row)
                number = {t: j for j, t in enumerate(unpacked(row["terms"]).split()) if t in wanted}
                for (_, terms), own in zip(items, best, strict=True):
                    here = [(number[t], w) for t, w in terms if t in number]
                    if here:
                        rows, weights = np.array(here, np.int64).T
                        tree.search(rows, weights, own, k)
        for (item, _), own in zip(items, best, strict=True):
            if own:
                ids = [None if -d == LAST_ID else -d for _, d in own]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), kind), pa.array(ids, pa.int64()), pa.array([s for s, _ in own], pa.int64())], schema=schema)

    return run


def search(index: DataFrame, n_docs: int, benchmark: DataFrame, k: int = 50, block_chars: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = index.sparkSession
    bounded_batches(spark)
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = benchmark.select("item_id", F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
    total = benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    n_blocks = int(max(1, -(-total // block_chars)))
    kind = benchmark.schema["item_id"].dataType
    found = None
    for block in range(n_blocks):
        own = texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else texts
        own = own.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).collect()
        df = frequencies(index, spark.sparkContext.broadcast({t.encode() for r in own for t in r["terms"]}))
        weighted = {t: w for t, n in df.items() if (w := weight(n_docs, n)) > 0}
        items = [(r["item_id"], [(t, weighted[t]) for t in map(str.encode, r["terms"]) if t in weighted]) for r in own]
        run = searcher(spark.sparkContext.broadcast(items), k, to_arrow_type(kind))
        part = index.mapInArrow(run, f"item_id {kind.simpleString()}, doc_id long, score long")
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 50, segment_words: int = 500_000, block_chars: int = 4_000_000) -> DataFrame:
    """Index and search at once."""
    index, n_docs = build_index(docs, segment_words)
    return search(index, n_docs, benchmark, k, block_chars)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
p AS (SELECT rid, doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS t FROM d) GROUP BY rid, doc_id, n, t),
q AS (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM i) GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q, s),
c AS (SELECT i.item_id, p.rid, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + ((50 * p.n * s.big_n) // s.big_l))))) AS BIGINT) AS score
  FROM i JOIN w USING (t) JOIN p USING (t), s GROUP BY i.item_id, p.rid, p.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
