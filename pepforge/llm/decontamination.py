"""Operator 7, benchmark decontamination: a distributed positional inverted index of the training text.

``build_index`` makes index segments (like those of a search engine, each over whole documents of about ``segment_words`` words):
for every word of the segment the sorted list of its positions, with the position at which each document begins. All words of all
documents are kept, in a Parquet table in the shared folder; a segment is one row of bounded size, but for a single document that
is longer. ``search`` takes the benchmark in blocks of bounded size, one after the other; a block is broadcast, so a worker process has
it once, not beside every segment. In a segment, each distinct window of the block starts from its rarest word there: the list of that
word's positions, less its offset in the window, is intersected with those of the next rarest words, less theirs, until none is left or
all words agree (exact phrase). Windows that begin with the same two rarest words at the same distance share that first intersection.
Proximity matches ask that all words of a window lie within ``slop`` words of its rarest one, in any order, in the same document. No row
is shuffled to find matches.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window: ``width`` consecutive words of an item; an item
of fewer words, but not none, is one window.

Defined results: null or empty text has no words and no hits; rows with equal or null doc_id each get a row of their own;
a null item_id counts as the item ''. Rows of benchmark with one item_id are one item. Extra columns are ignored by ``search``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, small_batches, table

#: Byte by byte: A-Z to a-z, and what no word holds to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SEGMENT = "terms binary, ends binary, places binary, doc_ids array<long>, doc_ends array<int>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def segment(docs: list[tuple[int | None, list[bytes]]]) -> dict:
    """One row of the index. ends: for each word the end of its list in places; places: those lists, as differences."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    stream = np.array([i for _, words in docs for i in map(ids.__getitem__, words)], np.int32)
    order = np.argsort(stream, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(stream, minlength=len(ids))).astype(np.int32)
    steps = np.diff(order, prepend=np.int32(0))
    steps[ends[:-1]] = order[ends[:-1]]
    return {"terms": b" ".join(ids), "ends": ends.tobytes(), "places": steps.tobytes(), "doc_ids": [d for d, _ in docs], "doc_ends": np.cumsum([len(w) for _, w in docs]).tolist()}


def build_index(docs: DataFrame, segment_words: int = 250_000) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("terms", pa.binary()), ("ends", pa.binary()), ("places", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32()))])
        own, n = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own.append((doc, words_of(text.as_py())))
                n += len(own[-1][1])
                if n >= segment_words or len(own) >= segment_words:
                    yield pa.RecordBatch.from_pylist([segment(own)], schema)
                    own, n = [], 0
        if own:
            yield pa.RecordBatch.from_pylist([segment(own)], schema)

    small_batches(docs.sparkSession)
    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SEGMENT), "word-index")


class Segment:
    def __init__(self, row: dict):
        self.term_id = {w: i for i, w in enumerate(row["terms"].split())}
        self.ends = np.frombuffer(row["ends"], np.int32)
        self.steps = np.frombuffer(row["places"], np.int32)
        self.doc_ends = np.array(row["doc_ends"], np.int64)
        self.doc_starts = np.concatenate([[0], self.doc_ends[:-1]]) if len(self.doc_ends) else self.doc_ends
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.counts = self.ends - self.starts
        # the lists are differences, each from 0 on
        sums = np.cumsum(self.steps, dtype=np.int64)
        self.all_places = sums - np.repeat(np.concatenate([[0], sums])[self.starts], self.counts)

    def places(self, term: int) -> np.ndarray:
        return self.all_places[self.starts[term] : self.ends[term]]

    def count(self, terms: np.ndarray) -> np.ndarray:
        return self.counts[terms]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, places, side="right")

    @cached_property
    def postings(self) -> np.ndarray:
        """All lists one after the other as one sorted list of (word, position)."""
        return np.repeat(np.arange(len(self.counts)), self.counts) * len(self.all_places) + self.all_places

    def on_list(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each position, none of them outside the segment, is on the list of the word beside it."""
        wanted = terms * len(self.all_places) + places
        at = np.searchsorted(self.postings, wanted)
        return self.postings[np.minimum(at, len(self.postings) - 1)] == wanted


def unrolled(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): for each i, its places from begins[i] on."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + (begins - np.cumsum(sizes) + sizes)[owner]


def portions(sizes: np.ndarray, at_once: int) -> list[np.ndarray]:
    """The numbers of sizes in stretches whose sums are at_once, about, or a single larger one."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1) if len(sizes) else []


class Windows:
    """The test windows of a block of items, each distinct one once, as rows of word numbers (-1 beyond its end)."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width, self.terms = width, {}
        self.names = [i for i, _ in items]
        rows, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in words_of(text)], np.int32)
            if len(ids):
                short = max(0, width - len(ids))
                rows.append(np.lib.stride_tricks.sliding_window_view(np.pad(ids, (0, short), constant_values=-1), width))
                owner.append(np.full(len(rows[-1]), k))
        self.rows, window = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.sizes = (self.rows >= 0).sum(axis=1)
        #: the items of window w are those from item_ends[w - 1] to item_ends[w] of item_of
        window, self.item_of = np.divmod(np.unique(window.ravel() * max(1, len(items)) + np.concatenate(owner)), max(1, len(items)))
        self.item_counts = np.bincount(window, minlength=len(self.rows))
        self.item_ends = np.cumsum(self.item_counts)

    def items(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, item) for each item of windows[i]."""
        sizes = self.item_counts[windows]
        i, at = unrolled(self.item_ends[windows] - sizes, sizes)
        return i, self.item_of[at]

    def here(self, s: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Those windows all of whose words the segment has, and their words as its numbers."""
        to = np.array([s.term_id.get(w, -2) for w in self.terms] + [-1], np.int64)
        has = np.flatnonzero((to[self.rows] != -2).all(axis=1))
        return has, to[self.rows[has]]

    def phrases(self, s: Segment, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, document, first place, words) of all occurrences, by intersecting lists from each window's rarest words on."""
        has, rows = self.here(s)
        if not len(has):
            return
        total, size = len(s.all_places), self.sizes[has]
        order = np.argsort(np.where(rows >= 0, s.counts[rows], total + 1), axis=1, kind="stable")
        terms = np.take_along_axis(rows, order, axis=1)
        # windows with the same two rarest words, equally far apart, share the intersection of these two lists
        one, two = terms[:, 0], terms[:, 1] if self.width > 1 else np.full(len(terms), -1)
        far = np.where(two >= 0, order[:, min(1, self.width - 1)] - order[:, 0], 0)
        _, lead, pair = np.unique((one * (len(s.counts) + 1) + two + 1) * 2 * self.width + far + self.width, return_index=True, return_inverse=True)
        by_pair = np.argsort(pair, kind="stable")
        n_windows = np.bincount(pair)
        pair_begins = np.cumsum(n_windows) - n_windows
        for part in portions(s.counts[one[lead]], at_once):
            w = lead[part]
            i, at = unrolled(s.starts[one[w]], s.counts[one[w]])
            place = s.all_places[at]
            beside = place + far[w][i]
            alive = np.flatnonzero((beside >= 0) & (beside < total))
            alive = alive[(two[w][i[alive]] < 0) | s.on_list(two[w][i[alive]], beside[alive])]
            i, place = i[alive], place[alive]
            for stretch in portions(n_windows[part[i]], at_once):
                j, at = unrolled(pair_begins[part[i[stretch]]], n_windows[part[i[stretch]]])
                w2 = by_pair[at]
                first = place[stretch][j] - order[w2, 0]
                inside = (first >= 0) & (first + size[w2] <= total)
                w2, first = w2[inside], first[inside]
                for d in range(2, self.width):
                    if not len(w2):
                        break
                    ok = terms[w2, d] < 0
                    more = np.flatnonzero(~ok)
                    ok[more] = s.on_list(terms[w2[more], d], first[more] + order[w2[more], d])
                    w2, first = w2[ok], first[ok]
                doc = s.doc_of(first)
                whole = first + size[w2] <= s.doc_ends[doc]
                yield has[w2[whole]], doc[whole], first[whole], size[w2[whole]]

    def near(self, s: Segment, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The same of the places of each window's rarest word near which all its words are."""
        lists: dict[int, np.ndarray] = {}
        for w, row in zip(*self.here(s), strict=True):
            first = near_places(s, row[row >= 0], slop, lists)
            yield np.full(len(first), w), s.doc_of(first), first, np.ones(len(first), np.int64)


def near_places(s: Segment, window: np.ndarray, slop: int, lists: dict[int, np.ndarray]) -> np.ndarray:
    """The places of the window's rarest word near which all its other words lie."""
    terms = np.unique(window)
    terms = terms[np.argsort(s.count(terms), kind="stable")]
    near = None
    for t in map(int, terms):
        own = lists.get(t)
        if own is None:
            own = lists[t] = s.places(t)
        if near is None:
            near = own
            continue
        doc = s.doc_of(near)
        low, high = np.maximum(near - slop, s.doc_starts[doc]), np.minimum(near + slop, s.doc_ends[doc] - 1)
        near = near[np.searchsorted(own, low) < np.searchsorted(own, high, side="right")]
        if not len(near):
            break
    return near


FOUND = "doc_id long, n_words long, hits array<struct<first:int,last:int>>, items array<string>, segment long, ordinal int"


def search(index: DataFrame, benchmark: DataFrame, width: int = 13, slop: int | None = None, block_chars: int = 4_000_000) -> DataFrame:
    """For every document of the index: doc_id, n_words, n_hit (words inside matches) and the sorted items that match.

    slop: None for exact phrases, else proximity matches (the hit words are then those of the rarest word). block_chars bounds
    the benchmark text that a task holds (but for a single longer item); a larger benchmark takes more passes over the index.
    """
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = int(max(1, -(-total // block_chars)))
    spark = index.sparkSession
    numbered = index.withColumn("segment", F.monotonically_increasing_id())
    found = None
    for block in range(n_blocks):
        own = texts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        block_texts = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # about block_chars letters
        part = numbered.mapInArrow(searcher(block_texts, width, slop), FOUND)
        part = saved(part, "block-hits") if n_blocks > 1 else part
        found = part if found is None else found.unionAll(part)
    if n_blocks > 1:
        found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        n_hit = covered("hits")
    else:
        n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"] + 1).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"))


def searcher(block_texts: Broadcast, width: int, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string())), ("segment", pa.int64()), ("ordinal", pa.int32())])
        block = Windows(block_texts.value, width)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                s = Segment(row)
                change, items = np.zeros(len(s.steps) + 1, np.int64), defaultdict(set)
                for window, doc, first, n in block.phrases(s) if slop is None else block.near(s, slop):
                    change += np.bincount(first, minlength=len(change))
                    change -= np.bincount(first + n, minlength=len(change))
                    doc, window = np.divmod(np.unique(doc * len(block.rows) + window), len(block.rows))
                    at, item = block.items(window)
                    for d, k in zip(doc[at].tolist(), item.tolist(), strict=True):
                        items[d].add(block.names[k])
                hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                hit_doc = s.doc_of(hit)
                new = np.flatnonzero(np.diff(hit, prepend=-2) > 1) if len(hit) else np.zeros(0, int)
                new = np.union1d(new, np.flatnonzero(np.diff(hit_doc, prepend=-1) > 0)).astype(int)
                runs = defaultdict(list)
                for a, z in zip(new, np.append(new[1:], len(hit))[: len(new)], strict=True):
                    d = int(hit_doc[a])
                    runs[d].append({"first": int(hit[a] - s.doc_starts[d]), "last": int(hit[z - 1] - s.doc_starts[d])})
                sizes = (s.doc_ends - s.doc_starts).tolist()
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "n_words": sizes[j], "hits": runs.get(j, []), "items": sorted(items.get(j, ())), "segment": row["segment"], "ordinal": j} for j, d in enumerate(row["doc_ids"])], schema)

    return run


def covered(hits: str):
    """Positions in a union of ranges."""

    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        def one(ranges) -> int:
            n, end = 0, -1
            for a, z in sorted((r["first"], r["last"]) for r in ranges):
                n += max(0, z - max(a, end + 1) + 1)
                end = max(end, z)
            return n

        return column.map(one).astype("int64")

    return count(hits)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", one_in: int = 20) -> F.Column:
    """The contamination rule: some hit, and hits make up a one_in-th of the words or more."""
    return (F.col(n_hit) > 0) & (one_in * F.col(n_hit) >= F.col(n_words))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, **limits) -> DataFrame:
    return search(build_index(docs), benchmark, width, **limits).withColumn("contaminated", contaminated())


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The rows of docs but those whose doc_id has a contaminated text."""
    (name,) = fresh(docs, "__bad")
    bad = contamination(docs, benchmark, width).filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS s FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM w, lens WHERE len(ws) >= n)),
m AS (SELECT p.doc_id, p.s, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.phrase = g.phrase),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
