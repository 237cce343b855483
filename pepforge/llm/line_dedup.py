"""Operator 1, line dedup: sharded cuckoo filters backed by exact reference-count tables.

State of a ``LineIndex`` (DataFrames, kept as Parquet tables in the shared folder):

* ``refs``    (k1, k2, doc_id): one row for each line key and document that holds it, the exact reference table.
* ``counts``  (k1, k2, n_docs, keeper): its aggregate, the number of documents and the largest doc_id of each key.
* ``filters`` (shard, n, buckets): one cuckoo filter a shard with the keys that at least ``min_docs`` documents hold.

A filter is approximate with false positives only, so it says cheaply which lines can't be frequent; what it lets through is
settled by ``counts``. Inserting and deleting documents adds or removes rows of ``refs`` and puts in or takes out the
fingerprints of just those keys that cross ``min_docs``, so an insert followed by a delete restores the state.

The first insert makes plain tables. The first change makes logs of them (see ``Log``) in folders by key, and a second log of ``refs``
in folders by document, whose number follows the rows. A change then scans the folders into which its own keys and documents fall and
keeps the rows of these before anything is shuffled or sorted, counts its own keys anew, writes only rows of these keys, and sets those
filters anew into which they fall. All else is neither shuffled nor written, and from some hundred keys on a folder nearly all folders
are scanned. A filter that is full grows from its own shard's exact counts; when one holds twice ``keys_per_shard``, there are more shards.

A key is two 64-bit halves of a 128-bit hash of the normalised line. Hot keys are pre-aggregated by (key, doc_id) before they
are counted, and the exact lookup salts the rows of a key.

Defined results: null or empty text is one empty line, which is never dropped (shorter than ``min_chars``). Rows with equal
doc_id are one document for counting; each is rewritten by itself. A null doc_id counts as one document, smaller than all
others. Other columns, whatever their names, pass through ``apply`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, saved, small_batches, table, unsaved

#: Slots of a bucket, and moves after which a filter is built anew with twice the buckets.
SLOTS, MOVES = 4, 500
#: Keys that a task holds at once to probe a filter, about.
GROUP_ROWS = 500_000
#: Keys of a change up to which they are broadcast; beyond, Spark joins them as any other table.
SMALL_CHANGE = 100_000


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Both halves of the key of a line that is already lower-cased (A-Z), or None for a short one."""
    line = line.strip()
    if len(line) < min_chars or (not line.isascii() and len(line.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(k1, k2, doc_id): the distinct keys of each row's lines."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (t := text.as_py()) is None:
                    continue
                found = {line_key(x, min_chars) for x in t.encode("utf-8", "surrogatepass").lower().split(b"\n")}
                found.discard(None)
                for a, c in found:
                    k1.append(a)
                    k2.append(c)
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(keys, "k1 long, k2 long, doc_id long")


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints (0: free) in buckets of four, for keys given as two 64-bit halves."""

    def __init__(self, buckets: np.ndarray):
        self.table = buckets.astype(np.uint16).reshape(-1, SLOTS)

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
        n = 16
        while n * SLOTS * 0.85 < len(k1):
            n *= 2
        while True:
            f = cls(np.zeros(n * SLOTS))
            if f.insert(k1, k2):
                return f
            n *= 2

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets; each bucket follows from the other and the fingerprint."""
        top = np.uint64(len(self.table) - 1)
        mark = (k2.astype(np.int64).view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        one = k1.astype(np.int64).view(np.uint64) & top
        return mark.astype(np.uint16), one.astype(np.int64), (one ^ (self.spread(mark) & top)).astype(np.int64)

    @staticmethod
    def spread(mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(k1, k2)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key finds no place; the filter must then be built anew."""
        rng, top = np.random.default_rng(1), len(self.table) - 1
        for mark, a, b in zip(*self.places(k1, k2), strict=True):
            at = int(a)
            for at in (int(a), int(b)):
                if (free := np.flatnonzero(self.table[at] == 0)).size:
                    self.table[at, free[0]] = mark
                    break
            else:
                for _ in range(MOVES):
                    slot = rng.integers(SLOTS)
                    mark, self.table[at, slot] = self.table[at, slot], mark
                    at = int(at ^ (int(self.spread(np.array([mark]))[0]) & top))
                    if (free := np.flatnonzero(self.table[at] == 0)).size:
                        self.table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that were put in."""
        for mark, a, b in zip(*self.places(k1, k2), strict=True):
            for at in (int(a), int(b)):
                if (held := np.flatnonzero(self.table[at] == mark)).size:
                    self.table[at, held[0]] = 0
                    break


FILTERS = "shard long, n long, buckets binary"


def shard_of(n_shards: int) -> F.Column:
    return F.pmod(F.col("k1"), F.lit(n_shards)).cast("long")


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.of(own.k1.to_numpy(), own.k2.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "n": [len(own)], "buckets": [f.table.tobytes()]})

    return keys.select(shard_of(n_shards).alias("shard"), "k1", "k2").groupBy("shard").applyInPandas(build, FILTERS)


def change_filters(filters: DataFrame, changed: DataFrame, n_shards: int) -> DataFrame:
    """The filters of the shards of changed (k1, k2, frequent), frequent telling whether the key enters or leaves. One that is full
    has null buckets."""

    def change(key: tuple, old: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return old[["shard", "n", "buckets"]].iloc[:0]
        come, go = own[own.frequent], own[~own.frequent]
        n = (int(old.n[0]) if len(old) else 0) + len(come) - len(go)
        f = Cuckoo(np.frombuffer(old.buckets[0], np.uint16).copy()) if len(old) else Cuckoo.of(come.k1.to_numpy(), come.k2.to_numpy())
        if len(old):
            f.delete(go.k1.to_numpy(), go.k2.to_numpy())
            if not f.insert(come.k1.to_numpy(), come.k2.to_numpy()):
                return pd.DataFrame({"shard": [key[0]], "n": [n], "buckets": [None]})
        return pd.DataFrame({"shard": [key[0]], "n": [n], "buckets": [f.table.tobytes()]})

    own = changed.select(shard_of(n_shards).alias("shard"), "k1", "k2", "frequent")
    return filters.groupBy("shard").cogroup(own.groupBy("shard")).applyInPandas(change, FILTERS)


class Log:
    """Rows by key in folders, of which the latest version counts.

    A change adds a table with the rows that it sets (alive) or takes out. Tables at the end are merged while one has more than half
    the rows of the one before, so there are about log2(rows) tables, and a row is rewritten as often at most. A table of less than
    small rows is one of few files, as its folders would be many tiny ones; within a file rows are in the order of the keys.
    """

    def __init__(self, name: str, keys: list[str], folder: F.Column, n_folders: int, small: int):
        self.name, self.keys, self.folder, self.n_folders, self.small = name, keys, folder, n_folders, small
        self.tables: list[tuple[DataFrame, int]] = []

    def folder_of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("folder", F.pmod(self.folder, F.lit(self.n_folders)).cast("int"))

    def folders(self, rows: DataFrame) -> list[int]:
        """Those that the rows fall into: n_folders at most."""
        if self.n_folders == 1:
            return [0]
        return [r.folder for r in self.folder_of(rows).select("folder").distinct().collect()]

    def write(self, rows: DataFrame, n: int) -> DataFrame:
        if n < self.small:
            return saved(rows.repartition(max(1, n // 100_000)).sortWithinPartitions(*self.keys), self.name)
        spread = F.pmod(F.xxhash64(*self.keys), F.lit(8))  # a key that many rows have isn't one task's
        return saved(rows.repartition("folder", spread).sortWithinPartitions("folder", *self.keys), self.name, by=["folder"])

    def put(self, rows: DataFrame, version: int, n: int) -> None:
        """rows: the keys, alive and further columns; n: how many."""
        self.tables.append((self.write(self.folder_of(rows).withColumn("version", F.lit(version)), n), n))
        while len(self.tables) > 1 and 2 * self.tables[-1][1] > self.tables[-2][1]:
            (a, na), (b, nb) = self.tables[-2:]
            merged = self.latest([a, b])
            both = self.write(merged if len(self.tables) > 2 else merged.filter("alive"), na + nb)
            self.tables[-2:] = [(both, both.count())]
            unsaved(a, b)

    def latest(self, tables: list[DataFrame]) -> DataFrame:
        if len(tables) == 1:
            return tables[0]
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        rest = [c for c in rows.columns if c not in self.keys]
        newest = F.max_by(F.struct(*rest), "version").alias("v")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, *[F.col(f"v.{c}").alias(c) for c in rest])

    def rows(self, of: DataFrame | None = None) -> DataFrame:
        """The rows that are alive. of: a kept table of distinct rows of the columns that make up the folder, and of further keys;
        only their rows then, chosen in each table before versions are compared. It is broadcast if it is small."""
        tables = [t for t, _ in self.tables]
        if of is not None:
            folders, wanted = self.folders(of), None
            some = F.broadcast(of) if of.limit(SMALL_CHANGE + 1).count() <= SMALL_CHANGE else of
            for c in of.columns:
                same = F.col(f"t.{c}").eqNullSafe(F.col(f"of.{c}"))
                wanted = same if wanted is None else wanted & same
            tables = [t.filter(F.col("folder").isin(folders)).alias("t").join(some.alias("of"), wanted, "left_semi") for t in tables]
        return self.latest(tables).filter("alive").drop("folder", "version", "alive")


def same_ref(a: str, b: str) -> F.Column:
    return F.expr(f"{a}.k1 = {b}.k1 AND {a}.k2 = {b}.k2 AND {a}.doc_id <=> {b}.doc_id")


class LineIndex:
    """Reference counts and filters of the lines of a changing set of documents.

    min_chars: shorter keys are never dropped. min_docs: documents from which a key is frequent. keys_per_shard: bounds a filter;
    salts: parts into which the rows of a key are dealt for the exact lookup, and the rows of a shard at least for its filter;
    folder_rows: rows of a log's folder, about, of which there are max_folders at most; the number is fixed by the first change,
    or by folders, which divides small tables, too. A change deletes the tables that it replaces, so write what apply gave before the next.
    """

    def __init__(self, min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 200_000, salts: int = 16, folder_rows: int = 1_000_000, max_folders: int = 4096, folders: int | None = None):
        self.min_chars, self.min_docs, self.keys_per_shard, self.salts = min_chars, min_docs, keys_per_shard, salts
        self.folder_rows, self.max_folders, self.n_folders = folder_rows, max_folders, folders
        self.filters: DataFrame | None = None
        self.n_shards = self.version = 0
        self._plain: tuple[DataFrame, DataFrame] | None = None
        self._logs: tuple[Log, Log, Log] | None = None

    @property
    def refs(self) -> DataFrame | None:
        return self._logs[0].rows() if self._logs else self._plain and self._plain[0]

    @property
    def counts(self) -> DataFrame | None:
        return self._logs[2].rows() if self._logs else self._plain and self._plain[1]

    def _new_refs(self, docs: DataFrame) -> DataFrame:
        return keyed_lines(docs, self.min_chars).distinct()

    def _count(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))

    def _frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n_docs") >= self.min_docs)

    def rebuild(self) -> LineIndex:
        """Filters from the exact tables; their number follows the number of frequent keys."""
        self.n_shards = max(1, -(-self._frequent().count() // self.keys_per_shard))
        self.filters = saved(build_filters(self._frequent(), self.n_shards), "line-filters")
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        new = self._new_refs(docs)
        if self._plain is None and self._logs is None:
            refs = saved(new, "line-refs")
            self._plain = refs, saved(self._count(refs), "line-counts")
            return self.rebuild()
        _, by_doc, _ = self._changing()
        new = saved(new, "line-new")
        ids = saved(new.select("doc_id").distinct(), "line-ids")
        held = by_doc.rows(ids)
        self._change(saved(new.alias("n").join(held.alias("h"), same_ref("n", "h"), "left_anti"), "line-change"), True)
        unsaved(new, ids)
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a DataFrame with the doc_id of documents to take out."""
        _, by_doc, _ = self._changing()
        gone = saved(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "line-gone")
        self._change(saved(by_doc.rows(gone), "line-change"), False)
        unsaved(gone)
        return self

    def _changing(self) -> tuple[Log, Log, Log]:
        """refs by key, refs by document, counts by key."""
        if self._logs is None:
            ref, key = ["k1", "k2", "doc_id"], ["k1", "k2"]
            made = [("line-refs", ref, F.col("k1")), ("line-docs", ref, F.xxhash64("doc_id")), ("line-counts", key, F.col("k1"))]
            refs, counts = self._plain
            sizes = [refs.count()] * 2 + [counts.count()]
            numbers = [self.n_folders or min(self.max_folders, max(1, n // self.folder_rows)) for n in sizes]
            self._logs = tuple(Log(*own, number, 0 if self.n_folders else self.folder_rows) for own, number in zip(made, numbers, strict=True))
            for log, rows, n in zip(self._logs, (refs, refs, counts), sizes, strict=True):
                log.put(rows.withColumn("alive", F.lit(True)), 0, n)
            self._plain = None
            unsaved(refs, counts)
        return self._logs

    def _change(self, rows: DataFrame, come: bool) -> LineIndex:
        """rows (k1, k2, doc_id) come into the exact tables or go."""
        by_key, by_doc, counts = self._logs
        n = rows.count()
        if not n:
            unsaved(rows)
            return self
        self.version += 1
        for log in (by_key, by_doc):
            log.put(rows.withColumn("alive", F.lit(come)), self.version, n)
        keys = saved(rows.select("k1", "k2").distinct(), "line-keys")
        now = self._count(by_key.rows(keys))
        was = counts.rows(keys).select("k1", "k2", F.col("n_docs").alias("was"))
        both = saved(keys.join(now, ["k1", "k2"], "left").join(was, ["k1", "k2"], "left").na.fill(0, ["n_docs", "was"]), "line-diff")
        counts.put(both.select("k1", "k2", "n_docs", "keeper", (F.col("n_docs") > 0).alias("alive")), self.version, both.count())
        frequent = F.col("n_docs") >= self.min_docs
        crossed = both.filter(frequent != (F.col("was") >= self.min_docs)).select("k1", "k2", frequent.alias("frequent"))
        touched = crossed.select(shard_of(self.n_shards).alias("shard")).distinct()
        old = self.filters
        set_anew = saved(change_filters(old.join(touched, "shard", "left_semi"), crossed, self.n_shards), "line-filters")
        full = set_anew.filter("buckets IS NULL").select("shard")
        grown = build_filters(self._frequent().join(full, shard_of(self.n_shards) == F.col("shard"), "left_semi"), self.n_shards)
        self.filters = saved(old.join(touched, "shard", "left_anti").unionByName(set_anew.filter("buckets IS NOT NULL")).unionByName(grown), "line-filters")
        unsaved(old, set_anew, keys, both, rows)
        most = self.filters.agg(F.max("n")).first()[0] or 0
        return self.rebuild() if most > 2 * self.keys_per_shard else self

    def dealt(self, keys: DataFrame) -> tuple[DataFrame, int]:
        """keys with shard and salt, and the number of salts: so many that no group has many more than GROUP_ROWS rows, whatever the
        shards, keys and documents hold."""
        own = keys.withColumn("shard", shard_of(self.n_shards))
        most = own.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        salts = max(self.salts, -(-most // GROUP_ROWS))
        return own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)).cast("int")), salts

    def maybe_frequent(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (k1, k2, doc_id) that the filters let through. Rows of a shard are dealt by document and key too, so that
        neither a shard nor a key nor a document is one task's."""
        dealt, salts = self.dealt(keys)
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def probe(_: tuple, own: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
            if not len(f) or not len(own):
                return own.iloc[:0][["k1", "k2", "doc_id"]]
            return own.loc[Cuckoo(np.frombuffer(f.buckets[0], np.uint16)).holds(own.k1.to_numpy(), own.k2.to_numpy()), ["k1", "k2", "doc_id"]]

        return dealt.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInPandas(probe, "k1 long, k2 long, doc_id long")

    def drops(self, refs: DataFrame) -> DataFrame:
        """(doc_id, keys): for each document of refs the frequent keys whose lines it loses."""
        maybe = self.maybe_frequent(refs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(self.salts)).cast("int"))
        exact = self._frequent().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        lost = maybe.join(exact, ["k1", "k2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """docs with the lines dropped from text, and n_lines, n_dropped. docs must have been inserted. refs: their rows of refs, if
        these are at hand; else their lines are read, so that the work follows docs and not all that is in the index."""
        doc, keys, new = fresh(docs, "__doc", "__keys", "__new")
        lost = self.drops(self._new_refs(docs) if refs is None else refs).withColumnsRenamed({"doc_id": doc, "keys": keys})
        joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
        done = joined.withColumn(new, rewritten(self.min_chars)(F.col("text").cast("string"), F.col(keys)))
        made = ("text", "n_lines", "n_dropped")
        return done.select(*[quoted(c) for c in docs.columns if c.lower() not in made], *[F.col(f"{new}.{c}").alias(c) for c in made])


def rewritten(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rewrite(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for t, lost in zip(text, keys, strict=True):
            t = t or ""
            if lost is None or not len(lost):
                out.append((t, t.count("\n") + 1, 0))
                continue
            gone = {(x["k1"], x["k2"]) for x in lost}
            lines = t.split("\n")
            kept = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass").lower(), min_chars) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return rewrite


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the lines that min_docs documents hold, but for the largest doc_id of each; with n_lines, n_dropped."""
    index = LineIndex(min_chars, min_docs).insert(docs)
    return index.apply(docs, index.refs)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.doc_id, k.i, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
