"""Operator 5, MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes the set of its word shingles (64-bit hashes), with the set's size, a 128-bit key and a MinHash signature.
   Rows with one key have equal sets; only one representative of each class goes on, so copies are never expanded into pairs.
2. The signature is banded; classes that share a band are candidates. In each bucket only pairs with its smallest member are made
   (a star: as many pairs as members).
3. A pair's signatures are compared batch by batch. After each batch the posterior of the similarity (Beta, uniform prior) tells
   whether it can still reach the threshold; if that probability is under ``miss``, the pair is pruned.
4. Survivors are verified exactly on their full sets, and verified links merged into components.
5. What the stars don't reach: in each bucket with more than one component left, the members of different components are compared
   by step 3, in blocks of bounded size that are dealt over the tasks, and survivors are verified on their full sets, part by
   part rather than pair by pair. Pairs inside a component need no test, as they can't change it. So no link between different
   components is lost but by the chances of steps 2 and 3, and no bucket has a cap.

With 28 bands of 4 rows a pair at similarity 0.8 shares no band with a chance of 4e-7.

Words: A-Z lower-cased, then ``[^\\x20\\x09-\\x0D]+``. A text with fewer words than a shingle, but not none, is one shingle of all
its words; without words the set is empty and linked with nothing.

Defined results: rows with null doc_id are linked with nothing, have a null component and are kept; rows with one doc_id are one
document (if their texts differ, it has several sets, and a link of any counts, so all it is linked with is one component), each with
its own n_shingles. ``near_dedup`` keeps or drops them together. Equal texts are named by the smallest doc_id that holds them; a
document stays if it names a group of texts that links put together. So where each doc_id has one text, one document of each
component stays; where some have several, no group of linked texts goes as a whole. Other columns pass through ``near_dedup``
unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved, small_batches, table, unsaved

BANDS, ROWS = 28, 4
N_HASHES = BANDS * ROWS
BATCH = 16
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MEMO = 1_000_000
#: Hash slots that tell which texts may be wanted; bounds what is broadcast.
SLOTS = 1 << 19
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * MIX1
        x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


class Shingler:
    def __init__(self, width: int):
        self.width = width
        rng = np.random.default_rng(20)
        self.by_place = (rng.integers(0, 1 << 63, width, np.uint64) << np.uint64(1)) | np.uint64(1)
        class Memo(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.words = Memo()

    def of_text(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        w = np.array(list(map(self.words.__getitem__, words)), np.uint64)
        if not len(w):
            return w
        k = min(self.width, len(w))
        with np.errstate(over="ignore"):
            s = np.full(len(w) - k + 1, k, np.uint64)
            for j in range(k):
                s += scrambled(w[j : len(w) - k + 1 + j] + np.uint64(j)) * self.by_place[j]
        return np.unique(scrambled(s))


class MinHash:
    def __init__(self):
        rng = np.random.default_rng(10)
        self.a = (rng.integers(0, 1 << 31, (N_HASHES, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (N_HASHES, 1), np.uint32)

    def of_set(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(N_HASHES, np.iinfo(np.uint32).max, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(x), 4096):
                np.minimum(out, (self.a * x[None, i : i + 4096] + self.b).min(axis=1), out=out)
        return out


def prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's key) and signature of each row; key and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(width), MinHash()
        for b in batches:
            n, found, sig = [], [], []
            for text in b.column(1):
                s = shingler.of_text(text.as_py())
                n.append(len(s))
                (a,), (c,) = set_keys([s.tobytes()])
                found.append((a, c))
                sig.append(minhash.of_set(s).tobytes() if len(s) else None)
            k1, k2 = [a for a, _ in found], [c for _, c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "signature"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, signature binary")


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each number of batches: the fewest equal hashes with which P(similarity >= threshold) is at least miss.

    With m of n equal and a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail beyond t is the chance of at most m
    successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss or m == n:
                break
            m += 1
        out.append(m)
    return np.array(out)


def plausible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows) survive all batches; later batches are only compared for those left."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), int)
    for k, m in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (a[alive, cut] == b[alive, cut]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), N_HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The hash of each band of each signature."""
    sig = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        h = scrambled(h ^ sig[:, :, r].astype(np.uint64) + np.uint64(r + 1))
    return h.view(np.int64)


def band_rows(classes: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column("node").to_numpy()
            keys = band_keys(signatures(b.column("signature").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes, BANDS))], ["bucket", "node"])

    return classes.select("node", "signature").mapInArrow(run, "bucket long, node long")


def pruned(pairs: DataFrame, classes: DataFrame, least: np.ndarray) -> DataFrame:
    """The pairs (u, v) that survive the sequential comparison of their signatures."""
    a = classes.select(F.col("node").alias("u"), F.col("signature").alias("a"))
    b = classes.select(F.col("node").alias("v"), F.col("signature").alias("b"))

    @F.pandas_udf("boolean")
    def survives(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(plausible(signatures(x), signatures(y), least))

    return pairs.join(b, "v").join(a, "u").filter(survives("a", "b")).select("u", "v").distinct()


def set_keys(found: list[bytes]) -> tuple[list[int | None], list[int | None]]:
    """Both halves of the key of each set of shingles, given as bytes; null for the empty set."""
    hashes = [xxhash.xxh3_128_intdigest(s) if s else None for s in found]
    return [None if h is None else (h >> 64) - (1 << 63) for h in hashes], [None if h is None else (h & (1 << 64) - 1) - (1 << 63) for h in hashes]


def set_rows(docs: DataFrame, nodes: DataFrame, width: int, classes: DataFrame | None = None) -> DataFrame:
    """(node, shingles): the full sets of the nodes' texts. classes (node, k1, k2): where doc_ids have several texts, only the sets of
    the classes that are named by the node.

    Few texts are wanted, and they are the bulk of the data. So before the join most others go by a broadcast of the hash slots that
    wanted ids fall into: SLOTS at most, whatever the number of ids. Where most slots are full it filters little, and the join does.
    """
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS)).alias("slot")
    own = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    own = own.join(F.broadcast(nodes.select(slot).distinct()), F.pmod(F.xxhash64("node"), F.lit(SLOTS)) == F.col("slot"), "left_semi").join(nodes, "node", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            found = [shingler.of_text(t.as_py()).tobytes() for t in b.column(1)]
            k1, k2 = set_keys(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["node", "shingles", "k1", "k2"])

    full = own.mapInArrow(sets, "node long, shingles binary, k1 long, k2 long").filter(F.length("shingles") > 0)
    if classes is not None:
        full = full.join(classes.select("node", "k1", "k2"), ["node", "k1", "k2"], "left_semi")
    return full.select("node", "shingles").distinct()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, classes: DataFrame | None = None) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""
    full = saved(set_rows(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), width, classes), "near-sets")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: bytes, q: bytes) -> bool:
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    a = full.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = full.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    links = saved(pairs.join(b, "v").join(a, "u").filter(linked("a", "b")).select("u", "v").distinct(), "near-verified")
    unsaved(full)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes: smallest labels spread over links and are then followed, until none changes."""
    both = saved(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "near-links")
    label = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "near-labels")
    while True:
        around = both.join(label.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        lower = label.join(around, label.node == around.u).select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        on = label.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = saved(lower.join(on, lower.component == on["at"], "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "near-labels")
        label, changed = new.select("node", "component"), new.filter("component < was").limit(1).count()
        if not changed:
            return label


def open_candidates(buckets: DataFrame, label: DataFrame, classes: DataFrame, least: np.ndarray, block: int) -> DataFrame:
    """(u, part, vs): for a node u the nodes vs of other components that share a bucket with it and survive the comparison of
    signatures, by part (about block nodes each, see ``parts``). u is of the smaller component; a pair is given once. Rows with a
    null u list all nodes that a task has put into any vs.

    A bucket's members are dealt into blocks of about block members; each task compares two blocks. Pairs with the bucket's
    smallest member have been tested already. A pair that shares several bands is compared in the first of those only.
    """
    held = parts(buckets.select("node").distinct(), label, block)
    held = buckets.join(held, "node")
    size = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("node").alias("star"))
    size = size.filter((F.col("n") > 2) & (F.col("c1") < F.col("c2"))).select("bucket", "star", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = held.join(size, "bucket").filter("node <> star").join(classes.select("node", "signature"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "component", "size", "part", "signature")

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        bucket, across = own.bucket.iloc[0], own.i.iloc[0] != own.j.iloc[0]
        own = own.sort_values(["size", "component", "node"])
        node, comp, part, mine = (own[c].to_numpy() for c in ("node", "component", "part", "mine"))
        sig = signatures(own.signature)
        bands = band_keys(sig)
        out = []
        for k in range(len(own) - 1):
            other = comp[k + 1 :] != comp[k]
            if across:
                other &= mine[k + 1 :] != mine[k]
            rest = np.flatnonzero(other) + k + 1
            shared = bands[rest] == bands[k]
            rest = rest[bands[k][shared.argmax(axis=1)] == bucket]
            hits = rest[plausible(np.broadcast_to(sig[k], (len(rest), N_HASHES)), sig[rest], least)]
            out += [(node[k], p, node[hits[part[hits] == p]]) for p in np.unique(part[hits])]
        if out:
            out.append((None, 0, np.unique(np.concatenate([vs for _, _, vs in out]))))
        return pd.DataFrame({"u": pd.array([x[0] for x in out], dtype="Int64"), "part": np.array([x[1] for x in out], np.int64), "vs": pd.Series([x[2] for x in out], dtype=object)})

    # few rows, but much to compute: Spark mustn't join small partitions into few tasks
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(compare, "u long, part long, vs array<long>")


def parts(nodes: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """(node, component, size of the component, part): nodes dealt into parts of about block, those of a large component by
    themselves."""
    held = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = held.join(held.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    n = max(1, -(-nodes.count() // block))
    large = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block).cast("long")))
    return held.withColumn("part", F.when(F.col("size") >= block, large).otherwise(F.pmod(F.xxhash64("component"), F.lit(n))))


def verified_in_parts(candidates: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int, block: int, classes: DataFrame | None = None) -> DataFrame:
    """The links (u, v) among candidates (u, part, vs) on full sets. members: node, part.

    The sets of a part's nodes meet the sets of the nodes u that have candidates there: a set goes to as many tasks as it has
    parts with candidates, however many pairs these are. Where a part has many such nodes, they are dealt over several tasks.
    """
    wanted = candidates.filter("u IS NULL").select(F.explode("vs").alias("node")).unionAll(candidates.filter("u IS NOT NULL").select("u")).distinct()
    candidates = candidates.filter("u IS NOT NULL")
    full = saved(set_rows(docs, wanted, width, classes), "near-sets")
    asked = candidates.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("salts"))
    left = candidates.join(asked, "part").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int"))
    left = left.join(full.withColumnRenamed("node", "u"), "u").select("part", "salt", "u", "vs", "shingles")
    right = members.join(full, "node").join(asked, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*[F.col(c).alias(c) for c in ("part", "salt", "node", "shingles")])  # new columns, as both sides stem from full

    def check(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(held):
            sets = [np.frombuffer(x, np.uint64) for x in held.shingles]
            sizes = np.array([len(x) for x in sets])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            known, ids = np.unique(np.concatenate(sets), return_inverse=True)
            nodes = held.node.to_numpy()
            for u, vs, x in zip(own.u, own.vs, own.shingles, strict=True):
                x = np.frombuffer(x, np.uint64)
                at = np.searchsorted(known, x)
                at[at == len(known)] = 0
                mark = np.zeros(len(known), np.int32)
                mark[at[known[at] == x]] = 1
                both = np.add.reduceat(mark[ids], starts)
                ok = (100 * both >= percent * (len(x) + sizes - both)) & np.isin(nodes, vs)
                found += [(u, v) for v in nodes[ok]]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    links = saved(left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(check, "u long, v long").distinct(), "near-verified")
    unsaved(full)
    return links


def several_texts(rows: DataFrame) -> DataFrame:
    """(doc_id) of those that have rows with different sets."""
    key = F.struct(F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"), F.col("k1").isNull().alias("none"))
    by = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    return by.filter("n > 1 AND low <> high").select("doc_id")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-7, block: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (it is its own component's), stays
    (``near_dedup`` keeps it; the same as kept where no doc_id has several texts)."""
    rows = saved(prints(docs, width), "near-prints")
    least = least_matches(percent / 100, miss)
    some = rows.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    classes = saved(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature")), "near-classes")
    several = saved(several_texts(rows), "near-several")
    mixed = several.limit(1).count() > 0
    named = classes if mixed else None
    bands = band_rows(classes)
    star = bands.groupBy("bucket").agg(F.min("node").alias("star"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "star")
    buckets = saved(bands.join(star, "bucket"), "near-buckets")
    pairs = buckets.filter("node <> star").select(F.col("star").alias("u"), F.col("node").alias("v")).distinct()
    pairs = saved(pruned(pairs, classes, least), "near-pairs")
    links = verified(pairs, docs, width, percent, named)
    unsaved(pairs)
    label = components(links)
    buckets = buckets.select("bucket", "node")
    more = saved(open_candidates(buckets, label, classes, least, block), "near-open")
    if more.limit(1).count():
        members = parts(buckets.select("node").distinct(), label, block).select("node", "part")
        links = links.unionAll(verified_in_parts(more, members, docs, width, percent, block, named))
        label = components(links)
    unsaved(more)
    merged = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    merged = merged.filter("copies > 1 OR component <> node").select(F.col("k1").alias("__1"), F.col("k2").alias("__2"), "component")
    out = rows.join(merged, (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")) & F.col("doc_id").isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    if not mixed:
        return out.withColumn("kept", kept).withColumn("stays", F.col("kept"))
    # the texts of a document join what each of them is linked with
    own = some.select("doc_id", "k1", "k2").join(several, "doc_id", "left_semi").distinct()
    own = saved(own.join(classes, ["k1", "k2"]).select("doc_id", "node"), "near-own")
    first = own.groupBy("doc_id").agg(F.min("node").alias("u"))
    joined = components(links.unionAll(own.join(first, "doc_id").filter("node <> u").select("u", F.col("node").alias("v"))))
    whole = out.withColumn("alone", kept).join(joined.select(F.col("node").alias("component_id"), F.col("component").alias("further")), "component_id", "left")
    whole = saved(whole.select("doc_id", "n_shingles", F.coalesce("further", "component_id").alias("component_id"), "alone"), "near-joined")
    # rows without words, too, belong to their document
    by = whole.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.bool_or(F.col("alone") & (F.col("n_shingles") > 0)).alias("any"))
    done = whole.join(by, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"), F.coalesce("any", "alone").alias("stays"))
    return done.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "stays")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are linked with one of a smaller doc_id, see above."""
    (name,) = fresh(docs, "__lost")
    lost = near_components(docs, width, percent).filter("NOT stays").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80).drop("stays")


ORACLE_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
