"""Operator 13, periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run of period q with at least ``times`` periods holds each of its words ``times`` times or more. So a word that occurs less often in a
segment is in no run there: it splits the segment. Its parts are counted anew and split again until nothing changes; parts too short for
a run go. All texts of a batch are split together, each round by one sort of (segment, word). Prose is gone after a round or two.

What survives is scanned lag by lag, from 1 up. A run of period q covers two whole blocks of q words that begin at a multiple of q, so
for each lag only the words at its multiples are compared with those a lag and two lags on, and only where both agree the stretch is
measured to both sides. All lags of a segment of m words thus compare about m ln m words. A probe or stretch that lies in a run already
found (of a smaller period) is passed over: two periods that share so long a stretch share a divisor, so q isn't smallest there.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run: consecutive words with smallest period q and length >= max(least, times * q)
that no neighbouring word extends. ``collapsed`` is the text without the words that any run contains after its first q words, joined by
single spaces.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows and null doc_ids keep
rows of their own; columns named runs and collapsed are replaced, all others pass through, whatever their names. A text is one task's
row, whatever its length, and needs memory for its words only. An empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import quoted, small_batches, table

WORDS = r"[^\x20\x09-\x0D]+"

MADE = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def words_of(text: str | None) -> list[str]:
    """bytes.split() parts at the contract's spaces only."""
    return [w.decode() for w in text.encode().split()] if text else []


def segments(words: np.ndarray, text: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """The stretches (first, end) that are left. words: numbers of words; text: which text each is in, ascending."""
    place, owner = np.arange(len(words)), text.astype(np.int64)
    kinds = int(words.max()) + 1 if len(words) else 1
    while len(place):
        _, inverse, count = np.unique(owner * kinds + words[place], return_inverse=True, return_counts=True)
        stays = count[inverse] >= times
        place, owner = place[stays], owner[stays]
        if not len(place):
            break
        # a segment ends where places have a gap or its owner changes
        new = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(owner) != 0)])
        owner = np.cumsum(new) - 1
        long = np.bincount(owner) >= least
        if stays.all() and long.all():
            break
        keep = long[owner]
        place, owner = place[keep], owner[keep]
    if not len(place):
        return []
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return [(int(place[a]), int(place[z - 1]) + 1) for a, z in zip(first, [*first[1:], len(place)], strict=True)]


def same_until(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from x[i] and x[j] on (step 1 or -1) agree. Doubling looks keep it to what it finds."""
    n, look = 0, 32
    room = (len(x) - j) if step > 0 else i + 1
    while n < room:
        k = min(look, room - n)
        if step > 0:
            differ = x[i + n : i + n + k] != x[j + n : j + n + k]
        else:
            differ = (x[i - n - k + 1 : i - n + 1] != x[j - n - k + 1 : j - n + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, look = n + k, look * 2
    return n


def lag_scan(x: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by period, then start."""
    found: list[tuple[int, int, int]] = []
    starts = ends = np.zeros(0, np.int64)  # of the runs found, sorted by start; ends: the furthest end so far of these
    for q in range(1, len(x) // times + 1):
        own = x[::q]
        probe = np.flatnonzero((own[:-2] == own[1:-1]) & (own[1:-1] == own[2:])) * q
        if not len(probe):
            continue
        new, reach = [], -1
        if len(starts):
            last = np.searchsorted(starts, probe, side="right") - 1
            probe = probe[(last < 0) | (ends[np.maximum(last, 0)] < probe + 2 * q)]
        for i in probe.tolist():
            if i + q < reach:
                continue  # measured with the probe before
            ahead = same_until(x, i, i + q, 1)
            back = same_until(x, i - 1, i + q - 1, -1)
            start, length = i - back, back + ahead + q
            reach = start + length
            if length >= max(least, times * q):
                last = int(np.searchsorted(starts, start, side="right")) - 1
                if last < 0 or ends[last] < reach:  # else a part of a run of a smaller period, which divides q
                    new.append((start, length, q))
        if new:
            found += new
            by_start = sorted((s, s + n) for s, n, _ in found)
            starts = np.array([s for s, _ in by_start])
            ends = np.maximum.accumulate([e for _, e in by_start])
    return found


def runs_of(texts: list[list[str]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    x = np.array([i for words in texts for i in map(numbers.__getitem__, words)], np.int64)
    sizes = [len(words) for words in texts]
    begins = np.cumsum([0, *sizes])
    text = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, z in segments(x, text, least, times):
        t = int(text[a])
        out[t] += [(a - int(begins[t]) + s, n, q) for s, n, q in lag_scan(x[a:z], least, times)]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str | Column = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs with runs, array<struct<start, length, period>> by start, then period, and collapsed. times: at least 3, as the probes of the
    lag scan are three words a lag apart."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    small_batches(docs.sparkSession)
    value = docs[quoted(text)] if isinstance(text, str) else text
    names = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    # plain names meanwhile, as mapInArrow doesn't take all
    own = docs.select(*[docs[quoted(c)].alias(f"c{i}") for i, c in enumerate(names)], value.cast("string").alias("scanned"))
    out = StructType(own.schema.fields[:-1] + StructType.fromDDL(MADE).fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)
        for b in batches:
            runs, left, texts, n = [], [], [], 0
            for i, t in enumerate(b.columns[-1]):
                texts.append(words_of(t.as_py()))
                n += len(texts[-1])
                if n > 500_000 or i == b.num_rows - 1:  # words of this many texts at once
                    for words, found in zip(texts, runs_of(texts, least, times), strict=True):
                        runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                        left.append(collapsed(words, found))
                    texts, n = [], 0
            made = [pa.array(runs, kinds.field(-2).type), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=kinds.names)

    return own.mapInArrow(scan, out).toDF(*names, "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """Of the runs the one with the greatest length / period, compared exactly; of equals the first by start, then period."""
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(better(a, r), r).otherwise(a))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: where crc32 of the decimal doc_id is a multiple of 10, the words repeat from a place and with a period
    that it tells. A null doc_id tells none."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def repeated(both: Column) -> Column:
        ws, g = both["ws"], both["g"]
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(ws, i)), " "))

    whole = F.transform(F.array(F.struct(words.alias("ws"), F.floor(h / 10).alias("g"))), repeated)[0]
    return F.when(h % 10 == 0, whole).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = strongest(F.col("runs"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
