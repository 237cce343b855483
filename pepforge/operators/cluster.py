"""Clustering of sequences and alignment of clusters.

Both stand for external programs, so their results aren't those programs' to the letter: clusters hold the same conditions
(identity of the aligned part, coverage of the member), alignments are star alignments to the representative.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..store import kept, spread


def global_alignment(a: str, b: str) -> tuple[str, str]:
    """a and b with gaps (match 2, mismatch -1, gap -2), gaps at the ends of a free, so that a part of a can be aligned."""
    n, m = len(a), len(b)
    score = np.zeros((n + 1, m + 1), np.int32)
    score[0, 1:] = -2 * np.arange(1, m + 1)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = 2 * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], 2, -1), score[i - 1, 1:] - 2)
        row = np.concatenate([[0], best])
        score[i] = np.maximum.accumulate(row + steps) - steps  # gaps in a
    i = int(score[:, m].argmax())
    top, low = list(a[i:][::-1]), ["-"] * (n - i)
    j = m
    while j:
        if i and score[i, j] == score[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            top.append(a[i])
            low.append(b[j])
        elif i and score[i, j] == score[i - 1, j] - 2:
            i -= 1
            top.append(a[i])
            low.append("-")
        else:
            j -= 1
            top.append("-")
            low.append(b[j])
    top += a[:i][::-1]
    low += ["-"] * i
    return "".join(reversed(top)), "".join(reversed(low))


def likeness(a: str, b: str) -> tuple[float, float]:
    """The share of equal letters in the aligned part (from the first to the last pair of letters, gaps inside it count), and the share
    of b's letters that stand opposite a letter of a."""
    columns = list(zip(*global_alignment(a, b), strict=True))
    both = [i for i, (p, q) in enumerate(columns) if p != "-" and q != "-"]
    if not both:
        return 0.0, 0.0
    return sum(columns[i][0] == columns[i][1] for i in both) / (both[-1] - both[0] + 1), len(both) / len(b)


def seeds_kept(m: int, q: int, min_identity: float, min_coverage: float) -> int:
    """Of the q-letter seeds at the m - q + 1 places of a member of m letters, at least so many are in any sequence that it is like.

    An aligned part of c columns has at least ceil(min_identity * c) equal letters; the other columns part them into runs, each of which
    loses q - 1 seeds. c is at least the letters that the coverage asks for, and at most what m letters can make up.
    """
    least = m
    for c in range(max(1, math.ceil(min_coverage * m - 1e-9)), max(1, int(m / min_identity + 1e-9)) + 1):
        equal = min(m, math.ceil(min_identity * c - 1e-9))
        least = min(least, equal - (c - equal + 1) * (q - 1))
    return least


#: The most letters of the seeds that find candidates, and of those whose count they must pass.
LONGEST, COUNTED = 12, 3


def seed_plan(m: int, min_identity: float, min_coverage: float) -> tuple[int, int, int]:
    """(q, least, counted) for a member of m letters: the longest seeds of which it keeps one or more, how many of them, and how many of
    its seeds of COUNTED letters (or q, if that is less)."""
    q = next((q for q in range(min(LONGEST, m), 1, -1) if seeds_kept(m, q, min_identity, min_coverage) >= 1), 1)
    kept_by = lambda k: max(1, seeds_kept(m, k, min_identity, min_coverage))
    return q, kept_by(q), kept_by(min(q, COUNTED))


def seed_hashes(seq: str, q: str, used: list[int]) -> F.Column:
    """The hashes of the seeds of q letters at all places; q: a column whose values are used ones."""
    found = F.array().cast("array<bigint>")
    for k in used:
        found = F.when(F.col(q) == k, F.transform(P.kmers(seq, k), lambda x: F.xxhash64(x))).otherwise(found)
    return found


def candidates(own: DataFrame, hot_rows: int = 10_000) -> DataFrame:
    """(rep, member): pairs of own (id, seq, q, least) with rep before member that share a seed which any pair of look-alikes must share.

    Seeds are ordered by how many sequences hold them. Of a member's seeds, all but least - 1 are probed, the rarest first: least of its
    seeds are in a look-alike, so one of the probed ones is. Frequent seeds, which make the most pairs, are thus left out as far as
    can be. A seed that more than hot_rows sequences hold is dealt over as many parts as it takes.
    """
    used = sorted(r.q for r in own.select("q").distinct().collect())  # 12 at most
    sizes = F.explode(F.array(*[F.lit(k) for k in used])) if used else F.lit(1)
    holders = own.select("id", "seq", sizes.alias("k")).filter(F.length("seq") >= F.col("k"))
    holders = holders.select(F.col("id").alias("rep"), "k", F.explode(F.array_distinct(seed_hashes("seq", "k", used))).alias("seed"))
    holders = kept(holders, "seed-holders")
    counts = kept(holders.groupBy("k", "seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "seed-counts")
    hot = spread(counts.filter(F.col("n") > hot_rows).select("k", "seed", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    probes = own.select(F.col("id").alias("member"), F.col("q").alias("k"), (F.length("seq") - F.col("q") + 1 - F.col("least") + 1).alias("probed"), F.posexplode(seed_hashes("seq", "q", used)).alias("at", "seed"))
    # seeds that no other sequence holds come first, as they are the rarest
    probes = probes.join(counts, ["k", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rarest = F.row_number().over(Window.partitionBy("member").orderBy("n", "seed", "at"))
    probes = probes.withColumn("r", rarest).filter("r <= probed AND n > 1").select("member", "k", "seed").distinct()
    probes = probes.join(hot, ["k", "seed"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    held = holders.join(hot, ["k", "seed"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    return probes.join(held, ["k", "seed", "part"]).filter("rep < member").select("rep", "member").distinct()


def in_a_band(a: str, b: str, q: int, spread: int) -> int:
    """The most seeds of b that a holds on diagonals of which no two are more than spread apart."""
    x, y = (np.lib.stride_tricks.sliding_window_view(np.frombuffer(t.encode("utf-32-le"), np.uint32), q) if len(t) >= q else np.zeros((0, q), np.uint32) for t in (a, b))
    weights = np.uint64(1) << (np.uint64(21) * np.arange(q, dtype=np.uint64))  # code points have 21 bits, seeds 3 letters
    x, y = (t.astype(np.uint64) @ weights for t in (x, y))
    order = np.argsort(x, kind="stable")
    first, end = (np.searchsorted(x[order], y, side=side) for side in ("left", "right"))
    n = end - first
    place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]
    diagonal = np.sort(place - np.repeat(np.arange(len(y)), n))
    return int((np.searchsorted(diagonal, diagonal + spread, side="right") - np.arange(len(diagonal))).max(initial=0))


def look_alikes(own: DataFrame, min_identity: float, min_coverage: float) -> DataFrame:
    """(rep, member): the pairs of own with rep before member of which member is like rep. All of them: see candidates()."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series, q: pd.Series, counted: pd.Series) -> pd.Series:
        def one(x: str, y: str, k: int, least: int) -> bool:
            # gaps move the alignment to other diagonals, and no more columns than these can be gaps
            gaps = int(len(y) / min_identity * (1 - min_identity) + 1e-9) + 1
            if in_a_band(x, y, k, gaps) < least:
                return False
            same, share = likeness(x, y)
            return same >= min_identity and share >= min_coverage

        return pd.Series([one(*row) for row in zip(a, b, q, counted, strict=True)], dtype=bool)

    pairs = candidates(own).join(own.select(F.col("id").alias("member"), F.col("seq").alias("b"), "q", "counted"), "member")
    pairs = pairs.join(own.select(F.col("id").alias("rep"), F.col("seq").alias("a")), "rep")
    # so many of the member's short seeds must be in the other one
    short = F.array().cast("array<string>")
    for k in range(1, COUNTED + 1):
        short = F.when(F.least("q", F.lit(COUNTED)) == k, P.kmers("b", k)).otherwise(short)
    shared = F.size(F.filter(short, lambda x: F.contains(F.col("a"), x)))
    # aligned where few tasks would have most of them
    return pairs.filter(shared >= F.col("counted")).repartition("rep", "member").filter(alike("a", "b", F.least("q", F.lit(COUNTED)), "counted")).select("rep", "member")


def cluster(seqs: DataFrame, min_identity: float = 0.85, min_coverage: float = 0.8, seq: str = "seq") -> DataFrame:
    """(cluster, seq): each sequence with its representative: longest first (equal ones alphabetically), every sequence that no earlier
    representative is like becomes one itself, and others join the first such representative. Empty and null sequences are in none.

    Pairs are compared only if they share the seeds that look-alikes must share; no look-alikes are lost. Whether a sequence represents is
    settled in rounds: those all of whose earlier look-alikes are settled are decided at once.
    """
    if not 0 < min_identity <= 1:
        raise ValueError("min_identity is above 0 and at most 1")

    @F.pandas_udf("struct<q:int,least:int,counted:int>")
    def planned(lengths: pd.Series) -> pd.DataFrame:
        plans = {m: seed_plan(int(m), min_identity, min_coverage) for m in lengths.unique()}
        return pd.DataFrame([plans[m] for m in lengths], columns=["q", "least", "counted"])

    # ids in the order of the sort, which Spark does by ranges
    ordered = seqs.select(F.col(seq).alias("seq")).filter(F.length("seq") > 0).distinct().orderBy(F.length("seq").desc(), "seq").select(F.monotonically_increasing_id().alias("id"), "seq")
    own = kept(ordered.withColumn("plan", planned(F.length("seq"))).select("id", "seq", "plan.*"), "cluster-seqs")
    like = kept(look_alikes(own, min_identity, min_coverage), "cluster-pairs")
    pairs, left, reps = like, own.select("id"), None
    while True:
        new = kept(left.join(pairs.select(F.col("member").alias("id")).distinct(), "id", "left_anti"), "cluster-reps")
        reps = new if reps is None else reps.unionAll(new)
        as_rep = new.select(F.col("id").alias("rep"))
        taken = kept(pairs.join(as_rep, "rep", "left_semi").select(F.col("member").alias("id")).distinct(), "cluster-taken")
        settled = new.unionAll(taken)
        left = kept(left.join(settled, "id", "left_anti"), "cluster-open")
        if not left.limit(1).count():
            break
        pairs = pairs.join(settled, F.col("rep") == F.col("id"), "left_anti").join(settled, F.col("member") == F.col("id"), "left_anti")
        pairs = kept(pairs, "cluster-waits")
    first = like.join(reps.select(F.col("id").alias("rep")), "rep", "left_semi").groupBy("member").agg(F.min("rep").alias("rep"))
    names = own.select(F.col("id").alias("rep"), F.col("seq").alias("cluster"))
    members = own.join(first, F.col("id") == F.col("member"), "left").select(F.coalesce("rep", "id").alias("rep"), "seq")
    return members.join(names, "rep").select("cluster", "seq")


def members_of(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """The FASTA records (id, ...) of each cluster (cluster, contig)."""
    return clusters.join(records, clusters.contig == records.id)


def star_alignments(clusters: DataFrame) -> DataFrame:
    """(cluster, seq, aligned): each member aligned to its representative; all of a cluster have equal lengths. A lone member stays.

    Pairs are aligned one by one. The gaps that any pair puts into the representative are summed up for the cluster (by position the
    most), and each pair then opens them; so no cluster is collected.
    """

    @F.pandas_udf("struct<top:string,low:string,gaps:array<struct<at:int,n:int>>>")
    def pair(reps: pd.Series, seqs: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(reps, seqs, strict=True):
            top, low = global_alignment(a, b)
            gaps: dict[int, int] = {}
            at = 0
            for c in top:
                if c == "-":
                    gaps[at] = gaps.get(at, 0) + 1
                else:
                    at += 1
            out.append((top, low, [{"at": p, "n": n} for p, n in sorted(gaps.items())]))
        return pd.DataFrame(out, columns=["top", "low", "gaps"])

    @F.pandas_udf("string")
    def opened(tops: pd.Series, lows: pd.Series, all_gaps: pd.Series) -> pd.Series:
        def one(top: str, low: str, gaps) -> str:
            most = {g["at"]: g["n"] for g in (gaps if gaps is not None else [])}
            out, at, run = [], 0, 0
            for p, q in zip(top + "\0", low + "\0", strict=True):
                if p == "-":
                    run += 1
                else:
                    out.append("-" * (most.get(at, 0) - run))
                    at, run = at + 1, 0
                out.append(q)
            return "".join(out[:-1])

        return pd.Series([one(*x) for x in zip(tops, lows, all_gaps, strict=True)])

    pairs = kept(clusters.withColumn("p", pair("cluster", "seq")), "pair-alignments")
    most = pairs.select("cluster", F.inline("p.gaps")).groupBy("cluster", "at").agg(F.max("n").alias("n")).groupBy("cluster").agg(F.collect_list(F.struct("at", "n")).alias("gaps"))
    return pairs.join(most, "cluster", "left").select("cluster", "seq", opened("p.top", "p.low", "gaps").alias("aligned"))
