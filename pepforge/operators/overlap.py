"""Joins of sequences by overlap and containment, as equi-joins.

A condition like 'the end of a is the beginning of b' compares all pairs if written as it is. Here both sides are exploded to the
affixes (or seeds) that can be equal, and joined on those; Spark picks the physical join and splits hot affixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P


def affixes(seqs: DataFrame, least: int | str, id_col: str, seq: str, side: str, name: str, by: list[str]) -> DataFrame:
    """(name_id, by, olap, affix): a hash of every beginning or end of at least ``least`` letters. The texts stay behind."""
    if isinstance(least, int) and least < 1:
        raise ValueError("an overlap has a letter at least")
    cut = P.prefix if side == "prefix" else P.suffix
    shortest = F.lit(least) if isinstance(least, int) else F.greatest(F.col(least), F.lit(1))
    own = seqs.filter(F.length(seq) >= shortest).select(F.col(id_col).alias(f"{name}_id"), F.col(seq).alias("text"), *by, F.explode(F.sequence(shortest, F.length(seq))).alias("olap"))
    return own.select(f"{name}_id", *by, "olap", F.xxhash64(cut(F.col("text"), F.col("olap"))).alias("affix"))


def overlaps(seqs: DataFrame, min_overlap: int | str, id_col: str = "id", seq: str = "seq", inclusive: bool = True, by: list[str] | None = None) -> DataFrame:
    """(a_id, b_id, by, a, b, olap): the end of a is the beginning of b, for every length from min_overlap on. Ids are unique.

    inclusive: up to the whole shorter sequence; else shorter than both. No row is paired with itself. by: columns that both rows
    must agree on, so that many sets of sequences are joined at once; min_overlap may be a column, too. Candidates come from hashes
    of the affixes; the texts are joined to these only, and compared.
    """
    by = by or []
    ends, starts = (affixes(seqs, min_overlap, id_col, seq, side, name, by) for side, name in (("suffix", "a"), ("prefix", "b")))
    pairs = ends.join(starts, [*by, "olap", "affix"]).filter("a_id <> b_id").select("a_id", "b_id", *by, "olap")
    for name in ("a", "b"):
        pairs = pairs.join(seqs.select(F.col(id_col).alias(f"{name}_id"), F.col(seq).alias(name)), f"{name}_id")
    pairs = pairs.filter(F.right("a", F.col("olap")) == F.left("b", F.col("olap")))
    if not inclusive:
        pairs = pairs.filter(F.col("olap") < F.least(F.length("a"), F.length("b")))
    return pairs.select("a_id", "b_id", *by, "a", "b", "olap")


def longest_overlaps(pairs: DataFrame) -> DataFrame:
    """Of each ordered pair the longest overlap only."""
    return pairs.groupBy(*[c for c in pairs.columns if c != "olap"]).agg(F.max("olap").alias("olap"))


def best_partner(pairs: DataFrame) -> DataFrame:
    """For each a the b with the longest overlap; of equals the one with the smallest id."""
    best = F.row_number().over(Window.partitionBy("a_id").orderBy(F.col("olap").desc(), "b_id"))
    return pairs.withColumn("rank", best).filter("rank = 1").drop("rank")


def overlap_merges(pairs: DataFrame) -> DataFrame:
    """pairs with seq, a followed by the rest of b."""
    return pairs.withColumn("seq", P.merged("a", "b", "olap"))


def containing(parts: DataFrame, holders: DataFrame, seed: int = 8, part: str = "part", holder: str = "holder") -> DataFrame:
    """(part, holder): the distinct pairs where holder contains part (equal texts too).

    Parts of at least ``seed`` letters are joined on their first seed with all seeds of the holders. Shorter parts are joined on all
    letters, with the windows of just their lengths. Windows carry a hash that names their holder; the holders themselves are joined to
    the candidates only, and these are verified, so hashes needn't be unique. The empty part is in every holder.
    """
    parts, holders = parts.select(part).distinct(), holders.select(holder).distinct()
    named = holders.withColumn("named", F.xxhash64(holder))
    keyed = parts.filter(F.length(part) > 0).withColumn("k", F.least(F.length(part), F.lit(seed)))
    keyed = keyed.withColumn("key", P.prefix(F.col(part), F.col("k")))
    sizes = keyed.select("k").distinct()  # seed rows at most
    windows = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(seed)))).join(F.broadcast(sizes), "k", "left_semi")
    windows = windows.select("named", "k", F.explode(F.array_distinct(P.kmers(holder, F.col("k")))).alias("key"))
    pairs = keyed.join(windows, ["k", "key"]).select(part, "named").join(named, "named")
    found = pairs.filter(F.contains(F.col(holder), F.col(part))).select(part, holder)
    empty = parts.filter(F.length(part) == 0).join(holders.limit(1))
    return found.unionByName(empty).distinct()


def without_contained(seqs: DataFrame, seq: str = "seq", seed: int = 8) -> DataFrame:
    """The distinct sequences that no other one contains."""
    own = seqs.select(seq).distinct()
    inside = containing(own.select(F.col(seq).alias("part")), own.select(F.col(seq).alias("holder")), seed).filter("part <> holder")
    return own.join(inside.select(F.col("part").alias(seq)).distinct(), seq, "left_anti")


def common_runs(seqs: DataFrame, min_overlap: int, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """(a_id, b_id, a, b, i, j, n): the maximal runs of at least min_overlap letters that two rows share, i and j from 0.

    Seeds of min_overlap letters are equi-joined by id and place; those that follow each other on one diagonal are one run (gaps
    and islands). The texts are joined to the runs. Ids are unique.
    """
    own = seqs.filter(F.length(seq) >= min_overlap).select(F.col(id_col).alias("id"), F.col(seq).alias("seq"))
    seeds = own.select("id", F.posexplode(P.kmers("seq", min_overlap)).alias("at", "kmer"))
    a = seeds.select(F.col("id").alias("a_id"), F.col("at").alias("i"), "kmer")
    b = seeds.select(F.col("id").alias("b_id"), F.col("at").alias("j"), "kmer")
    both = a.join(b, "kmer").filter("a_id <> b_id").select("a_id", "b_id", "i", "j", (F.col("i") - F.col("j")).alias("diagonal"))
    along = Window.partitionBy("a_id", "b_id", "diagonal").orderBy("i")
    both = both.withColumn("island", F.col("i") - F.row_number().over(along))
    runs = both.groupBy("a_id", "b_id", "diagonal", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + min_overlap - 1).cast("int").alias("n"))
    for name in ("a", "b"):
        runs = runs.join(own.select(F.col("id").alias(f"{name}_id"), F.col("seq").alias(name)), f"{name}_id")
    return runs.select("a_id", "b_id", "a", "b", "i", "j", "n")


def best_common_run(seqs: DataFrame, min_overlap: int, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """(small_id, large_id, small, large, n, small_at, large_at): the longest run that each unordered pair shares.

    Of equally long rows, the one with the larger id is small; of equally long runs the first by small_at, then large_at.
    """
    runs = common_runs(seqs, min_overlap, id_col, seq).filter((F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a_id") > F.col("b_id")))
    first = F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy(F.col("n").desc(), "i", "j"))
    best = runs.withColumn("rank", first).filter("rank = 1")
    return best.select(F.col("a_id").alias("small_id"), F.col("b_id").alias("large_id"), F.col("a").alias("small"), F.col("b").alias("large"), "n", F.col("i").alias("small_at"), F.col("j").alias("large_at"))


def seeded_overlap(seqs: DataFrame, min_overlap: int, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """(a_id, b_id, a, b, n, i, j) for a_id < b_id: the longest extension to the right of a seed of b at its leftmost place in a.

    Of equally long ones the first in b. Pairs without a common seed have no row.
    """
    runs = common_runs(seqs, min_overlap, id_col, seq).filter("a_id < b_id")
    hits = runs.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - min_overlap)))
    hits = hits.select("a_id", "b_id", "a", "b", (F.col("i") + F.col("step")).alias("i"), (F.col("j") + F.col("step")).alias("j"), (F.col("n") - F.col("step")).alias("n"))
    leftmost = F.row_number().over(Window.partitionBy("a_id", "b_id", "j").orderBy("i"))
    longest = F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy(F.col("n").desc(), "j"))
    return hits.withColumn("r", leftmost).filter("r = 1").withColumn("r", longest).filter("r = 1").select("a_id", "b_id", "a", "b", "n", "i", "j")


def crossovers(found: DataFrame, first: str, second: str, n: str, i: str, j: str) -> DataFrame:
    """(seq, kind): for each pair both originals and the two that swap ends around the shared run."""
    a, b, run = F.col(first), F.col(second), F.col(n)
    ab = F.concat(F.substr(a, F.lit(1), F.col(i) + run), F.substr(b, F.col(j) + run + 1))
    ba = F.concat(F.substr(b, F.lit(1), F.col(j) + run), F.substr(a, F.col(i) + run + 1))
    kinds = F.array(*[F.struct(s.alias("seq"), F.lit(k).alias("kind")) for s, k in ((a, "first"), (b, "second"), (ab, "first_second"), (ba, "second_first"))])
    return found.select(F.inline(kinds))


def recombined(seqs: DataFrame, min_overlap: int, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """(seq, kind) for all pairs that share a seed of min_overlap letters."""
    return crossovers(seeded_overlap(seqs, min_overlap, id_col, seq), "a", "b", "n", "i", "j")


def recombined_by_longest_run(seqs: DataFrame, min_overlap: int, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """(seq, kind) around the longest run that a pair shares; once for each unordered pair."""
    return crossovers(best_common_run(seqs, min_overlap, id_col, seq), "small", "large", "n", "small_at", "large_at")
