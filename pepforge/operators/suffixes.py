"""A generalised suffix array of many sequences, by prefix doubling as rounds of joins, and what follows from neighbours in it.

Every place of every sequence has a name that orders it among all by the letters that follow it there. Names of the first letters are
doubled: those of 2h letters are the ranks of pairs of names h places apart. Ranks are given to the distinct pairs only, by a range sort,
so a text that occurs at a third of all places is one row of the sort; it stops once a round tells no more places apart, after about
log2 of the longest text that two places share. Names needn't be dense: the one after n is n + 1 or the first one of the next part of the
sort, which a table with a row for each part tells. No step compares the places of a frequent text with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..store import kept, spread, unsaved
from .inside import maximal as maximal  # the same rows as maximal_by_order(), without rounds over all places

#: Sorts before all letters and fills what is missing beyond a sequence's end.
END = "\x01"

#: monotonically_increasing_id() has the part of the sort above these bits.
PART_BITS = 33


def ranked(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys with rank, which is in their order."""
    columns = keys.columns
    # numbered in the order of the sort, which Spark does by ranges
    return kept(keys.distinct().orderBy(*columns).select(*columns, F.monotonically_increasing_id().alias("rank")), "suffix-ranks")


def suffix_names(seqs: DataFrame, first: int = 8, id_col: str = "id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(places, names): places (id, at, name) has every place of every sequence; names (name, n) the names in use and at how many places
    each is. Places have the same name where the rest of their sequences is the same, and smaller ones come first in the alphabet
    (an end before all letters). Ids are unique; empty and null sequences have no place."""
    own = seqs.select(F.col(id_col).alias("id"), F.concat(F.col(seq), F.lit(END * (first - 1))).alias("text")).filter(F.length(seq) > 0)
    keyed = kept(own.select("id", F.posexplode(P.kmers("text", first)).alias("at", "k")), "suffix-keys")
    names = ranked(keyed.select("k"))
    places = kept(keyed.join(names, "k").select("id", "at", F.col("rank").alias("name")), "suffix-places")
    unsaved(keyed)
    h, known = first, names.count()
    while True:
        then = places.select("id", (F.col("at") - h).alias("at"), F.col("name").alias("then")).filter("at >= 0")
        pairs = kept(places.join(then, ["id", "at"], "left").select("id", "at", "name", F.coalesce("then", F.lit(-1)).alias("then")), "suffix-pairs")
        finer = ranked(pairs.select("name", "then"))
        now = finer.count()
        if now == known:
            unsaved(pairs, finer)
            return places, kept(places.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "suffix-counts")
        moved = pairs.join(finer, ["name", "then"]).select("id", "at", F.col("rank").alias("name"))
        held, places = places, kept(moved, "suffix-places")
        unsaved(held, pairs, finer)
        h, known = 2 * h, now


def after(names: DataFrame) -> DataFrame:
    """(name, next): each name but the last with the one after it."""
    ends = names.groupBy(F.shiftright("name", PART_BITS).alias("part")).agg(F.max("name").alias("last"), F.min("name").alias("begin"))
    # a row for each part of the sort, so this window and broadcast are small whatever the corpus
    turns = ends.select("last", F.lead("begin").over(Window.orderBy("part")).alias("turn"))
    found = names.join(spread(turns), F.col("name") == F.col("last"), "left")
    return found.select("name", F.when(F.col("last").isNull(), F.col("name") + 1).otherwise(F.col("turn")).alias("next")).filter("next IS NOT NULL")


def maximal_by_order(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq): the distinct sequences that no other one contains, from the order of all their suffixes. The empty sequence is in any other.

    A sequence is contained in another one if its whole text ends another one, or if the suffix after it in the order, which isn't its
    own, begins with it: one comparison for each sequence, however many others hold it.
    """
    texts = seqs.select(F.col(seq).alias("seq")).filter(F.col("seq").isNotNull()).distinct()
    own = kept(texts.select(F.monotonically_increasing_id().alias("id"), "seq"), "suffix-texts")
    places, names = suffix_names(own)
    whole = places.filter("at = 0").select(F.col("id").alias("part"), "name")
    ends = names.filter("n > 1").select("name")
    elsewhere = places.groupBy("name").agg(F.min(F.struct("id", "at")).alias("at"))
    following = whole.join(after(names), "name").join(elsewhere.select(F.col("name").alias("next"), "at.id", "at.at"), "next")
    held = following.join(own.select(F.col("id").alias("part"), F.col("seq").alias("short")), "part").join(own, "id")
    begins = held.filter(F.substr("seq", F.col("at") + 1, F.length("short")) == F.col("short")).select("part")
    inside = whole.join(ends, "name", "left_semi").select("part").unionAll(begins).distinct()
    empty = F.length("seq") > 0 if own.limit(2).count() > 1 else F.lit(True)
    return own.filter(empty).join(inside, F.col("id") == F.col("part"), "left_anti").select("seq")
