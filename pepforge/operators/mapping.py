"""Mapping sequences onto reference proteins with mismatches, and what follows from the mapped intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import peptides as P
from ..store import kept, spread, unsaved

PLACE = "start int, mismatches_pos array<int>"


def best_place(seq: str, protein: str) -> tuple[int, list[int]] | None:
    """The leftmost start with the fewest mismatches, and where these are in seq."""
    if not seq or len(seq) > len(protein):
        return None
    p, q = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (protein, seq))
    wrong = np.zeros(len(p) - len(q) + 1, np.int64)
    for i, c in enumerate(q):
        wrong += p[i : i + len(wrong)] != c
    start = int(wrong.argmin())
    return start, np.flatnonzero(p[start : start + len(q)] != q).tolist()


def placed(pairs: DataFrame, seq: str = "sequence", protein: str = "protein") -> DataFrame:
    """pairs with start, end (exclusive, from 0), mismatches_pos and identity_score at the best place; null where there is none.

    The place doesn't depend on any threshold, so one result serves all settings of a sweep.
    """

    @F.pandas_udf(PLACE)
    def find(s: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [best_place(a, b) if a is not None and b is not None else None for a, b in zip(s, p, strict=True)]
        return pd.DataFrame({"start": pd.array([f and f[0] if f else None for f in found], dtype="Int32"), "mismatches_pos": [f[1] if f else None for f in found]})

    out = pairs.withColumn("__at", find(seq, protein))
    out = out.withColumns({"start": F.col("__at.start"), "mismatches_pos": F.col("__at.mismatches_pos")}).drop("__at")
    n = F.length(seq)
    return out.withColumns({"end": F.col("start") + n, "identity_score": (n - F.size("mismatches_pos")) / n})


def within_limits(places: DataFrame, max_mismatches: int | str, min_identity: float | str) -> DataFrame:
    """Those with few enough mismatches and enough identity, and any identity at all."""
    most = F.col(max_mismatches) if isinstance(max_mismatches, str) else F.lit(max_mismatches)
    least = F.col(min_identity) if isinstance(min_identity, str) else F.lit(min_identity)
    return places.filter(F.col("start").isNotNull() & (F.size("mismatches_pos") <= most) & (F.col("identity_score") >= least) & (F.col("identity_score") > 0))


def map_to_protein(seqs: DataFrame, protein: str, max_mismatches: int, min_identity: float, seq: str = "seq") -> DataFrame:
    """(sequence, start, end, mismatches_pos, identity_score) of the sequences that map onto the one protein."""
    found = placed(seqs.select(F.col(seq).alias("sequence")).withColumn("protein", F.lit(protein)))
    return within_limits(found, max_mismatches, min_identity).select("sequence", "start", "end", "mismatches_pos", "identity_score")


def native_places(seqs: DataFrame, proteins: DataFrame, seq: str = "seq", protein: str = "protein") -> DataFrame:
    """Like placed, by built-in functions only, of every sequence on every protein; ``proteins`` has columns of its own.

    A pair stays one row: the starts are compared within it, and only the best one's mismatches are listed. The proteins are the
    query set that all sequences meet, broadcast if they are few.
    """
    pairs = seqs.join(spread(proteins)).filter((F.length(seq) > 0) & (F.length(seq) <= F.length(protein)))
    pairs = pairs.withColumns({"__q": F.split(seq, ""), "__p": F.split(protein, "")})
    wrong = lambda s: F.zip_with("__q", F.slice("__p", s + 1, F.size("__q")), lambda a, b: a != b)
    starts = F.sequence(F.lit(0), F.size("__p") - F.size("__q"))
    best = F.array_min(F.transform(starts, lambda s: F.struct(F.size(F.filter(wrong(s), lambda x: x)).alias("n"), s.alias("start"))))
    pairs = pairs.withColumn("__b", F.explode(F.array(best)))  # exploded, so that Spark doesn't compute it anew for each of its uses
    offsets = F.filter(F.transform(wrong(F.col("__b.start")), lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    n = F.length(seq)
    return pairs.select(*seqs.columns, *proteins.columns, F.col("__b.start").alias("start"), (F.col("__b.start") + n).alias("end"), offsets.alias("mismatches_pos"), ((n - F.col("__b.n")) / n).alias("identity_score"))


def seeded_places(seqs: DataFrame, proteins: DataFrame, max_mismatches: int, seq: str = "seq", protein: str = "protein") -> DataFrame:
    """Like native_places, but only pairs with at most max_mismatches, found by equi-joins.

    A sequence is cut into max_mismatches + 1 pieces. Where it fits with so few mismatches, a piece fits without any; so the pieces
    are joined, with their offsets, to the proteins' windows of their lengths, and the starts that follow are verified. Sequences of
    max_mismatches letters or fewer have single letters for pieces, so they have no place where no letter fits.
    """
    pieces = F.least(F.lit(max_mismatches + 1), F.length(seq))
    own = seqs.filter(F.length(seq) > 0).select(*seqs.columns, F.monotonically_increasing_id().alias("__s"))
    own = kept(own, "pieces")
    held = kept(proteins.select(*proteins.columns, F.monotonically_increasing_id().alias("__h")), "proteins")
    cut = lambda i: F.floor(F.length(seq) * i / pieces).cast("int")
    parts = own.withColumn("__i", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumns({"__at": cut(F.col("__i")), "__k": cut(F.col("__i") + 1) - cut(F.col("__i"))})
    parts = parts.select("__s", "__at", "__k", F.substr(F.col(seq), F.col("__at") + 1, F.col("__k")).alias("__key"))
    lengths = spread(parts.select("__k").distinct())
    windows = held.join(lengths).select("__h", "__k", F.posexplode(P.kmers(protein, F.col("__k"))).alias("__from", "__key"))
    starts = parts.join(windows, ["__k", "__key"]).select("__s", "__h", (F.col("__from") - F.col("__at")).alias("start")).filter("start >= 0").distinct()
    found = starts.join(own, "__s").join(held, "__h").filter(F.col("start") + F.length(seq) <= F.length(protein))
    wrong = F.zip_with(F.split(seq, ""), F.split(F.substr(F.col(protein), F.col("start") + 1, F.length(seq)), ""), lambda a, b: a != b)
    offsets = F.filter(F.transform(wrong, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    found = found.withColumn("mismatches_pos", offsets).filter(F.size("mismatches_pos") <= max_mismatches)
    keys = [*seqs.columns, *proteins.columns]
    best = found.groupBy("__s", "__h").agg(F.min_by(F.struct(*keys, "start", "mismatches_pos"), F.struct(F.size("mismatches_pos"), F.col("start"))).alias("b")).select("b.*")
    n = F.length(seq)
    return best.select(*keys, "start", (F.col("start") + n).alias("end"), "mismatches_pos", ((n - F.size("mismatches_pos")) / n).alias("identity_score"))


def nearest_places(seqs: DataFrame, proteins: DataFrame, key: str, seq: str = "seq", protein: str = "protein") -> DataFrame:
    """(seq, key, protein, start, end, mismatches_pos, identity_score): for each distinct sequence its place with the fewest mismatches on
    any protein; of equal ones that of the smallest key, then the leftmost. Sequences without a place where a letter fits have no row.

    No limit on mismatches and no pair of each sequence with each protein: the limit of seeded_places grows from 0, about doubling.
    All places within a limit are found, so what has one is settled, and only the other sequences meet the next limit.
    """
    left = seqs.select(F.col(seq).alias("seq")).filter(F.length(seq) > 0).distinct()
    own = kept(proteins.select(F.col(key), F.col(protein).alias("protein")), "proteins")
    longest = own.agg(F.max(F.length("protein"))).first()[0] or 0
    left, most, found = kept(left.filter(F.length("seq") <= longest), "unplaced"), 0, None
    while True:
        places = seeded_places(left, own, most)
        columns = [c for c in places.columns if c != "seq"]
        order = F.struct(F.size("mismatches_pos"), F.col(key), F.col("start"))
        best = kept(places.groupBy("seq").agg(F.min_by(F.struct(*columns), order).alias("b")).select("seq", "b.*"), "nearest")
        found = best if found is None else found.unionByName(best)
        held, left = left, kept(left.join(best.select("seq"), "seq", "left_anti"), "unplaced")
        unsaved(held)
        # a limit from the length on leaves nothing but sequences of which no letter fits
        if not left.filter(F.length("seq") > most).limit(1).count():
            return found
        most = 2 * most + 1


def substitutions(mapped: DataFrame, protein: str | None = None, seq: str = "sequence") -> DataFrame:
    """mapped with a row for each mismatch: offset, position, query, reference, kind; those beyond the protein are left out."""
    reference = F.lit(protein) if protein is not None else F.col("protein")
    rows = mapped.withColumn("offset", F.explode("mismatches_pos")).withColumn("position", F.col("start") + F.col("offset"))
    rows = rows.filter((F.col("position") < F.length(reference)) & (F.col("offset") < F.length(seq)))
    rows = rows.withColumns({"query": F.substr(F.col(seq), F.col("offset") + 1, F.lit(1)), "reference": F.substr(reference, F.col("position") + 1, F.lit(1))})
    return rows.withColumn("kind", P.substitution("query", "reference"))


def swept_borders(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, at, open, next): at each border of the half-open intervals of a group how many are open up to the next border.

    Rows grow with the number of intervals, not with their lengths; equal borders are summed before the sweep.
    """
    marks = intervals.filter(F.col(start) < F.col(end)).select(*keys, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))))
    marks = marks.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    return marks.select(*keys, "at", F.sum("d").over(w).alias("open"), F.lead("at").over(w).alias("next"))


def covered_length(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered): how many positions the half-open intervals of each group cover together: stretches between borders with any open."""
    swept = swept_borders(intervals, keys, start, end)
    return swept.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("open") > 0, F.col("next") - F.col("at"))), F.lit(0)).cast("long").alias("covered"))


def depth(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, position, depth) of the positions that half-open intervals cover.

    Sweeps the borders as covered_length does; a stretch between two borders has one depth, and its positions are rows of the result only.
    """
    marks = swept_borders(intervals, keys, start, end).filter("open > 0")
    return marks.select(*keys, F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("position"), F.col("open").alias("depth"))


def islands(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", span: int = 1000) -> DataFrame:
    """intervals with island, the first position of the stretch of overlapping closed intervals that each is in, by group.

    An island begins where a start is beyond all ends before it. Groups are cut at every span positions: what comes before a part is the
    maximum of the parts before, one row each, so no group is a task. Null starts or ends make an island of their own.
    """
    low, high = F.least(start, end), F.greatest(start, end)
    rows = intervals.withColumns({"__low": low, "__high": high, "__part": F.floor(low / span)})
    by = [*keys, "__part"]

    def ahead(value: Column, name: str) -> DataFrame:
        """For each part the greatest value in those before it."""
        parts = rows.groupBy(*by).agg(F.max(value).alias(name))
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        return parts.withColumn(name, F.max(name).over(before)).toDF(*[f"{c}_of" for c in by], name)

    def joined(more: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]
        return rows.join(more, reduce(Column.__and__, same), "left").drop(*[f"{c}_of" for c in by])

    so_far = Window.partitionBy(*by).orderBy("__low", "__high")
    rows = joined(ahead(F.col("__high"), "__ahead"))
    reach = F.greatest(F.max("__high").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), "__ahead")
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col("__low") > reach), F.col("__low"))).drop("__ahead")
    rows = joined(ahead(F.col("__new"), "__ahead"))
    # rows of one start are one step, as only the first of them can begin an island
    island = F.greatest(F.max("__new").over(so_far), "__ahead")
    return rows.withColumn("island", island).drop("__low", "__high", "__part", "__new", "__ahead")


def first_fit(starts: np.ndarray, ends: np.ndarray, compat: bool) -> np.ndarray:
    """The tracks, from 0, of one island's closed intervals in their order; an interval with NaN or with its end before its start covers
    nothing.

    Each border keeps the tracks that cover it as the bits of a number, so the first free track is the lowest bit that neither end has.
    """
    if not compat:
        rows: list[list[tuple[float, float]]] = []
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            k = next((i for i, t in enumerate(rows) if not any(a <= s <= z or a <= e <= z or s <= a and z <= e for a, z in t)), len(rows))
            if k == len(rows):
                rows.append([])
            rows[k].append((s, e))
            out.append(k)
        return np.array(out, np.int64)
    borders = np.unique(np.concatenate([starts, ends]))
    covering = [0] * (len(borders) + 1)
    # NaN has a place of its own, which nothing covers
    at = [np.where(np.isnan(x), len(borders), np.searchsorted(borders, x)).tolist() for x in (starts, ends)]
    out = []
    for s, e, known in zip(*at, (~np.isnan(starts + ends)).tolist(), strict=True):
        taken = covering[s] | covering[e]
        free = ~taken & (taken + 1)
        out.append(free.bit_length() - 1)
        if known:
            for i in range(s, e + 1):
                covering[i] |= free
    return np.array(out, np.int64)


def tracks(intervals: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end", first: int = 1, compat: bool = True) -> DataFrame:
    """intervals with track, by first fit in the given order within each group (closed intervals), for drawing.

    compat: an interval that wholly contains an earlier one doesn't count as meeting it, as in the published figures.
    Intervals that don't overlap never decide each other's track, so each island of overlapping ones is fitted by itself: a partition is
    sorted by islands, and a task holds one island and a batch.
    """
    schema = T.StructType([*intervals.schema.fields, T.StructField("track", T.IntegerType())])
    columns = intervals.columns
    fitting = Window.partitionBy(*keys, "island").orderBy(*[F.col(c).asc_nulls_last() for c in (order, start, end)])
    rows = islands(intervals, keys, start, end).withColumn("__place", F.row_number().over(fitting))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fitted(held: list[pa.Table]) -> list[pa.RecordBatch]:
            own = pa.concat_tables(held)
            begin = np.flatnonzero(own["__place"].to_numpy() == 1).tolist()
            s, e = (own[c].to_numpy().astype(float) for c in (start, end))
            found = [first_fit(s[a:z], e[a:z], compat) for a, z in zip(begin, [*begin[1:], len(own)], strict=True)]
            track = pa.array(np.concatenate(found) + first, pa.int32())
            return own.select(columns).append_column("track", track).combine_chunks().to_batches()

        held: list[pa.Table] = []
        for batch in batches:
            new = np.flatnonzero(batch["__place"].to_numpy() == 1)
            table = pa.Table.from_batches([batch])
            if len(new):  # the islands before the last that begins here are whole
                if held or new[-1]:
                    yield from fitted([*held, table.slice(0, new[-1])])
                held = [table.slice(new[-1])]
            else:
                held.append(table)
        if held:
            yield from fitted(held)

    return rows.drop("island").mapInArrow(fit, schema)
