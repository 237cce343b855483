"""Operator 8, mixing sources to target weights: min-cost flow for overlapping sources.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow carries tokens from each
pattern to the sources it belongs to and on to their quotas: the first pass over a pattern's documents costs little, each
repetition more (convex), no pass beyond ``max_repeats`` is open. The flow of least cost among those that fill the quotas most tells
how many tokens every pattern gives. Documents are then selected in a seeded order: whole passes take all of them, the last pass
takes them in that order up to the flow, the document at the end in part, so that quotas are met to the word.

Only the tables of sources and of patterns (distinct sets of sources) reach the driver; both have ``max_patterns`` rows at most, which
is checked before they are sent. Whatever the number of documents, the flow works on these. What goes back is broadcast up to
``SMALL`` patterns and joined beyond. The seeded order is cut in steps: the hash range of a pattern is divided into at most 4096
parts, their sums tell the part where the flow ends, that one is divided again until a part has about ``bucket_rows`` documents, and
only these are ordered. So no pattern, however large, is one task's.

Defined results: a null source is a source of its own and comes last; a document without sources gets nothing; null or empty text
has size 0 and gives nothing; repeated rows are documents of their own; equal hashes are ordered by doc_id. Sums are of whole
words, so reruns agree. An empty table gives an empty result. ``mix`` replaces a column named taken, ``mix_documents`` also those named
size, source_size and target, in any case; all other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, saved, table
from .flow import Network

NULL_LAST = (1, "")
#: Rows of a table of patterns or sources up to which it is broadcast.
SMALL = 100_000
#: Hex digits by which a part is divided at once.
DIGITS = 3


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """share times all sizes, dealt by the weights (repeating over the sources by code point, null last); no target is above most
    times its source's size, and what exceeds that is dealt anew by weight among the others."""
    order = sorted(sizes, key=lambda s: NULL_LAST if s is None else (0, s))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    done: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    while len(done) < len(order):
        active = [s for s in order if s not in done]
        total = sum(weight[s] for s in active)
        dealt = {s: left * weight[s] / total for s in active}
        above = [s for s in active if dealt[s] > most * sizes[s]]
        if not above:
            return done | dealt
        for s in above:
            done[s] = most * sizes[s]
            left -= done[s]
    return done


def min_cost_flow(capacity: list[int], quota: list[int], member: list[tuple[int, int]], max_repeats: int) -> list[int]:
    """Tokens from each pattern. capacity: tokens of a pattern's documents; member: (pattern, source).

    A token of pass k costs more than one of pass k - 1, whatever its pattern (convex), and costs stand on the arcs into patterns only.
    A cheapest augmenting path thus uses the lowest pass that still reaches a quota, and never takes flow back from a pattern. So
    the flow of least cost is the maximum flow with one pass open, then with two, and so on, each going on from the last.
    """
    n, m = len(capacity), len(quota)
    net, most = Network(n + m + 2), sum(quota)
    start, end = n + m, n + m + 1
    passes = [net.join(start, i, 0) for i in range(n)]
    for i, j in member:
        net.join(i, n + j, most)
    for j, q in enumerate(quota):
        net.join(n + j, end, q)
    for _ in range(max_repeats):
        for arc, c in zip(passes, capacity, strict=True):
            net.room[arc] += c
        net.fill(start, end)
    return [net.room[arc ^ 1] for arc in passes]


def spread(rows: DataFrame, n: int) -> DataFrame:
    """Broadcast if it has few rows."""
    return F.broadcast(rows) if n <= SMALL else rows


def mix(docs: DataFrame, quotas=targets, max_repeats: int = 2, seed: int = 3, bucket_rows: int = 20_000, max_patterns: int = 2_000_000, sources: str = "sources", size: str = "size") -> DataFrame:
    """docs (doc_id, sources array<string>, size long, and more columns) with taken, the words that the mix takes of each.

    quotas: from the sizes of the sources to their targets. Repetitions are whole but for the last one's end; a document's taken
    words are its text repeated taken / size times. sources, size: the names of these columns.
    """
    keep = [quoted(c) for c in docs.columns if c.lower() != "taken"]
    pattern, n, order, whole, rest, cut, ahead, other, part, before = fresh(docs, "pattern", "n", "order", "whole", "rest", "cut", "ahead", "other", "part", "before")
    as_set = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("none"), s.alias("name")))))
    held = docs.select(*keep).withColumns({pattern: as_set, n: F.coalesce(F.col(size), F.lit(0)).cast("long")})
    held = held.withColumn(order, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))
    patterns = held.groupBy(F.col(pattern).alias("own")).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("n")).limit(max_patterns + 1).collect()
    if len(patterns) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = [[None if x.none else x.name for x in p.own or []] for p in patterns]
    sizes: dict[str | None, int] = {}
    for own, p in zip(names, patterns, strict=True):
        for s in own:
            sizes[s] = sizes.get(s, 0) + p.tokens
    aims = quotas(sizes)
    number = {s: i for i, s in enumerate(sizes)}
    flow = min_cost_flow([p.tokens for p in patterns], [round(aims.get(s, 0)) for s in sizes], [(i, number[s]) for i, own in enumerate(names) for s in own], max_repeats)
    digits = 1
    while 16**digits * bucket_rows < max((p.n for p in patterns), default=0):
        digits += 1
    plan = [(p.own, f // p.tokens if p.tokens else 0, f % p.tokens if p.tokens else 0, "", 0) for p, f in zip(patterns, flow, strict=True)]
    kind = held.schema[pattern].dataType.simpleString()
    cuts = docs.sparkSession.createDataFrame(plan, f"{other} {kind}, {whole} long, {rest} long, {cut} string, {ahead} long")
    same = F.col(pattern).eqNullSafe(F.col(other))
    begins = lambda: F.substring(order, 1, F.length(cut)) == F.col(cut)
    held = held.join(spread(cuts, len(plan)), same, "left").drop(other, cut, ahead)
    cuts = cuts.select(other, rest, cut, ahead)
    for upto in [*range(DIGITS, digits, DIGITS), digits]:
        # the sums of the parts of what the last cut has left open
        open_ = held.select(pattern, order, n).join(spread(cuts, len(plan)), same).filter(begins())
        sums = open_.groupBy(other, F.substring(order, 1, upto).alias(part)).agg(F.sum(n).alias(n), F.first(rest).alias(rest), F.first(ahead).alias(ahead))
        first = F.sum(n).over(Window.partitionBy(other).orderBy(part)) - F.col(n) + F.col(ahead)
        sums = sums.withColumn(before, first).filter((F.col(before) <= F.col(rest)) & (F.col(rest) < F.col(before) + F.col(n)))
        cuts = saved(sums.select(other, rest, F.col(part).alias(cut), F.col(before).alias(ahead)), "mix-cuts")
    held = held.join(spread(cuts.drop(rest), len(plan)), same, "left").drop(other)
    inside = F.coalesce(begins(), F.lit(False))
    passes = F.coalesce(F.col(whole), F.lit(0)) * F.col(n)
    outside = held.filter(~inside).withColumn("taken", passes + F.when(F.substring(order, 1, F.length(cut)) < F.col(cut), F.col(n)).otherwise(0))
    sofar = F.sum(n).over(Window.partitionBy(pattern).orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col(n) + F.col(ahead)
    ordered = held.filter(inside).withColumn(before, sofar)
    ordered = ordered.withColumn("taken", passes + F.greatest(F.lit(0), F.least(F.col(n), F.col(rest) - F.col(before))))
    return outside.select(*keep, "taken").unionByName(ordered.select(*keep, "taken"))


def source_sizes(docs: DataFrame, quotas=targets, max_sources: int = 2_000_000) -> DataFrame:
    """(source, source_size, target) of docs (source, size): one row for each source, null among them; more than max_sources are an
    error before any is sent to the driver."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r.source: r.n for r in rows}
    aims = quotas(sizes)
    return spread(docs.sparkSession.createDataFrame([(s, n, float(aims[s])) for s, n in sizes.items()], "source string, source_size long, target double"), len(sizes))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and taken."""
    made = ("size", "source_size", "target", "taken")
    own = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in made]).withColumn("size", n_words())
    sources, name = fresh(own, "sources", "name", *made[1:])[:2]
    own = saved(own.withColumn(sources, F.array(F.col("source").cast("string"))), "mix-sizes")
    sizes = source_sizes(own.select(F.col("source").cast("string").alias("source"), "size")).withColumnRenamed("source", name)
    taken = mix(own, sources=sources, **options).join(sizes, F.col("source").cast("string").eqNullSafe(F.col(name)), "left")
    return taken.select(*[quoted(c) for c in own.columns if c != sources], "source_size", "target", "taken")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text"))
    sized = docs.withColumn("size", n_words()).select("doc_id", "source", "size", F.array("source").alias("sources"))
    sized = saved(sized, "mix-sizes")
    sizes = source_sizes(sized).withColumnRenamed("source", "__s")
    mixed = mix(sized).join(sizes, F.col("source").eqNullSafe(F.col("__s")), "left")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


#: Each source is a pattern of its own here, so its flow is its target, rounded; the order within it is that of the seeded hash.
ORACLE_OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
o AS (SELECT *, 2.0 * source_size AS most, 2.0 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights FROM s),
f AS (SELECT *, ratio * (weights - coalesce(sum(weight) OVER b, 0)) + coalesce(sum(most) OVER b, 0) < whole AS full_up FROM o
  WINDOW b AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN full_up THEN most ELSE (whole - coalesce(sum(most) FILTER (WHERE full_up) OVER (), 0)) * weight / (weights - coalesce(sum(weight) FILTER (WHERE full_up) OVER (), 0)) END AS target FROM f),
q AS (SELECT *, least(CAST(round_even(target, 0) AS BIGINT), 2 * source_size) AS flow FROM t),
b AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.flow // nullif(q.source_size, 0) AS passes, q.flow % nullif(q.source_size, 0) AS rest,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id || ':3'), d.doc_id) AS BIGINT) - d.size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target, coalesce(passes * size + greatest(0, least(size, rest - before)), 0) AS taken FROM b
"""
