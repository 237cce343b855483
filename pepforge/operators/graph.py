"""Assembly graphs: k-mers, De Bruijn contigs, greedy contigs, scaffolds and paths, all as distributed rounds of joins.

Results are sets; where the order of processing matters it is fixed by ids, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..store import kept, spread, unsaved
from . import chains as H
from . import reach as V
from . import windows as W
from .overlap import best_partner, longest_overlaps, overlap_merges, overlaps, without_contained
from .preprocess import size_over


def kmer_rows(seqs: DataFrame, k: int | str, seq: str = "seq") -> DataFrame:
    """seqs with kmer, a row for each window; the other columns stay. k may be a column."""
    n = F.lit(k) if isinstance(k, int) else F.col(k)
    return seqs.filter(F.length(seq) >= n).withColumn("kmer", F.explode(P.kmers(seq, k if isinstance(k, int) else n)))


def kmer_counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def debruijn_edges(kmers: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) from each k-mer's beginning to its end: one for each distinct k-mer."""
    return kmers.select("kmer").distinct().select(F.left("kmer", F.length("kmer") - 1).alias("src"), F.substr("kmer", F.lit(2)).alias("dst"))


def letter_edges(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """debruijn_edges of all windows of k letters (A-Z, 12 at most), which are numbers until the distinct ones are spelled."""
    kmers = W.distinct_windows(seqs, k, seq).select(W.spelled("code").alias("kmer"))
    return kmers.select(F.left("kmer", F.lit(k - 1)).alias("src"), F.substr("kmer", F.lit(2)).alias("dst"))


def letter_degrees(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """degrees of letter_edges, without the edges: an edge enters a node for each letter before it, and leaves it for each after it."""
    sides = W.neighbours(seqs, k - 1, seq)
    return sides.select(W.spelled("code").alias("node"), F.bit_count("before").cast("long").alias("n_in"), F.bit_count("after").cast("long").alias("n_out"))


#: Stands between a group and a node's letters.
MARK = "|"


def grouped_edges(kmers: DataFrame, group: str) -> DataFrame:
    """The edges of many graphs at once: nodes bear their group before their letters, so no path leads from one graph to another, and
    every contig bears its group."""
    head = F.concat(F.col(group).cast("string"), F.lit(MARK))
    own = kmers.select(group, "kmer").distinct()
    return own.select(F.concat(head, F.left("kmer", F.length("kmer") - 1)).alias("src"), F.concat(head, F.substr("kmer", F.lit(2))).alias("dst"))


def by_group(contigs: DataFrame, group: str, kind: str = "long") -> DataFrame:
    """(group, seq) of contigs of grouped edges."""
    return contigs.select(F.substring_index("seq", MARK, 1).cast(kind).alias(group), F.substring_index("seq", MARK, -1).alias("seq"))


def start_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that edges leave and none enters."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def end_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def graph_ends(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(node, kind): the start and end nodes of the sequences' De Bruijn graph, without its edges.

    A node of k - 1 letters is left by an edge wherever a letter follows it in a sequence, and entered wherever one precedes it. So
    one aggregation of the nodes' places tells both.
    """
    nodes = seqs.filter(F.length(seq) >= k).select((F.length(seq) - k + 1).alias("last"), F.posexplode(P.kmers(seq, k - 1)).alias("at", "node"))
    sides = nodes.groupBy("node").agg(F.bool_or(F.col("at") < F.col("last")).alias("left"), F.bool_or(F.col("at") > 0).alias("entered"))
    return sides.filter(F.col("left") != F.col("entered")).select("node", F.when(F.col("left"), "start").otherwise("end").alias("kind"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    out = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    return out.unionAll(into).groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def unitigs(edges: DataFrame) -> DataFrame:
    """(src, dst, label): edges with chains of inner nodes (one edge in, one out) merged by pointer doubling.

    label holds the letters that following the chain adds. A chain of n edges takes about log2(n) rounds. Cycles of inner nodes only,
    which nothing enters, have no row; their labels get no longer than twice the longest chain before the rounds end.
    """
    inner = kept(degrees(edges).filter("n_in = 1 AND n_out = 1").select("node"), "inner")
    part = edges.select("src", "dst", F.right("dst", F.lit(1)).alias("label"))
    chain = part.join(inner.select(F.col("node").alias("src"), F.lit(True).alias("inner_src")), "src", "left").join(inner.select(F.col("node").alias("dst"), F.lit(True).alias("open")), "dst", "left")
    chain = kept(chain.select("src", "dst", "label", "inner_src", F.coalesce("open", F.lit(False)).alias("open")), "chains")
    chain = H.stitched(chain).select("src", "dst", "label")
    unsaved(inner)
    return chain


def appended(runs: list[tuple[int, DataFrame]], n: int, rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """runs and rows; tables less than twice as large as what follows them are merged with it, so that there are about log2 of all rows,
    and each row is written about so often at most. No query uses it any more."""
    runs = [*runs, (n, rows)]
    while len(runs) > 1 and runs[-2][0] < 2 * runs[-1][0]:
        (a, one), (b, two) = runs[-2:]
        both = kept(one.unionByName(two), "visits")
        runs = [*runs[:-2], (a + b, both)]
    return runs


def debruijn_contigs(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(seq): one contig for each start node and end node that it reaches, along a path with the fewest branchings; of several such
    paths the alphabetically first. Components without a start node give none."""
    return V.spelled(kept(V.sided(kept(unitigs(edges), "unitigs")), "unitigs"), max_rounds)


def reachable_ends(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(start, end): the start and end nodes that a path joins."""
    return V.paired(kept(V.sided(kept(unitigs(edges), "unitigs")), "unitigs"), max_rounds)


def sequence_contigs(seqs: DataFrame, k: int, seq: str = "seq", max_rounds: int = 10_000) -> DataFrame:
    """debruijn_contigs() of all windows of k letters (A-Z) of the sequences, without their edges."""
    return V.spelled(kept(H.sequence_unitigs(seqs, k, seq), "unitigs", codec="zstd"), max_rounds)


def sequence_reach(seqs: DataFrame, k: int, seq: str = "seq", max_rounds: int = 10_000) -> DataFrame:
    """reachable_ends() of all windows of k letters (A-Z) of the sequences, without their edges."""
    return V.paired(kept(H.sequence_unitigs(seqs, k, seq), "unitigs", codec="zstd"), max_rounds)


def claimed(best: DataFrame) -> DataFrame:
    """The rows of best (a_id, b_id, ...) that go through if, in the order of a_id, each takes its partner where neither is taken.

    A row goes through once no row of a smaller a_id that shares an end with it is open; then all rows sharing an end with it fall.
    Each round settles all such rows at once.
    """
    left, won = kept(best, "claims"), None
    while left.limit(1).count():
        ends = left.select("a_id", F.explode(F.array("a_id", "b_id")).alias("end"))
        first = ends.groupBy("end").agg(F.min("a_id").alias("first"))
        ok = ends.join(first, "end").groupBy("a_id").agg(F.bool_and(F.col("first") == F.col("a_id")).alias("ok")).filter("ok").select("a_id")
        now = kept(left.join(ok, "a_id", "left_semi"), "claims")
        won = now if won is None else won.unionAll(now)
        used = now.select(F.explode(F.array("a_id", "b_id")).alias("used")).distinct()
        left = kept(left.join(used, F.col("a_id") == F.col("used"), "left_anti").join(used, F.col("b_id") == F.col("used"), "left_anti"), "claims")
    return won if won is not None else best.limit(0)


def greedy_contigs(seqs: DataFrame, min_overlap: int | str, id_col: str = "id", seq: str = "seq", max_rounds: int = 1000, by: list[str] | None = None) -> DataFrame:
    """(id, by, seq): repeats {in the order of id, every free sequence claims the one with the longest overlap (shorter than both), if
    that is free too, and both merge; merged ones come first, then those left} until nothing merges. Repeated rows are items of
    their own. by: columns that tell sets apart which are assembled at once; min_overlap may be one of them."""
    by = by or []
    items = kept(seqs.select(F.col(id_col).cast("long").alias("id"), *by, F.col(seq).alias("seq")), "items")
    for _ in range(max_rounds):
        pairs = best_partner(longest_overlaps(overlaps(items, min_overlap, inclusive=False, by=by)))
        won = kept(claimed(pairs), "claims")
        if not won.limit(1).count():
            return items
        used = won.select(F.explode(F.array("a_id", "b_id")).alias("id"))
        new = overlap_merges(won).select(F.lit(0).alias("part"), F.col("a_id").alias("id"), *by, "seq")
        rest = items.join(used, "id", "left_anti").select(F.lit(1).alias("part"), "id", *by, "seq")
        # ids keep the order of the sort, which Spark does by ranges
        items = kept(new.unionByName(rest).orderBy("part", "id").select(F.monotonically_increasing_id().alias("id"), *by, "seq"), "items")
    raise RuntimeError(f"still merging after {max_rounds} rounds")


def merges(seqs: DataFrame, min_overlap: int, seq: str = "seq") -> DataFrame:
    """(seq): for every overlap of two rows, of any length from min_overlap on, their merge; then the rows themselves."""
    own = seqs.select(F.col(seq).alias("seq"))
    ids = kept(own.withColumn("id", F.monotonically_increasing_id()), "merge-ids")
    return overlap_merges(overlaps(ids, min_overlap)).select("seq").unionAll(ids.select("seq"))


def scaffolds(contigs: DataFrame, min_overlap: int, size_threshold: int, strategy: str = "single_pass", max_rounds: int = 20, max_length: int = 100_000) -> DataFrame:
    """(seq): the distinct scaffolds of contigs (seq) longer than size_threshold that no other contains.

    single_pass: merge once; double_pass: twice; iterative and iterative_double: repeat that until the set stays the same. As cyclic
    overlaps can grow without end, more rounds than max_rounds or a longer sequence than max_length is an error.
    """
    passes = 2 if strategy in ("double_pass", "iterative_double") else 1
    if strategy not in ("single_pass", "double_pass", "iterative", "iterative_double"):
        raise ValueError(f"no such strategy: {strategy}")

    def once(held: DataFrame) -> DataFrame:
        for _ in range(passes):
            held = kept(size_over(merges(held, min_overlap).distinct(), size_threshold), "scaffolds")
        return kept(size_over(without_contained(held), size_threshold), "scaffolds")

    held = once(contigs.select("seq"))
    if not strategy.startswith("iterative"):
        return held
    for _ in range(max_rounds):
        new = once(held)
        if (new.agg(F.max(F.length("seq"))).first()[0] or 0) > max_length:
            raise RuntimeError(f"a scaffold is longer than {max_length}")
        if not new.exceptAll(held).limit(1).count() and not held.exceptAll(new).limit(1).count():
            return new
        held = new
    raise RuntimeError(f"still changing after {max_rounds} rounds")


def overlap_graph(seqs: DataFrame, min_overlap: int, seq: str = "seq") -> DataFrame:
    """(src, dst, weight): the longest overlap of each ordered pair of different sequences."""
    own = seqs.select(F.col(seq).alias("seq")).distinct().withColumn("id", F.col("seq"))
    return longest_overlaps(overlaps(own, min_overlap)).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("olap").alias("weight"))


def simple_paths(graph: DataFrame, nodes: DataFrame, max_paths: int = 1_000_000) -> DataFrame:
    """(path, spelled): every path without repeated nodes, from the single nodes on. nodes: (seq). Their number can grow exponentially;
    more than max_paths is an error."""
    front = nodes.select(F.array("seq").alias("path"), F.col("seq").alias("spelled"))
    found = None
    while True:
        front = kept(front, "paths")
        n = front.count()
        if not n:
            return found
        found = front if found is None else found.unionAll(front)
        if (max_paths := max_paths - n) < 0:
            raise RuntimeError("too many paths")
        last = F.element_at("path", -1)
        step = front.join(graph, last == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = step.select(F.concat("path", F.array("dst")).alias("path"), P.merged("spelled", "dst", "weight").alias("spelled"))


def path_scaffolds(seqs: DataFrame, min_overlap: int, prefixes: bool = False, max_paths: int = 1_000_000) -> DataFrame:
    """(seq, n): the sequences spelled by simple paths in the overlap graph of those that no other contains.

    prefixes: all paths, single nodes among them; else paths of two nodes or more, and nodes that are on none by themselves.
    """
    nodes = kept(without_contained(seqs), "nodes")
    paths = simple_paths(kept(overlap_graph(nodes, min_overlap), "overlap-graph"), nodes, max_paths)
    if not prefixes:
        on_path = paths.filter(F.size("path") > 1).select(F.explode("path").alias("on")).distinct()
        single = paths.filter(F.size("path") == 1).join(on_path, F.col("path")[0] == F.col("on"), "left_anti")
        paths = paths.filter(F.size("path") > 1).unionByName(single)
    return paths.select(F.col("spelled").alias("seq"), F.size("path").alias("n"))


def numbered(seqs: DataFrame, prefix: str, seq: str = "seq") -> DataFrame:
    """(n, name, seq, description), longest first. Assembled sequences of one run are few, so one task orders them."""
    n = F.row_number().over(Window.orderBy(F.length(seq).desc(), seq))
    out = seqs.select(F.col(seq).alias("seq")).withColumn("n", n)
    return out.select("n", F.concat(F.lit(f"{prefix}_"), F.col("n")).alias("name"), "seq", F.concat(F.lit("length: "), F.length("seq")).alias("description"))
