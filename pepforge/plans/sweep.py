"""Parameter sweeps as data.

Settings are rows. What a setting shares with others is computed once for all of them: k-mer graphs per confidence and k, contigs
filtered by size from those, one best place per sequence from which every limit on mismatches and identity is a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..operators import graph as G
from ..operators import mapping as M
from ..operators import preprocess as R
from ..operators import statistics as S
from ..operators.chartdata import top_sets
from ..store import kept, spread


def grid_rows(spark, grid: dict[str, list[float]]) -> DataFrame:
    """A row for each combination, by one explode a parameter."""
    rows = spark.range(1)
    for name, values in grid.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.drop("id")


def with_key(settings: DataFrame, method: str = "dbg") -> DataFrame:
    return settings.withColumn("source", P.config_key(method, **{n: n for n, _ in P.KEY_PARTS if n in settings.columns}))


#: What settings with one assembly have in common, by method.
SHARED = {"dbg": ["conf", "kmer_size"], "greedy": ["conf", "min_overlap"]}


def contigs_of(psms: DataFrame, groups: DataFrame, method: str) -> DataFrame:
    """(group, seq): the contigs of every group of settings, all assembled at once. groups: group and the columns of SHARED.

    Nodes of De Bruijn graphs bear their group; greedy rounds join sequences of one group only.
    """
    rows = psms.withColumnRenamed("conf", "own").join(spread(groups), F.col("own") > F.col("conf")).withColumn("seq", F.col("cleaned_preds"))
    if method == "dbg":
        kmers = G.kmer_rows(rows.select("group", "kmer_size", "seq").distinct(), "kmer_size")
        return G.by_group(G.debruijn_contigs(kept(G.grouped_edges(kmers, "group"), "edges")), "group")
    order = rows.orderBy(F.col("own").desc(), "row_id", "group").select(F.monotonically_increasing_id().alias("id"), "group", "min_overlap", "seq")
    return G.greedy_contigs(kept(order, "items"), "min_overlap", by=["group", "min_overlap"]).select("group", "seq").distinct()


def apart(groups: DataFrame, assemble) -> tuple[DataFrame | None, dict[int, str]]:
    """The groups' rows, assembled at once; where that fails, one group after the other, and the errors of those that fail by themselves."""
    try:
        return kept(assemble(groups), "assembled"), {}
    except Exception as failure:
        ids = [r.group for r in groups.select("group").orderBy("group").collect()]
        if len(ids) == 1:
            return None, {ids[0]: str(failure).split("\n")[0]}
    found, failed = None, {}
    for i in ids:
        part, why = apart(groups.filter(F.col("group") == i), assemble)
        failed |= why
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found, failed


def contig_sweep(psms: DataFrame, protein: str, settings: DataFrame, until: str = "contigs", method: str = "dbg") -> DataFrame:
    """Statistics of each setting (conf, kmer_size for dbg, size_threshold, min_overlap, min_identity, max_mismatches) and method.

    psms: cleaned_preds, conf, and row_id for greedy. until: contigs or scaffolds. What settings share is assembled once for all of
    them, in one plan; scaffolds once for each size_threshold and min_overlap beside that. A setting without mapped sequences has a
    row with 0 sequences; one whose assembly fails has a row with its error, and the others their results.
    """
    shared = SHARED[method]
    settings = kept(with_key(settings, method), "settings")
    reference = protein.replace("I", "L")
    groups = kept(settings.select(*shared).distinct().withColumn("group", F.row_number().over(Window.orderBy(*shared)).cast("long")), "groups")  # few
    found, failed = apart(groups, lambda g: contigs_of(psms, g, method))
    by, errors = "group", groups
    if until == "scaffolds" and found is not None:
        keys = list(dict.fromkeys(["group", "size_threshold", "min_overlap"]))
        further = settings.join(groups, shared).select(*keys).distinct()
        further = kept(further.withColumn("further", F.row_number().over(Window.orderBy(*keys)).cast("long")).withColumnsRenamed({"group": "contigs_of", "further": "group"}), "groups")
        broken = further.filter(F.col("contigs_of").isin(list(failed)))
        failed_further = {r.group: failed[r.contigs_of] for r in broken.collect()}
        contigs = found

        def scaffolds(one: DataFrame) -> DataFrame:
            made = None
            for r in one.collect():  # a row for each assembly of the grid
                own = contigs.filter(F.col("group") == r.contigs_of).select("seq")
                part = G.scaffolds(R.size_over(own, int(r.size_threshold)), int(r.min_overlap), int(r.size_threshold)).withColumn("group", F.lit(r.group))
                made = part if made is None else made.unionByName(part)
            return made

        found, failed = apart(further.join(broken, "group", "left_anti"), scaffolds)
        failed |= failed_further
        first = groups.select(F.col("group").alias("contigs_of"), *[c for c in shared if c not in keys])
        errors = further.join(first, "contigs_of").drop("contigs_of")
        shared = list(dict.fromkeys([*shared, "size_threshold", "min_overlap"]))
    spark = psms.sparkSession
    why = spark.createDataFrame([(i, e) for i, e in failed.items()], "group long, error string")
    settings = kept(settings.join(errors.select("group", *shared), shared).join(why, "group", "left"), "settings")
    if found is None:
        return settings.select("source", *[c for c in settings.columns if c not in ("group", "source")], F.lit(0).cast("long").alias("total_sequences"))
    places = kept(M.placed(found.select(F.col("seq").alias("sequence")).distinct().withColumn("protein", F.lit(reference))).drop("protein"), "places")
    rows = found.withColumnRenamed("seq", "sequence").join(places, "sequence").join(spread(settings), by)
    rows = M.within_limits(rows.filter(F.length("sequence") > F.col("size_threshold")), "max_mismatches", "min_identity")
    stats = S.assembly_statistics(rows, len(reference), ["source"])
    return settings.drop("group").join(stats, "source", "left").withColumn("total_sequences", F.coalesce("total_sequences", F.lit(0)))


def protease_sweep(psms: DataFrame, ranks: DataFrame) -> DataFrame:
    """psms with top: each row once for every i whose i most frequent proteases hold its own; so what follows is grouped by top."""
    return psms.join(spread(top_sets(ranks, "protease")), "protease")


def protease_contigs(psms: DataFrame, ranks: DataFrame, kmer_size: int) -> DataFrame:
    """(top, seq): the De Bruijn contigs of the predictions of the i most frequent proteases, for every i at once."""
    rows = protease_sweep(psms, ranks).select("top", F.col("cleaned_preds").alias("seq")).distinct()
    return G.by_group(G.debruijn_contigs(kept(G.grouped_edges(G.kmer_rows(rows, kmer_size), "top"), "edges")), "top")
