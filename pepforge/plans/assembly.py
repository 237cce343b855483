"""The assembly workflow: from peptides to contigs, scaffolds, statistics, clusters, alignments and consensus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..operators import cluster as C
from ..operators import consensus as K
from ..operators import graph as G
from ..operators import mapping as M
from ..operators import preprocess as R
from ..operators import statistics as S
from ..store import kept

STAGES = ("psms", "contigs", "contig_map", "contig_stats", "scaffolds", "scaffold_map", "scaffold_stats", "clusters", "alignments", "pssm", "consensus", "consensus_stats")


@dataclass
class Config:
    """Settings of a run; method is dbg or greedy, strategy how scaffolds are made (by default as the method's script does)."""

    protein: str
    proteases: list[str] = field(default_factory=list)
    run: str = ""
    method: str = "dbg"
    conf: float = 0.8
    kmer_size: int = 7
    min_overlap: int = 3
    min_identity: float = 0.8
    max_mismatches: int = 20
    size_threshold: int = 20
    strategy: str | None = None

    @property
    def key(self) -> str:
        k = f"_ks{self.kmer_size}" if self.method == "dbg" else ""
        return f"comb_{self.method}_c{self.conf}{k}_ts{self.size_threshold}_mo{self.min_overlap}_mi{self.min_identity}_mm{self.max_mismatches}"


def prepared(psms: DataFrame, contaminants: DataFrame, config: Config) -> DataFrame:
    """Cleaned, decontaminated, flagged and filtered PSMs. psms: experiment_name, preds, log_probs, row_id (the input's order)."""
    clean = R.clean_psms(psms, config.proteases)
    clean = R.without_contaminants(clean, contaminants, config.run)
    return R.over_confidence(R.with_mapped(clean, P.normalized(F.lit(config.protein))), config.conf)


def contigs(psms: DataFrame, config: Config) -> DataFrame:
    """(seq): distinct contigs over the size threshold."""
    if config.method == "dbg":
        found = G.debruijn_contigs(kept(G.debruijn_edges(G.kmer_rows(psms.select(F.col("cleaned_preds").alias("seq")).distinct(), config.kmer_size)), "edges"))
    else:
        order = psms.orderBy(F.col("conf").desc(), "row_id").select(F.monotonically_increasing_id().alias("id"), F.col("cleaned_preds").alias("seq"))
        found = G.greedy_contigs(order, config.min_overlap)
    return R.size_over(found.select("seq").distinct(), config.size_threshold)


def run_assembly(psms: DataFrame, contaminants: DataFrame, config: Config, until: str = "consensus_stats") -> dict[str, DataFrame]:
    """The stages' results by name, up to the one named; those after it aren't computed."""
    protein = config.protein.replace("I", "L")
    strategy = config.strategy or ("single_pass" if config.method == "dbg" else "double_pass")
    made: dict[str, DataFrame] = {}

    def mapped(seqs: DataFrame) -> DataFrame:
        return kept(M.map_to_protein(seqs, protein, config.max_mismatches, config.min_identity), "mapped")

    steps = {
        "psms": lambda: kept(prepared(psms, contaminants, config), "psms"),
        "contigs": lambda: kept(contigs(made["psms"], config), "contigs"),
        "contig_map": lambda: mapped(made["contigs"]),
        "contig_stats": lambda: S.assembly_statistics(made["contig_map"], len(protein)),
        "scaffolds": lambda: G.scaffolds(made["contigs"], config.min_overlap, config.size_threshold, strategy),
        "scaffold_map": lambda: mapped(made["scaffolds"]),
        "scaffold_stats": lambda: S.assembly_statistics(made["scaffold_map"], len(protein)),
        "clusters": lambda: kept(C.cluster(made["scaffolds"]), "clusters"),
        "alignments": lambda: kept(C.star_alignments(made["clusters"]), "alignments"),
        "pssm": lambda: kept(K.pssm(made["alignments"], ["cluster"]), "pssm"),
        "consensus": lambda: K.consensus(made["pssm"], ["cluster"]),
        "consensus_stats": lambda: S.consensus_statistics(made["consensus"]),
    }
    for name in STAGES:
        made[name] = steps[name]()
        if name == until:
            break
    return made
