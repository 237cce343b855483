"""Column expressions for peptide tables and sequences; all run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(seq: Column | str) -> Column:
    """I and L weigh the same, so I becomes L (upper case only)."""
    return F.translate(col(seq), "I", "L")


def without_modifications(seq: Column | str) -> Column:
    """Drops the shortest (...) groups; of nested ones a rest stays. Null stays null."""
    return F.regexp_replace(col(seq), r"\(.*?\)", "")


def protease(experiment: Column | str, vocabulary: Iterable[str]) -> Column:
    """The first _-separated token that the vocabulary has, or null."""
    known = F.array(*[F.lit(x) for x in vocabulary])
    return F.get(F.filter(F.split(col(experiment), "_"), lambda x: F.array_contains(known, x)), F.lit(0))


def clean_log_prob(log_prob: Column | str) -> Column:
    """-1 is a sentinel for 'no prediction' and becomes -10."""
    return F.when(col(log_prob) == -1, F.lit(-10.0)).otherwise(col(log_prob))


def confidence(log_prob: Column | str) -> Column:
    return F.exp(col(log_prob))


def mapped_flag(seq: Column | str, protein: Column | str, yes: str = "True", no: str = "False") -> Column:
    """Whether the protein holds the sequence, as a string."""
    return F.when(F.contains(col(protein), col(seq)), yes).otherwise(no)


def kmers(seq: Column | str, k: int | Column) -> Column:
    """All windows of k letters, in order and with repeats; none for shorter sequences or null.

    One pass of a pattern that looks k letters ahead from every letter. Taking substrings by position would count the letters from the
    beginning for each window.
    """
    ahead = F.lit(f"(?s)(?=(.{{{k}}})).") if isinstance(k, int) else F.concat(F.lit("(?s)(?=(.{"), k.cast("string"), F.lit("}))."))
    return F.coalesce(F.regexp_extract_all(col(seq), ahead, F.lit(1)), F.array().cast("array<string>"))


def prefix(seq: Column | str, k: Column | int) -> Column:
    return F.left(col(seq), F.lit(k) if isinstance(k, int) else k)


def suffix(seq: Column | str, k: Column | int) -> Column:
    return F.right(col(seq), F.lit(k) if isinstance(k, int) else k)


def merged(a: Column | str, b: Column | str, overlap: Column | str) -> Column:
    """a followed by what b has after the overlap."""
    return F.concat(col(a), F.substr(col(b), col(overlap) + 1))


def substitution(query: Column | str, reference: Column | str) -> Column:
    """Deamidations by name, all else a mismatch. query and reference are single residues."""
    q, r = col(query), col(reference)
    return F.when((q == "D") & (r == "N"), "D_to_N").when((q == "E") & (r == "Q"), "E_to_Q").otherwise("mismatch")


def category(run: Column | str) -> Column:
    """The kind of sample, by the run's name in any case; antibodies where nothing else fits."""
    r = F.lower(col(run))
    special = F.when(r == "bsa", "bsa").when(r.startswith("nb"), "nanobodies").when(r.startswith("bind"), "binders")
    return special.when(r.startswith("pama"), "policlonals").otherwise("antibodies")


def category_cased(run: Column | str) -> Column:
    """The earlier form of category: case counts, and polyclonal runs are antibodies."""
    r = col(run)
    return F.when(r == "bsa", "bsa").when(r.startswith("NB"), "nanobodies").when(r.startswith("BIND"), "binders").otherwise("antibodies")


#: The parameters in a configuration's name, and the letters that stand for them there.
KEY_PARTS = (("conf", "c"), ("kmer_size", "ks"), ("size_threshold", "ts"), ("min_overlap", "mo"), ("min_identity", "mi"), ("max_mismatches", "mm"))


def config_key(method: str, **parts: Column | str) -> Column:
    """comb_{method}_c.._ks.._ts.._mo.._mi.._mm..; parts that aren't given (k-mer size of greedy runs) are left out."""
    own = [F.concat(F.lit(letter), col(parts[name]).cast("string")) for name, letter in KEY_PARTS if name in parts]
    return F.concat_ws("_", F.lit(f"comb_{method}"), *own)


def config_parts(key: Column | str) -> dict[str, Column]:
    """The parameters of a configuration's name as doubles; all null where the whole name doesn't fit.

    One pattern finds the name, whose parts are then split off.
    """
    found = F.regexp_extract(col(key), r"c([\d.]+)(_ks(\d+))?_ts(\d+)_mo(\d+)_mi([\d.]+)_mm(\d+)", 0)
    parts = F.split(found, "_")
    letters = dict(KEY_PARTS)
    at = {"conf": F.lit(1), "kmer_size": F.when(F.size(parts) == 6, 2), "size_threshold": F.lit(-4), "min_overlap": F.lit(-3), "min_identity": F.lit(-2), "max_mismatches": F.lit(-1)}
    part = lambda n: F.when(found != "", F.substr(F.try_element_at(parts, at[n]), F.lit(len(letters[n]) + 1)))
    return {n: part(n).try_cast("double") for n in letters}


def rounded_half_even(c: Column | str, digits: int = 3) -> Column:
    return F.bround(col(c), digits)


def label(**values: Column | str) -> Column:
    """'abbreviation=value, ...' for axes."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), col(v).cast("string")) for k, v in values.items()])


def region(seq: Column | str, start: int, end: int) -> Column:
    """The residues from start up to but not including end, counted from 0."""
    return F.substr(col(seq), F.lit(start + 1), F.lit(end - start))


def equivalent_offset(reference: Column | str, seq: Column | str) -> Column:
    """Where the sequence begins in the reference if I and L are the same, from 0; 0 if nowhere."""
    return F.greatest(F.instr(normalized(reference), normalized(seq)) - 1, F.lit(0))


def gap_runs(aligned: Column | str) -> Column:
    """The lengths of the runs of '-'."""
    return F.transform(F.regexp_extract_all(col(aligned), F.lit("-+"), F.lit(0)), lambda x: F.length(x))


def crossing_x(x1: Column, y1: Column, x2: Column, y2: Column, y: Column | float) -> Column:
    """Where the line through both points has the height y."""
    return x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
