"""The registered queries of the assembly engine and their SQL.

Each query applies operators to whole tables, by the projections of ``views``. Where SQL can't express a query (rounds, alignments),
it has none, and tests compare it with brute force on small inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import peptides as P
from ..functions import sql as sql_functions
from ..operators import chains as H
from ..operators import chartdata as D
from ..operators import cluster as C
from ..operators import consensus as K
from ..operators import graph as G
from ..operators import mapping as M
from ..operators import overlap as O
from ..operators import preprocess as R
from ..operators import scoring as Z
from ..operators import statistics as S
from ..operators import suffixes as X
from ..operators import windows as W
from ..sources.writers import fasta_text, mapped_description, merged_tables
from ..store import kept, spread
from . import assembly, files, sweep
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# cleaning

SQL_CLEAN = f"""SELECT row_id, experiment_name, CASE WHEN log_probs = -1 THEN -10.0 ELSE log_probs END AS log_probs,
  exp(CASE WHEN log_probs = -1 THEN -10.0 ELSE log_probs END) AS conf, regexp_replace(preds, '\\(.*?\\)', '', 'g') AS cleaned_preds,
  list_filter(string_split(experiment_name, '_'), lambda x: x IN ('click', 'error', 'purchase', 'view'))[1] AS protease
  FROM {V.SQL_PSMS} WHERE preds IS NOT NULL"""


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clean_psms(V.psms(spark, sf_dir), V.PROTEASES)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned PSMs with is_mapped: whether a protein of four letters holds the sequence's last letter."""
    return R.with_mapped(cleaned(spark, sf_dir).withColumn("tail", F.right("cleaned_preds", F.lit(1))), "ADFH", seq="tail")


SQL_FLAGGED = f"(SELECT *, right(cleaned_preds, 1) IN ('A', 'D', 'F', 'H') AS is_mapped FROM ({SQL_CLEAN}))"


@query(f"SELECT row_id, protease, cleaned_preds, log_probs, round(conf, 9) AS conf, CASE WHEN contains('CLICKERRORACDVIEWDD', cleaned_preds) THEN 'True' ELSE 'False' END AS mapped FROM ({SQL_CLEAN})")
def clean_psm(spark, sf_dir):
    rows = R.with_mapped(cleaned(spark, sf_dir), "CLICKERRORACDVIEWDD")
    return rows.select("row_id", "protease", "cleaned_preds", "log_probs", F.round("conf", 9).alias("conf"), "mapped")


@query(f"SELECT row_id, round(conf, 9) AS conf, conf > 0.7 AS strictly, conf >= 0.7 AS at_least, conf BETWEEN 0.2 AND 0.9 AS inside FROM ({SQL_CLEAN}) WHERE conf > 0.2")
def conf_filter(spark, sf_dir):
    rows = R.over_confidence(cleaned(spark, sf_dir), 0.2)
    inside = {"strictly": R.over_confidence(rows, 0.7), "at_least": R.confidence_from(rows, 0.7), "inside": R.confidence_between(rows, 0.2, 0.9)}
    marks = [part.select("row_id", *[F.lit(c == name).alias(c) for c in inside]) for name, part in inside.items()]
    found = marks[0].unionAll(marks[1]).unionAll(marks[2]).groupBy("row_id").agg(*[F.bool_or(c).alias(c) for c in inside])
    return rows.select("row_id", F.round("conf", 9).alias("conf")).join(found, "row_id", "left").na.fill(False, list(inside))


@query(f"SELECT protease, count(*) AS n FROM ({SQL_CLEAN}) WHERE protease IS NOT NULL GROUP BY protease")
def protease_counts(spark, sf_dir):
    return D.value_counts(cleaned(spark, sf_dir), "protease")


@query(f"SELECT count(preds) AS valid, count(*) - count(preds) AS missing, count(*) AS total, round(100.0 * count(preds) / count(*), 2) AS valid_percent, round(100.0 * (count(*) - count(preds)) / count(*), 2) AS missing_percent FROM {V.SQL_PSMS}")
def missing_shares(spark, sf_dir):
    return D.missing_shares(V.psms(spark, sf_dir), "preds")


@query(f"SELECT d.id, d.n, d.seq FROM {V.sql_sentences('documents', 'doc_id')} d WHERE NOT EXISTS (SELECT 1 FROM {V.SQL_PROTEINS} p WHERE contains(p.protein, d.seq))")
def decontaminate_psms(spark, sf_dir, least=12):
    held = V.proteins(spark, sf_dir).select(F.col("protein").alias("seq"), F.lit("").alias("description"))
    return R.without_contaminants(V.sentences(spark, sf_dir, "documents", "doc_id", least), held, seq="seq", seed=8)


# graphs

DOC_KMERS = "(SELECT DISTINCT substr(seq, i, 8) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - 7)) AS i FROM {} WHERE length(seq) >= 8))"
DOC_SENTENCES = V.sql_sentences("documents", "doc_id")
SQL_EDGES = "(SELECT DISTINCT left(kmer, 7) AS src, substr(kmer, 2) AS dst FROM {})"


@query(f"""WITH e AS {SQL_EDGES.format(DOC_KMERS.format(DOC_SENTENCES))}
SELECT DISTINCT src AS node, 'start' AS kind FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT DISTINCT dst, 'end' FROM e WHERE dst NOT IN (SELECT src FROM e)""")
def assembly_graph_ends(spark, sf_dir, least=12):
    """Which 7-mers start and end the De Bruijn graph of the documents' sentences of at least so many letters."""
    return G.graph_ends(V.sentences(spark, sf_dir, "documents", "doc_id", least), 8)


@query(f"SELECT substr(seq, i, 4) AS kmer, count(*) AS n FROM (SELECT seq, unnest(generate_series(1, length(seq) - 3)) AS i FROM (SELECT {V.SQL_LETTERS.format('text')} AS seq FROM documents) WHERE length(seq) >= 4) GROUP BY 1")
def kmer_counts(spark, sf_dir):
    return G.kmer_counts(G.kmer_rows(V.documents(spark, sf_dir), 4).select("kmer"))


PEPTIDE_EDGES = SQL_EDGES.format(DOC_KMERS.format(V.SQL_PEPTIDES).replace("- 7)", "- 11)").replace(">= 8", ">= 12").replace("i, 8)", "i, 12)")).replace("kmer, 7)", "kmer, 11)")


def peptide_edges(spark, sf_dir, rows=V.peptides) -> DataFrame:
    return kept(G.letter_edges(rows(spark, sf_dir), 12), "edges")


@query(f"SELECT src, dst FROM {PEPTIDE_EDGES}")
def dbg_edges(spark, sf_dir, rows=V.peptides):
    return G.letter_edges(rows(spark, sf_dir), 12)


@query(f"WITH e AS {PEPTIDE_EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def dbg_degrees(spark, sf_dir, rows=V.peptides):
    return G.letter_degrees(rows(spark, sf_dir), 12)


@query(f"""WITH RECURSIVE e AS {PEPTIDE_EDGES},
r(s, node) AS (SELECT DISTINCT src, src FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.node)
SELECT s AS "start", node AS "end" FROM r WHERE node NOT IN (SELECT src FROM e)""")
def dbg_reach_pairs(spark, sf_dir, rows=V.peptides):
    return G.reachable_ends(peptide_edges(spark, sf_dir, rows))


@query(f"""WITH RECURSIVE e AS {PEPTIDE_EDGES},
inner_nodes AS (SELECT node FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node HAVING sum(i) = 1 AND sum(o) = 1),
r(s, node, seq, turns, path) AS (SELECT DISTINCT src, src, src, 0, [src] FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL
  SELECT r.s, e.dst, r.seq || right(e.dst, 1), r.turns + CASE WHEN e.dst IN (SELECT node FROM inner_nodes) THEN 0 ELSE 1 END, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE NOT list_contains(r.path, e.dst))
SELECT DISTINCT seq FROM (SELECT seq, row_number() OVER (PARTITION BY s, node ORDER BY turns, seq) AS place FROM r WHERE node NOT IN (SELECT src FROM e)) WHERE place = 1""")
def dbg_contigs(spark, sf_dir, rows=V.peptides):
    return G.debruijn_contigs(peptide_edges(spark, sf_dir, rows))


@query()
def greedy_contigs(spark, sf_dir, rows=V.peptides):
    return G.greedy_contigs(rows(spark, sf_dir), 4)


SQL_OVERLAPS = """(SELECT a.id AS a_id, b.id AS b_id, a.seq AS a, b.seq AS b, CAST(k AS INT) AS olap FROM {0} a JOIN {0} b ON a.id <> b.id, LATERAL (SELECT unnest(generate_series({1}, least(length(a.seq), length(b.seq)))) AS k)
  WHERE right(a.seq, k) = left(b.seq, k))"""
PEPTIDE_OVERLAPS = SQL_OVERLAPS.format(V.SQL_PEPTIDES, 4)


@query(f"SELECT a_id, b_id, olap, a || substr(b, olap + 1) AS seq FROM {PEPTIDE_OVERLAPS}")
def overlaps_all(spark, sf_dir, rows=V.peptides):
    return O.overlap_merges(O.overlaps(rows(spark, sf_dir), 4)).select("a_id", "b_id", "olap", "seq")


@query(f"SELECT a_id, b_id, olap FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY olap DESC, b_id) AS r FROM {PEPTIDE_OVERLAPS} WHERE olap < least(length(a), length(b))) WHERE r = 1")
def overlaps_best(spark, sf_dir, rows=V.peptides):
    pairs = O.overlaps(rows(spark, sf_dir), 4, inclusive=False)
    return O.best_partner(O.longest_overlaps(pairs)).select("a_id", "b_id", "olap")


@query(f"SELECT a AS src, b AS dst, max(olap) AS weight FROM {PEPTIDE_OVERLAPS} WHERE a <> b GROUP BY a, b")
def overlap_graph(spark, sf_dir, rows=V.peptides):
    return G.overlap_graph(rows(spark, sf_dir), 4)


SQL_MERGED = f"(SELECT a || substr(b, olap + 1) AS seq FROM {PEPTIDE_OVERLAPS} UNION SELECT seq FROM {V.SQL_PEPTIDES})"


@query(f"WITH m AS (SELECT seq FROM {SQL_MERGED} WHERE length(seq) > 20) SELECT seq FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.seq <> m.seq AND contains(o.seq, m.seq))")
def scaffold_single(spark, sf_dir, rows=V.peptides):
    return G.scaffolds(rows(spark, sf_dir), 4, 20)


@query(f"""WITH m AS (SELECT row_number() OVER (ORDER BY seq) AS id, seq FROM {SQL_MERGED} WHERE length(seq) > 20),
p AS (SELECT right(seq, k) AS affix, k, id, seq FROM m, LATERAL (SELECT unnest(generate_series(4, length(seq))) AS k)),
q AS (SELECT left(seq, k) AS affix, k, id, seq FROM m, LATERAL (SELECT unnest(generate_series(4, length(seq))) AS k)),
n AS (SELECT p.seq || substr(q.seq, CAST(q.k AS INT) + 1) AS seq FROM p JOIN q ON p.affix = q.affix AND p.id <> q.id UNION SELECT seq FROM m),
d AS (SELECT DISTINCT seq FROM n WHERE length(seq) > 20)
SELECT seq FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.seq <> d.seq AND contains(o.seq, d.seq))""")
def scaffold_double(spark, sf_dir, rows=V.peptides):
    return G.scaffolds(rows(spark, sf_dir), 4, 20, "double_pass")


SQL_WORDS = f"(SELECT DISTINCT {V.SQL_LETTERS.format('w')} AS seq FROM (SELECT unnest(string_split_regex(text, '[ .\\n]')) AS w FROM benchmark) UNION SELECT seq FROM {V.SQL_PEPTIDES})"


@query(f"WITH s AS {SQL_WORDS} SELECT seq FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.seq <> s.seq AND contains(o.seq, s.seq))")
def containment_antijoin(spark, sf_dir):
    words = V.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ .\n]")).alias("w")).select(V.letters("w").alias("seq"))
    return O.without_contained(words.unionByName(V.peptides(spark, sf_dir).select("seq")))


#: The longest stretch of b from j on that is also in a from i on.
SQL_STRETCH = "list_max(list_filter(generate_series(8, least(length(a) - i, length(b) - j)), lambda k: substr(a, CAST(i AS INT) + 1, CAST(k AS INT)) = substr(b, CAST(j AS INT) + 1, CAST(k AS INT))))"
SQL_PLACES_OF_B = f"(SELECT a.id AS a_id, b.id AS b_id, a.seq AS a, b.seq AS b, unnest(generate_series(0, length(b.seq) - 8)) AS j FROM {V.SQL_PEPTIDES} a JOIN {V.SQL_PEPTIDES} b ON {{}} WHERE length(a.seq) >= 8 AND length(b.seq) >= 8)"
SQL_SEEDED = f"""(SELECT a_id, b_id, a, b, CAST(n AS INT) AS n, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY n DESC, j) AS place FROM (
  SELECT *, {SQL_STRETCH} AS n FROM (SELECT *, instr(a, substr(b, CAST(j AS INT) + 1, 8)) - 1 AS i FROM {SQL_PLACES_OF_B.format('a.id < b.id')}) WHERE i >= 0)) WHERE place = 1)"""
SQL_LONGEST = f"""(SELECT a_id AS small_id, b_id AS large_id, a AS small, b AS large, CAST(n AS INT) AS n, CAST(i AS INT) AS small_at, CAST(j AS INT) AS large_at FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY n DESC, i, j) AS place FROM (
  SELECT *, {SQL_STRETCH} AS n FROM (SELECT *, unnest(generate_series(0, length(a) - 8)) AS i FROM {SQL_PLACES_OF_B.format('length(a.seq) < length(b.seq) OR length(a.seq) = length(b.seq) AND a.id > b.id')})
  WHERE substr(a, CAST(i AS INT) + 1, 8) = substr(b, CAST(j AS INT) + 1, 8))) WHERE place = 1)"""


def sql_crossed(found: str, a: str, b: str, i: str, j: str) -> str:
    kinds = {"first": a, "second": b, "first_second": f"left({a}, {i} + n) || substr({b}, {j} + n + 1)", "second_first": f"left({b}, {j} + n) || substr({a}, {i} + n + 1)"}
    every = " UNION ALL ".join(f"SELECT {seq} AS seq, '{kind}' AS kind FROM f" for kind, seq in kinds.items())
    return f"WITH f AS {found} SELECT seq, kind, count(*) AS n FROM ({every}) GROUP BY seq, kind"


@query(f"SELECT * FROM {SQL_SEEDED}")
def seeded_overlaps(spark, sf_dir, rows=V.peptides):
    return O.seeded_overlap(rows(spark, sf_dir), 8)


@query(f"SELECT * FROM {SQL_LONGEST}")
def longest_common_runs(spark, sf_dir, rows=V.peptides):
    return O.best_common_run(rows(spark, sf_dir), 8)


@query(sql_crossed(SQL_SEEDED, "a", "b", "i", "j"))
def recombined(spark, sf_dir, rows=V.peptides):
    return O.recombined(rows(spark, sf_dir), 8).groupBy("seq", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(sql_crossed(SQL_LONGEST, "small", "large", "small_at", "large_at"))
def recombined_by_longest_run(spark, sf_dir, rows=V.peptides):
    return O.recombined_by_longest_run(rows(spark, sf_dir), 8).groupBy("seq", "kind").agg(F.count(F.lit(1)).alias("n"))


SQL_PATHS = f"""WITH RECURSIVE p AS (SELECT DISTINCT seq FROM {V.SQL_PEPTIDES}), nodes AS (SELECT seq FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.seq <> p.seq AND contains(o.seq, p.seq))),
g AS (SELECT a.seq AS src, b.seq AS dst, CAST(max(k) AS INT) AS w FROM nodes a JOIN nodes b ON a.seq <> b.seq, LATERAL (SELECT unnest(generate_series(8, least(length(a.seq), length(b.seq)))) AS k)
  WHERE right(a.seq, k) = left(b.seq, k) GROUP BY 1, 2),
r(path, tail, spelled) AS (SELECT [seq], seq, seq FROM nodes UNION ALL SELECT list_append(path, dst), dst, spelled || substr(dst, w + 1) FROM r JOIN g ON g.src = r.tail WHERE NOT list_contains(path, dst))
"""


@query(f"{SQL_PATHS} SELECT spelled AS seq, CAST(len(path) AS INT) AS n FROM r WHERE len(path) > 1 OR path[1] NOT IN (SELECT unnest(path) FROM r WHERE len(path) > 1)")
def path_scaffolds(spark, sf_dir, rows=V.peptides):
    return G.path_scaffolds(rows(spark, sf_dir), 8)


@query(f"{SQL_PATHS} SELECT spelled AS seq, CAST(len(path) AS INT) AS n FROM r")
def path_prefix_scaffolds(spark, sf_dir, rows=V.peptides):
    return G.path_scaffolds(rows(spark, sf_dir), 8, prefixes=True)


# mapping

SQL_NAMES = f"(SELECT DISTINCT {V.SQL_LETTERS.format('p_name')} AS seq FROM part)"
SQL_PLACES = f"""(SELECT item_id, seq, protein, arg_min(struct_pack(s := s, wrong := wrong), len(wrong) * 100000 + s) AS b FROM (
  SELECT item_id, seq, protein, s, list_filter(generate_series(0, length(seq) - 1), lambda i: substr(seq, CAST(i AS INT) + 1, 1) <> substr(protein, CAST(s + i AS INT) + 1, 1)) AS wrong
  FROM (SELECT *, unnest(generate_series(0, length(protein) - length(seq))) AS s FROM {SQL_NAMES}, {V.SQL_PROTEINS} WHERE length(seq) BETWEEN 1 AND length(protein)))
  GROUP BY item_id, seq, protein)"""


def name_places(spark, sf_dir) -> DataFrame:
    names = V.table(spark, sf_dir, "part").select(V.letters("p_name").alias("seq")).distinct()
    return M.native_places(names, V.proteins(spark, sf_dir))


@query(f"SELECT item_id, seq, CAST(b.s AS INT) AS \"start\", CAST(b.s + length(seq) AS INT) AS \"end\", array_to_string(b.wrong, ',') AS mismatches, round((length(seq) - len(b.wrong)) / length(seq), 9) AS identity_score FROM {SQL_PLACES}")
def hamming_map(spark, sf_dir):
    return name_places(spark, sf_dir).select("item_id", "seq", "start", "end", F.array_join(F.col("mismatches_pos").cast("array<string>"), ",").alias("mismatches"), F.round("identity_score", 9).alias("identity_score"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN q = 'D' AND r = 'N' THEN 'D_to_N' WHEN q = 'E' AND r = 'Q' THEN 'E_to_Q' ELSE 'mismatch' END AS kind
  FROM (SELECT substr(seq, CAST(i AS INT) + 1, 1) AS q, substr(protein, CAST(s + i AS INT) + 1, 1) AS r FROM (SELECT seq, protein, b.s AS s, unnest(b.wrong) AS i FROM {SQL_PLACES}))) GROUP BY kind""")
def substitution_kinds(spark, sf_dir):
    return M.substitutions(name_places(spark, sf_dir), seq="seq").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT item_id, seq AS sequence, CAST(b.s AS INT) AS "start", CAST(b.s + length(seq) AS INT) AS "end", array_to_string(b.wrong, ',') AS mismatches, (length(seq) - len(b.wrong)) / length(seq) AS identity_score
  FROM {SQL_PLACES} WHERE len(b.wrong) <= 12 AND (length(seq) - len(b.wrong)) / length(seq) >= 0.2 AND length(seq) > len(b.wrong)""")
def protein_map(spark, sf_dir):
    """Part names placed on every benchmark text by the vectorised search, within 12 mismatches and from 20 percent identity."""
    names = V.table(spark, sf_dir, "part").select(V.letters("p_name").alias("sequence")).distinct()
    return M.within_limits(M.placed(names.join(spread(V.proteins(spark, sf_dir)))), 12, 0.2).select("item_id", "sequence", "start", "end", F.array_join(F.col("mismatches_pos").cast("array<string>"), ",").alias("mismatches"), "identity_score")


@query(f"""SELECT item_id, id, seq, CAST("start" AS INT) AS "start", CAST(n AS INT) AS n_mismatches FROM (SELECT *, row_number() OVER (PARTITION BY item_id, id ORDER BY n, "start") AS place FROM (
  SELECT item_id, id, seq, s AS "start", hamming(substr(protein, CAST(s AS INT) + 1, length(seq)), seq) AS n FROM (
    SELECT *, unnest(generate_series(0, length(protein) - length(seq))) AS s FROM {V.SQL_PEPTIDES}, {V.SQL_PROTEINS} WHERE length(seq) <= length(protein))) WHERE n <= 3) WHERE place = 1""")
def seeded_map(spark, sf_dir):
    """The sentences of benchmark on its whole texts with at most 3 mismatches, by equi-joins of pieces."""
    found = M.seeded_places(V.peptides(spark, sf_dir), V.proteins(spark, sf_dir), 3)
    return found.select("item_id", "id", "seq", "start", F.size("mismatches_pos").alias("n_mismatches"))


@query(f"""SELECT seq AS sequence, b.item_id AS item_id, CAST(b.s AS INT) AS "start", CAST(b.n AS INT) AS n_mismatches FROM (SELECT seq, min(b) AS b FROM (
  SELECT seq, list_min(list_transform(generate_series(0, length(protein) - length(seq)), lambda s: {{'n': hamming(substr(protein, CAST(s AS INT) + 1, length(seq)), seq), 'item_id': item_id, 's': s}})) AS b
  FROM (SELECT DISTINCT {V.SQL_LETTERS.format('p_name')} AS seq FROM part), {V.SQL_PROTEINS} WHERE length(seq) BETWEEN 1 AND length(protein)) GROUP BY seq) WHERE b.n < length(seq)""")
def nearest_map(spark, sf_dir):
    """Each part name at its best place on any benchmark text, with no limit on mismatches."""
    names = V.table(spark, sf_dir, "part").select(V.letters("p_name").alias("seq"))
    found = M.nearest_places(names, V.proteins(spark, sf_dir), "item_id")
    return found.select(F.col("seq").alias("sequence"), "item_id", "start", F.size("mismatches_pos").alias("n_mismatches"))


@query(f"""SELECT item_id, '>' || item_id || ' length: ' || length(seq) || ' start: ' || "start" || ' end: ' || ("start" + length(seq)) || ' mismatches: ' || n || printf(' identity: %.2f', (length(seq) - n) / length(seq)) || chr(10) || array_to_string(regexp_extract_all(seq, '.{{1,60}}'), chr(10)) AS record
  FROM (SELECT item_id, seq, b.s AS "start", len(b.wrong) AS n FROM {SQL_PLACES}) WHERE n <= 12 AND (length(seq) - n) / length(seq) >= 0.2""")
def mapped_fasta_records(spark, sf_dir):
    """The records of mapped sequences, whose descriptions tell where and how well they fit."""
    places = M.within_limits(name_places(spark, sf_dir).withColumnRenamed("seq", "sequence"), 12, 0.2)
    return places.select("item_id", fasta_text(F.col("item_id").cast("string"), mapped_description(), "sequence").alias("record"))


SQL_COVERED = "(SELECT grp, count(DISTINCT p) AS covered FROM (SELECT grp, unnest(generate_series({}, \"end\" - 1)) AS p FROM " + V.SQL_INTERVALS + ") GROUP BY grp)"


@query(f"SELECT grp, covered FROM {SQL_COVERED.format('start')}")
def coverage(spark, sf_dir):
    return M.covered_length(V.intervals(spark, sf_dir), ["grp"])


@query(f"SELECT grp, CAST(p AS INT) AS position, count(*) AS depth FROM (SELECT grp, unnest(generate_series(\"start\", \"end\" - 1)) AS p FROM {V.SQL_INTERVALS}) GROUP BY grp, p")
def depth(spark, sf_dir):
    return M.depth(V.intervals(spark, sf_dir), ["grp"])


SQL_NX = """(SELECT grp, CAST(max(CASE WHEN s >= 0.5 * t THEN n END) AS INT) AS "N50", CAST(max(CASE WHEN s >= 0.9 * t THEN n END) AS INT) AS "N90" FROM (
  SELECT grp, n, sum(n) OVER (PARTITION BY grp ORDER BY n DESC) AS s, sum(n) OVER (PARTITION BY grp) AS t FROM (SELECT grp, "end" - "start" + {} AS n FROM """ + V.SQL_INTERVALS + ")) GROUP BY grp)"


@query(f"SELECT * FROM {SQL_NX.format(0)}")
def n50(spark, sf_dir):
    return S.n_statistic(V.intervals(spark, sf_dir).withColumn("length", F.col("end") - F.col("start")), ["grp"])


def sql_stats(shift: int) -> str:
    return f"""SELECT b.*, n."N50", n."N90", coalesce(o.total_mismatches, 0) AS total_mismatches, 0 AS reference_start, {600 + shift} AS reference_end, round(c.covered / {600.0 + shift}, 9) AS coverage FROM (
  SELECT grp, count(*) AS total_sequences, round(avg("end" - "start" + {shift}), 9) AS average_length, min("end" - "start" + {shift}) AS min_length, max("end" - "start" + {shift}) AS max_length,
    round(avg(identity_score), 9) AS mean_identity, round(median(identity_score), 9) AS median_identity, count(*) FILTER (WHERE len(mismatches_pos) = 0) AS perfect_matches FROM {V.SQL_INTERVALS} GROUP BY grp) b
  JOIN {SQL_NX.format(shift)} n USING (grp) JOIN {SQL_COVERED.format(f'"start" - {shift}')} c USING (grp)
  LEFT JOIN (SELECT grp, count(DISTINCT m) AS total_mismatches FROM (SELECT grp, unnest(mismatches_pos) AS m FROM {V.SQL_INTERVALS}) GROUP BY grp) o USING (grp)"""


def group_stats(spark, sf_dir, strict: bool) -> DataFrame:
    out = S.assembly_statistics(V.intervals(spark, sf_dir), 600, ["grp"], strict)
    return out.withColumns({c: F.round(c, 9) for c in ("average_length", "mean_identity", "median_identity", "coverage")})


@query(sql_stats(1))
def assembly_stats(spark, sf_dir):
    return group_stats(spark, sf_dir, False)


@query(sql_stats(0))
def assembly_stats_strict(spark, sf_dir):
    return group_stats(spark, sf_dir, True)


@query()
def interval_tracks(spark, sf_dir):
    return M.tracks(V.intervals(spark, sf_dir).select("grp", "id", "start", "end"), ["grp"], "id")


# alignments

SQL_COUNTS = f"(SELECT aln, CAST(i AS INT) AS pos, substr(aligned, CAST(i AS INT), 1) AS aa, count(*) AS n FROM (SELECT aln, aligned, unnest(generate_series(1, length(aligned))) AS i FROM {V.SQL_ALIGNED}) GROUP BY 1, 2, 3)"
SQL_PSSM = f"(SELECT t.aln, t.pos, r.aa, coalesce(r.n / t.total, 0.0) AS freq FROM (SELECT aln, pos, sum(n) FILTER (WHERE aa <> '-') AS total FROM {SQL_COUNTS} GROUP BY aln, pos) t LEFT JOIN (SELECT * FROM {SQL_COUNTS} WHERE aa <> '-') r ON t.aln = r.aln AND t.pos = r.pos)"
SQL_CONSENSUS = f"(SELECT aln, string_agg(aa, '' ORDER BY pos) AS seq FROM (SELECT aln, pos, CASE WHEN max(freq) > 0.6 THEN arg_max(aa, freq) ELSE '-' END AS aa FROM {SQL_PSSM} GROUP BY aln, pos) GROUP BY aln)"


@query(f"SELECT aln, pos, aa, round(freq, 9) AS freq FROM {SQL_PSSM}")
def pssm(spark, sf_dir):
    return K.pssm(V.aligned(spark, sf_dir), ["aln"]).withColumn("freq", F.round("freq", 9))


@query(f"SELECT aln, seq FROM {SQL_CONSENSUS}")
def consensus(spark, sf_dir):
    return K.consensus(K.pssm(V.aligned(spark, sf_dir), ["aln"]), ["aln"])


@query(f"""SELECT aln, count(*) AS n_fasta_files, CAST(max(list_max(g)) AS INT) AS longest_gap, CAST(min(list_min(g)) AS INT) AS shortest_gap, round(100 * avg(CASE WHEN len(g) = 0 THEN 1.0 ELSE 0.0 END), 2) AS percent_without_gaps,
  CAST(max(n) AS INT) AS max_consensus_length, CAST(min(n) AS INT) AS min_consensus_length, round(avg(n), 2) AS avg_consensus_length
  FROM (SELECT aln, length(aligned) AS n, list_transform(regexp_extract_all(aligned, '-+'), lambda x: length(x)) AS g FROM {V.SQL_ALIGNED}) GROUP BY aln""")
def consensus_stats(spark, sf_dir):
    return S.consensus_statistics(V.aligned(spark, sf_dir), ["aln"], "aligned")


@query()
def sequence_clusters(spark, sf_dir, rows=V.peptides):
    return C.cluster(rows(spark, sf_dir))


@query()
def cluster_consensus(spark, sf_dir, rows=V.peptides):
    """Clusters, their star alignments and the alignments' consensus."""
    members = kept(C.cluster(rows(spark, sf_dir)), "clusters")
    return K.consensus(K.pssm(C.star_alignments(members), ["cluster"]), ["cluster"])


@query(f"SELECT id, '>pep_' || id || ' length: ' || length(seq) || chr(10) || array_to_string(regexp_extract_all(seq, '.{{1,60}}'), chr(10)) AS record FROM {V.SQL_PEPTIDES}")
def fasta_records(spark, sf_dir, rows=V.peptides):
    return rows(spark, sf_dir).select("id", fasta_text(F.concat(F.lit("pep_"), "id"), F.concat(F.lit("length: "), F.length("seq")), "seq").alias("record"))


# scores

SQL_SCALED = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN 0.0 ELSE ({0} - min({0}) OVER w) / nullif(max({0}) OVER w - min({0}) OVER w, 0) END"
SQL_COMPOSITE = f"""(SELECT *, 0.1 * total_sequences_scaled + 0.1 * max_length_scaled + 0.3 * "N50_scaled" + 0.5 * coverage_scaled AS composite_score FROM (
  SELECT *, 1 - {SQL_SCALED.format('total_sequences')} AS total_sequences_scaled, {SQL_SCALED.format('max_length')} AS max_length_scaled, {SQL_SCALED.format('"N50"')} AS "N50_scaled", {SQL_SCALED.format('coverage')} AS coverage_scaled
  FROM {V.SQL_SCORES} WINDOW w AS (PARTITION BY ass_method)))"""


@query(f'SELECT run, ass_method, source, total_sequences, max_length, "N50", coverage, round(total_sequences_scaled, 9) AS total_sequences_scaled, round(max_length_scaled, 9) AS max_length_scaled, round("N50_scaled", 9) AS "N50_scaled", round(coverage_scaled, 9) AS coverage_scaled, round(composite_score, 9) AS composite_score FROM {SQL_COMPOSITE}')
def composite_scores(spark, sf_dir):
    out = Z.composite_scores(V.scores(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith(("_scaled", "_score"))})


SQL_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, source) AS r FROM (SELECT run, source, round(composite_score, 9) AS score FROM {SQL_COMPOSITE})) WHERE r = 1)"


def best_runs(spark, sf_dir) -> DataFrame:
    scored = Z.scored(V.scores(spark, sf_dir)).select("run", "source", F.round("composite_score", 9).alias("composite_score"))
    return Z.best_per(scored, ["run"], "composite_score", "source")


@query(f"SELECT run, source, score AS composite_score FROM {SQL_BEST}")
def best_per_run(spark, sf_dir):
    return best_runs(spark, sf_dir)


SQL_CATEGORY = "CASE WHEN lower({0}) = 'bsa' THEN 'bsa' WHEN lower({0}) LIKE 'nb%' THEN 'nanobodies' WHEN lower({0}) LIKE 'bind%' THEN 'binders' WHEN lower({0}) LIKE 'pama%' THEN 'policlonals' ELSE 'antibodies' END"
PATTERN = r"c([\d.]+)(?:_ks(\d+))?_ts(\d+)_mo(\d+)_mi([\d.]+)_mm(\d+)"
SQL_PARTS = ", ".join(f"TRY_CAST(regexp_extract(source, '{PATTERN}', {i + 1}) AS DOUBLE) AS {n}" for i, (n, _) in enumerate(P.KEY_PARTS))


@query(f"SELECT DISTINCT source, {SQL_PARTS} FROM {V.SQL_SCORES}")
def config_keys(spark, sf_dir):
    return Z.with_config(V.scores(spark, sf_dir).select("source").distinct())


@query(f"SELECT DISTINCT run, {SQL_CATEGORY.format('run')} AS category, CASE WHEN run = 'bsa' THEN 'bsa' WHEN run LIKE 'NB%' THEN 'nanobodies' WHEN run LIKE 'BIND%' THEN 'binders' ELSE 'antibodies' END AS cased FROM {V.SQL_SCORES}")
def categories(spark, sf_dir):
    return V.scores(spark, sf_dir).select("run").distinct().select("run", P.category("run").alias("category"), P.category_cased("run").alias("cased"))


def sql_mode(column: str) -> str:
    return f"(SELECT arg_max(v, n * 1000000 - v) FROM (SELECT {column} AS v, count(*) AS n FROM p q WHERE q.category = p.category AND {column} IS NOT NULL GROUP BY 1)) AS {column}_mode"


@query(f"WITH p AS (SELECT {SQL_CATEGORY.format('run')} AS category, {SQL_PARTS} FROM {SQL_BEST}) SELECT category, {', '.join(sql_mode(n) for n, _ in P.KEY_PARTS)} FROM (SELECT DISTINCT category FROM p) p")
def param_modes(spark, sf_dir):
    return Z.best_config_modes(best_runs(spark, sf_dir).withColumn("category", P.category("run")))


@query(f"""WITH s AS (SELECT *, {SQL_PARTS} FROM {V.SQL_SCORES}), c AS (SELECT conf, min_overlap, size_threshold, max_mismatches, max(coverage) AS v FROM s GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT conf, min_overlap FROM c), (SELECT DISTINCT size_threshold, max_mismatches FROM c))
SELECT g.*, round(coalesce(c.v, avg(c.v) OVER (PARTITION BY g.conf)), 9) AS coverage FROM g LEFT JOIN c USING (conf, min_overlap, size_threshold, max_mismatches)""")
def pivot_filled(spark, sf_dir):
    rows = Z.with_config(V.scores(spark, sf_dir))
    return Z.pivot_max_filled(rows, ["conf", "min_overlap"], ["size_threshold", "max_mismatches"], "coverage").withColumn("coverage", F.round("coverage", 9))


@query(f"SELECT run, max(coverage) FILTER (WHERE ass_method = 'dbg') AS dbg, max(coverage) FILTER (WHERE ass_method = 'greedy') AS greedy FROM {V.SQL_SCORES} GROUP BY run")
def pivot_wide(spark, sf_dir):
    return Z.pivot_max(V.scores(spark, sf_dir), ["run"], ["ass_method"], "coverage", ["dbg", "greedy"])


@query(f"""WITH m AS (SELECT regexp_extract(run, '^(pama|ma)(\\d+)(heavy|light)$', 1) AS kind, regexp_extract(run, '^(pama|ma)(\\d+)(heavy|light)$', 2) AS idx, regexp_extract(run, '^(pama|ma)(\\d+)(heavy|light)$', 3) AS chain, coverage FROM {V.SQL_SCORES}),
b AS (SELECT idx, chain, max(coverage) FILTER (WHERE kind = 'ma') AS mono, max(coverage) FILTER (WHERE kind = 'pama') AS poly FROM m WHERE kind <> '' GROUP BY idx, chain HAVING mono IS NOT NULL AND poly IS NOT NULL)
SELECT idx, chain, mono, poly FROM b WHERE idx IN (SELECT idx FROM b GROUP BY idx HAVING count(*) = 2)""")
def paired_runs(spark, sf_dir):
    return Z.paired_runs(V.scores(spark, sf_dir), score="coverage")


@query(f"SELECT w.i AS \"order\", w.run, coalesce(max(s.coverage), 0.0) AS coverage FROM (SELECT unnest([0, 1, 2]) AS i, unnest(['NB1', 'none', 'bsa']) AS run) w LEFT JOIN {V.SQL_SCORES} s ON s.run = w.run GROUP BY ALL")
def wanted_order(spark, sf_dir):
    return Z.in_order(Z.max_per(V.scores(spark, sf_dir), "run", "coverage"), ["NB1", "none", "bsa"], "run")


# figures

@query(f"SELECT CAST(least(floor(conf / 0.025), 39) AS INT) AS bin, count(*) AS n FROM ({SQL_CLEAN}) WHERE conf BETWEEN 0 AND 1 GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return D.histogram(cleaned(spark, sf_dir), "conf", 0.0, 1.0, 40)


@query(f"SELECT is_mapped, CAST(least(floor(conf / 0.01), 99) AS INT) AS bin, count(*) AS n FROM {SQL_FLAGGED} WHERE conf BETWEEN 0 AND 1 GROUP BY 1, 2")
def mapped_histogram(spark, sf_dir):
    return D.histogram(flagged(spark, sf_dir), "conf", 0.0, 1.0, 100, ["is_mapped"])


SQL_RATIO = f"(SELECT CAST(floor(conf * 20) AS INT) AS bin, count(*) FILTER (WHERE is_mapped) AS mapped, count(*) FILTER (WHERE NOT is_mapped) AS unmapped, count(*) AS n FROM {SQL_FLAGGED} WHERE conf >= 0 AND conf < 1 GROUP BY 1)"


@query(f"SELECT bin, mapped, unmapped, n, round(mapped / nullif(unmapped, 0), 9) AS ratio, (bin + 0.5) / 20 AS centre FROM {SQL_RATIO}")
def ratio_bins(spark, sf_dir):
    return D.ratio_bins(flagged(spark, sf_dir), "conf", "is_mapped").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH r AS (SELECT (bin + 0.5) / 20 AS x, mapped / nullif(unmapped, 0) AS y FROM {SQL_RATIO}), s AS (SELECT x, y, lag(x) OVER (ORDER BY x) AS x0, lag(y) OVER (ORDER BY x) AS y0 FROM r)
SELECT round(x0 + (0.6 - y0) * (x - x0) / (y - y0), 9) AS crossing FROM s WHERE (y0 < 0.6 AND y >= 0.6) OR (y0 > 0.6 AND y <= 0.6) ORDER BY x LIMIT 1""")
def ratio_crossing(spark, sf_dir):
    points = D.ratio_bins(flagged(spark, sf_dir), "conf", "is_mapped")
    return D.first_crossing(points, "centre", "ratio", 0.6).filter("crossing IS NOT NULL").select(F.round("crossing", 9).alias("crossing"))


SQL_PERCENT = f"(SELECT CAST(ceil(conf / 0.05) - 1 AS INT) AS bin, count(*) FILTER (WHERE is_mapped) AS mapped, count(*) FILTER (WHERE NOT is_mapped) AS unmapped, count(*) AS n FROM {SQL_FLAGGED} WHERE conf > 0 AND conf <= 19 * 0.05 GROUP BY 1)"


@query(f"SELECT bin, mapped, unmapped, n, round(100 * mapped / n, 9) AS mapped_percent, round(100 * unmapped / n, 9) AS unmapped_percent, round((bin + 0.5) * 0.05, 9) AS centre FROM {SQL_PERCENT}")
def percent_bins(spark, sf_dir):
    out = D.percent_bins(flagged(spark, sf_dir), "conf", "is_mapped")
    return out.withColumns({c: F.round(c, 9) for c in ("mapped_percent", "unmapped_percent", "centre")})


@query(f"""WITH p AS (SELECT (bin + 0.5) * 0.05 AS x, 100 * mapped / n - 100 * unmapped / n AS d FROM {SQL_PERCENT}), s AS (SELECT x, d, lag(x) OVER (ORDER BY x) AS x0, lag(d) OVER (ORDER BY x) AS e FROM p)
SELECT round(x0 + (0 - e) * (x - x0) / (d - e), 9) AS crossing FROM s WHERE e < 0 AND d >= 0 ORDER BY x LIMIT 1""")
def mapped_overtakes(spark, sf_dir):
    points = D.percent_bins(flagged(spark, sf_dir), "conf", "is_mapped")
    return D.first_overtaking(points, "centre", "mapped_percent", "unmapped_percent").select(F.round("crossing", 9).alias("crossing"))


SQL_HALF = f"(SELECT *, right(cleaned_preds, 1) IN ('A', 'D', 'F', 'H', 'K') AS is_mapped FROM ({SQL_CLEAN}))"


@query(f"""WITH p AS (SELECT (bin + 0.5) * 0.05 AS x, 100 * mapped / n - 100 * unmapped / n AS d FROM {SQL_PERCENT.replace(SQL_FLAGGED, SQL_HALF)}), s AS (SELECT x, d, lag(x) OVER (ORDER BY x) AS x0, lag(d) OVER (ORDER BY x) AS e FROM p)
SELECT round(x0 + (0 - e) * (x - x0) / (d - e), 9) AS crossing FROM s WHERE e < 0 AND d >= 0 ORDER BY x LIMIT 1""")
def even_flag_overtakes(spark, sf_dir):
    """Where mapped rows first outnumber the others, for a flag that half of the rows have."""
    rows = R.with_mapped(cleaned(spark, sf_dir).withColumn("tail", F.right("cleaned_preds", F.lit(1))), "ADFHK", seq="tail")
    points = D.percent_bins(rows, "conf", "is_mapped")
    return D.first_overtaking(points, "centre", "mapped_percent", "unmapped_percent").select(F.round("crossing", 9).alias("crossing"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, round(avg(value), 9) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def box_stats(spark, sf_dir):
    out = D.box_stats(V.table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3", "mean")})


@query("""WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
g AS (SELECT *, lo + i * ((hi - lo) / 99) AS x FROM s, (SELECT unnest(generate_series(0, 99)) AS i)),
c AS (SELECT event_type, value AS v, count(*) AS m FROM events GROUP BY 1, 2)
SELECT g.event_type, round(x, 6) AS x, round(log10(sum(m * exp(-((x - v) / (sd * pow(n, -0.2))) * ((x - v) / (sd * pow(n, -0.2))) / 2)) / (any_value(n) * any_value(sd * pow(n, -0.2)) * sqrt(2 * pi())) + 1e-6), 6) AS log_density
FROM g JOIN c USING (event_type) GROUP BY g.event_type, i, x""")
def kernel_density(spark, sf_dir):
    out = D.kernel_density(V.table(spark, sf_dir, "events"), "event_type", "value", points=100)
    return out.select("event_type", F.round("x", 6).alias("x"), F.round("log_density", 6).alias("log_density"))


SQL_RANKED = f"(SELECT protease, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, protease) AS rank FROM ({SQL_CLEAN}) WHERE protease IS NOT NULL GROUP BY protease)"


@query(f"SELECT t.rank AS top, r.protease FROM {SQL_RANKED} t JOIN {SQL_RANKED} r ON r.rank <= t.rank")
def top_proteases(spark, sf_dir):
    return D.top_sets(D.ranked(cleaned(spark, sf_dir), "protease"), "protease").withColumn("top", F.col("top").cast("long"))


@query(f"SELECT t.rank AS top, count(*) AS n, round(avg(c.conf), 9) AS mean_conf FROM {SQL_RANKED} t JOIN {SQL_RANKED} r ON r.rank <= t.rank JOIN ({SQL_CLEAN}) c ON c.protease = r.protease GROUP BY t.rank")
def protease_accumulation(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    out = sweep.protease_sweep(rows, D.ranked(rows, "protease"))
    return out.groupBy(F.col("top").cast("long").alias("top")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 9).alias("mean_conf"))


# sets, slices and sweeps

@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return merged_tables(c, s)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark, sf_dir):
    """The difference of two sets of ids."""
    return V.table(spark, sf_dir, "documents").select("doc_id").join(V.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    customers = V.table(spark, sf_dir, "customer")
    return customers.select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query(f"SELECT item_id, substr(protein, 31, 5) AS cdr1, substr(protein, 50, 17) AS cdr2, greatest(instr(translate(protein, 'I', 'L'), translate(substr(protein, 31, 12), 'L', 'I')) - 1, 0) AS naive, greatest(instr(translate(protein, 'I', 'L'), translate(substr(protein, 31, 12), 'I', 'L')) - 1, 0) AS offset_at FROM {V.SQL_PROTEINS}")
def regions(spark, sf_dir):
    part = P.region("protein", 30, 42)
    naive = F.greatest(F.instr(P.normalized("protein"), F.translate(part, "L", "I")) - 1, F.lit(0))
    return V.proteins(spark, sf_dir).select("item_id", P.region("protein", 30, 35).alias("cdr1"), P.region("protein", 49, 66).alias("cdr2"), naive.cast("long").alias("naive"), P.equivalent_offset("protein", part).cast("long").alias("offset_at"))


@query("""SELECT DISTINCT a.p_size AS kmer_size, b.p_brand AS brand, c.p_type AS kind FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type FROM part) c""")
def grid_product(spark, sf_dir):
    """Every combination of the values seen: the domains, gathered in one row, are exploded one after the other."""
    domains = V.table(spark, sf_dir, "part").agg(*[F.collect_set(c).alias(c) for c in ("p_size", "p_brand", "p_type")])
    rows = domains.withColumn("kmer_size", F.explode("p_size")).withColumn("brand", F.explode("p_brand")).withColumn("kind", F.explode("p_type"))
    return rows.select("kmer_size", "brand", "kind")


def peptide_psms(spark, sf_dir) -> DataFrame:
    """The sentences of benchmark as PSMs."""
    rows = V.peptides(spark, sf_dir)
    return rows.select(F.col("id").alias("row_id"), F.concat_ws("_", F.lit("exp"), F.element_at(F.array(*[F.lit(p) for p in V.PROTEASES]), (F.pmod("id", F.lit(4)) + 1).cast("int"))).alias("experiment_name"), F.col("seq").alias("preds"), (-F.pmod("id", F.lit(10)) / 100).alias("log_probs"))


def whole_run(spark, sf_dir, method: str, until: str) -> dict[str, DataFrame]:
    none = spark.createDataFrame([], "description string, seq string")
    protein = V.proteins(spark, sf_dir).orderBy("item_id").first().protein
    config = assembly.Config(protein, V.PROTEASES, "sentences", method, conf=0.9, kmer_size=12, min_overlap=8, min_identity=0.2, max_mismatches=200, size_threshold=12)
    return assembly.run_assembly(peptide_psms(spark, sf_dir), none, config, until)


@query()
def dbg_run(spark, sf_dir):
    """The whole workflow by De Bruijn contigs up to the consensus of clusters; the first benchmark text is the protein."""
    return whole_run(spark, sf_dir, "dbg", "consensus")["consensus"]


@query()
def greedy_run(spark, sf_dir):
    return whole_run(spark, sf_dir, "greedy", "scaffold_stats")["scaffold_stats"]


def sweep_inputs(spark, sf_dir) -> tuple[DataFrame, str]:
    return R.clean_psms(peptide_psms(spark, sf_dir), V.PROTEASES), V.proteins(spark, sf_dir).orderBy("item_id").first().protein


@query()
def contig_sweep(spark, sf_dir):
    """Statistics of 2 * 2 * 2 * 2 settings from four assemblies."""
    grid = sweep.grid_rows(spark, {"conf": [0.9, 0.95], "kmer_size": [11, 12], "size_threshold": [12, 30], "min_overlap": [4], "min_identity": [0.05, 0.1], "max_mismatches": [100, 200]})
    return sweep.contig_sweep(*sweep_inputs(spark, sf_dir), grid)


@query()
def greedy_sweep(spark, sf_dir):
    """Statistics of 2 * 2 * 2 * 2 settings from four greedy assemblies."""
    grid = sweep.grid_rows(spark, {"conf": [0.9, 0.95], "size_threshold": [12, 30], "min_overlap": [4, 6], "min_identity": [0.05, 0.1], "max_mismatches": [200]})
    return sweep.contig_sweep(*sweep_inputs(spark, sf_dir), grid, method="greedy")


@query()
def scaffold_sweep(spark, sf_dir):
    """Statistics of the scaffolds of 2 * 2 settings."""
    grid = sweep.grid_rows(spark, {"conf": [0.9], "kmer_size": [11, 12], "size_threshold": [12], "min_overlap": [4], "min_identity": [0.05, 0.1], "max_mismatches": [200]})
    return sweep.contig_sweep(*sweep_inputs(spark, sf_dir), grid, until="scaffolds")


@query()
def protease_contigs(spark, sf_dir):
    """Contigs of the predictions of the i most frequent proteases, for every i: how many, and the longest."""
    rows, _ = sweep_inputs(spark, sf_dir)
    found = sweep.protease_contigs(rows, D.ranked(rows, "protease"), 12)
    return found.groupBy("top").agg(F.count(F.lit(1)).alias("n_contigs"), F.max(F.length("seq")).alias("longest"), F.sum(F.length("seq")).alias("letters"))


# files

FILES = {
    "psm_csv": (files.psm_csv, files.SQL_PSM_CSV),
    "fasta_files": (files.fasta_files, files.SQL_FASTA),
    "cluster_fasta_files": (files.cluster_fasta_files, files.SQL_CLUSTER_FASTA),
    "score_files_by_run": (files.score_files_by_run, files.sql_score_files(SQL_CATEGORY.format("run"))),
    "stats_tables": (files.stats_tables, files.SQL_STATS_TABLES),
    "missing_stats": (files.missing_stats, "SELECT 's' || s_suppkey AS folder FROM supplier WHERE s_suppkey % 2 = 0"),
    "stats_json": (files.stats_json, files.sql_stats_json(sql_stats(1))),
    "sweep_names": (files.sweep_names, files.SQL_SWEEP_NAMES),
}
for _name, (_f, _sql) in FILES.items():
    QUERIES[_name], ORACLES[_name] = _f, _sql


# more of the workflow's parts

@query(f"SELECT kmer, protease, count(*) AS n, round(avg(conf), 9) AS conf FROM (SELECT protease, conf, substr(preds, CAST(i AS INT), 5) AS kmer FROM (SELECT c.protease, c.conf, p.preds, unnest(generate_series(1, length(p.preds) - 4)) AS i FROM ({SQL_CLEAN}) c JOIN {V.SQL_PSMS} p USING (row_id) WHERE length(p.preds) >= 5)) GROUP BY 1, 2")
def kmers_with_metadata(spark, sf_dir):
    """The 5-mers of the uncleaned predictions, which keep their rows' columns."""
    rows = G.kmer_rows(cleaned(spark, sf_dir), 5, "preds")
    return rows.groupBy("kmer", "protease").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 9).alias("conf"))


@query(f"SELECT row_id, round(conf, 9) AS conf, CAST(row_number() OVER (ORDER BY conf DESC, row_id) AS BIGINT) AS place FROM ({SQL_CLEAN})")
def psms_by_confidence(spark, sf_dir):
    """The order in which greedy assembly takes the predictions: Spark sorts by ranges, and numbers each range after those before it."""
    return D.numbered(R.by_confidence(cleaned(spark, sf_dir), "row_id"), "place").select("row_id", F.round("conf", 9).alias("conf"), "place")


@query(f"SELECT id, seq, CAST(row_number() OVER (ORDER BY length(seq) DESC, seq, id) AS BIGINT) AS place FROM {V.SQL_DOCUMENT_PEPTIDES}")
def documents_by_length(spark, sf_dir):
    rows = V.document_peptides(spark, sf_dir)
    return D.numbered(R.by_length(rows, tie="id"), "place").select("id", "seq", "place")


@query(f"SELECT CAST(least(floor((conf - 0.2) / 0.02), 40) AS INT) AS bin, count(*) FILTER (WHERE is_mapped) AS mapped, count(*) FILTER (WHERE NOT is_mapped) AS unmapped, count(*) AS n FROM {SQL_FLAGGED} WHERE conf >= 0.2 GROUP BY 1")
def stacked_histogram(spark, sf_dir):
    """Mapped and unmapped rows from a confidence of 0.2 on, in bins of 0.02."""
    return D.stacked_histogram(flagged(spark, sf_dir), "conf", "is_mapped", 0.2)


@query(f"SELECT count(*) AS n, count(preds) AS predicted, (SELECT count(*) FROM ({SQL_CLEAN}) WHERE conf > 0.7) AS confident FROM {V.SQL_PSMS}")
def filter_counts(spark, sf_dir):
    """How many predictions each step of the preparation leaves."""
    rows = V.psms(spark, sf_dir)
    steps = {"predicted": R.clean_psms(rows, V.PROTEASES), "confident": R.over_confidence(cleaned(spark, sf_dir), 0.7)}
    return R.counted(rows, steps)


@query(f"SELECT g.run, count(*) = count(*) FILTER (WHERE s.ass_method = 'dbg') AS all_dbg, bool_and(s.source IN (SELECT source FROM {V.SQL_SCORES} WHERE run = 'bsa')) AS within_bsa FROM (SELECT DISTINCT run FROM {V.SQL_SCORES}) g JOIN {V.SQL_SCORES} s USING (run) GROUP BY g.run")
def subset_tests(spark, sf_dir):
    """Of each run: whether its methods are a subset of {dbg}, and its settings one of those of bsa."""
    rows = V.scores(spark, sf_dir)
    one = spark.range(1).select(F.lit("dbg").alias("value"))
    methods = Z.subset_of(rows.select("run", F.col("ass_method").alias("value")), one, "run").withColumnRenamed("within", "all_dbg")
    bsa = rows.filter("run = 'bsa'").select(F.col("source").alias("value"))
    return methods.join(Z.subset_of(rows.select("run", F.col("source").alias("value")), bsa, "run").withColumnRenamed("within", "within_bsa"), "run")


@query(f'SELECT grp, total_sequences, average_length, min_length, max_length, "N50", "N90", reference_start, reference_end, coverage FROM ({sql_stats(1)})')
def statistics_without_identity(spark, sf_dir):
    out = S.assembly_statistics(V.intervals(spark, sf_dir), 600, ["grp"], identity=False)
    return out.withColumns({c: F.round(c, 9) for c in ("average_length", "coverage")})


# the sentences of documents: what grows in proportion to them

ON_DOCUMENTS = ("dbg_edges", "dbg_degrees", "fasta_records")


def on_documents(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: globals()[name](spark, sf_dir, V.document_peptides)


for _name in ON_DOCUMENTS:
    QUERIES[f"documents_{_name}"] = on_documents(_name)
    ORACLES[f"documents_{_name}"] = ORACLES[_name].replace(V.SQL_PEPTIDES, V.SQL_DOCUMENT_PEPTIDES)

# the same rows, with runs of nodes instead of each node in the exchange
QUERIES["documents_dbg_edges"] = lambda spark, sf_dir: H.sequence_edges(V.document_texts(spark, sf_dir), 12, letters=V.document_size(spark, sf_dir))
QUERIES["documents_dbg_degrees"] = lambda spark, sf_dir: H.sequence_degrees(V.document_texts(spark, sf_dir), 12, letters=V.document_size(spark, sf_dir))


# assembly of all sentences of documents. Of k-mers this long few join by chance; with shorter ones most starts reach most ends, so that
# pairs (and contigs) grow with the square of the sentences whatever finds them.


ASSEMBLED = 32


@query()
def documents_dbg_contigs(spark, sf_dir):
    return G.sequence_contigs(V.document_texts(spark, sf_dir), ASSEMBLED)


@query()
def documents_dbg_reach_pairs(spark, sf_dir):
    return G.sequence_reach(V.document_texts(spark, sf_dir), ASSEMBLED)


# the same over all sentences that aren't empty; the k-mers' length is the only limit

ON_WHOLE = ("assembly_graph_ends", "decontaminate_psms")


def on_whole(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: globals()[name](spark, sf_dir, 1)


for _name in ON_WHOLE:
    QUERIES[f"whole_{_name}"] = on_whole(_name)
    ORACLES[f"whole_{_name}"] = ORACLES[_name].replace(DOC_SENTENCES, V.sql_sentences("documents", "doc_id", 1))


# the containment join over all sentences of documents


@query(f"""WITH s AS (SELECT DISTINCT seq FROM {V.SQL_DOCUMENT_PEPTIDES}),
k AS (SELECT seq, CAST(least(length(seq), 8) AS INT) AS n, left(seq, 8) AS seed FROM s),
w AS (SELECT DISTINCT seq AS holder, n, substr(seq, CAST(i AS INT), n) AS seed FROM s, (SELECT DISTINCT n FROM k), LATERAL (SELECT unnest(generate_series(1, length(seq) - n + 1)) AS i) WHERE length(seq) >= n),
c AS (SELECT DISTINCT k.seq FROM k JOIN w ON k.n = w.n AND k.seed = w.seed WHERE k.seq <> w.holder AND contains(w.holder, k.seq))
SELECT seq FROM s WHERE seq NOT IN (SELECT seq FROM c)""")
def documents_maximal_sentences(spark, sf_dir):
    return X.maximal(V.document_texts(spark, sf_dir), letters=V.document_size(spark, sf_dir))


# the table function in a lateral call


@query(f"""SELECT kmer, count(*) AS n, count(DISTINCT id) AS n_sequences, CAST(min(place) AS INT) AS first_place
FROM (SELECT id, i - 1 AS place, substr(seq, CAST(i AS INT), 9) AS kmer FROM {V.SQL_DOCUMENT_PEPTIDES}, LATERAL (SELECT unnest(generate_series(1, length(seq) - 8)) AS i) WHERE length(seq) >= 9) GROUP BY kmer""")
def lateral_kmers(spark, sf_dir):
    """The 9-mers of all sentences: how often, in how many sentences, and the first place of each.

    Where an id has one row, counting rows counts ids, and tasks tally them before anything is shuffled; only sentences of repeated ids
    (doc_ids given twice) take the lateral call and a distinct count.
    """
    sql_functions.register(spark)
    rows = V.document_peptides(spark, sf_dir)
    again = kept(rows.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if not again.limit(1).count():
        return W.window_counts(rows, 9).select(W.spelled("code").alias("kmer"), "n", "n_sequences", "first_place")
    own = W.window_counts(rows.join(again, "id", "left_anti"), 9).select(W.spelled("code").alias("kmer"), "n", "n_sequences", "first_place")
    shared = spark.sql("SELECT k.kmer, count(*) AS n, count(DISTINCT r.id) AS n_sequences, min(k.at) AS first_place FROM {rows} r, LATERAL kmer_table(r.seq, 9) k GROUP BY k.kmer", rows=rows.join(again, "id", "left_semi"))
    return own.unionByName(shared).groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("n_sequences").alias("n_sequences"), F.min("first_place").alias("first_place"))
