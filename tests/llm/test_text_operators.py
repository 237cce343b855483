"""Line dedup, near-dedup, decontamination, toxicity, quality and license scans against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
from time import perf_counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepforge.llm import decontamination, license_scan, line_dedup, near_dedup, quality, toxicity

LONG = "some quite ordinary line of text that repeats "
EDGES = [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "a\x00b"), (5, "é" * 30 + "\n" + "É" * 30), (6, LONG * 4000), (7, "same text of more than twenty letters"), (7, "same text of more than twenty letters"), (None, "same text of more than twenty letters"), (8, "SAME text of more than twenty letters\r")]
SPACE = r"[\x20\x09-\x0D]"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def lines_by_hand(rows):
    key = lambda x: lower(re.sub(f"^{SPACE}+|{SPACE}+$", "", x))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or d == max(held[key(x)], key=lambda v: -1 if v is None else v)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def repeated_lines(seed):
    rng = random.Random(seed)
    pool = [f"line number {i} that is long enough" for i in range(12)] + ["short", ""]
    return [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]


@pytest.mark.parametrize("rows", [EDGES, repeated_lines(1), []], ids=["edges", "repeated", "empty"])
def test_line_dedup(documents, rows):
    done = line_dedup.dedup_lines(documents(rows, extra=True))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in done.collect()), key=str)
    assert got == lines_by_hand(rows) and "__keys" in done.columns


def test_line_index_is_reversible(documents):
    rows = repeated_lines(2)
    first, second = documents(rows[:40]), documents(rows[40:])
    index = line_dedup.LineIndex().insert(first)
    before = sorted(map(tuple, index.counts.collect())), {r.shard: r.n for r in index.filters.collect()}
    index.insert(second)
    both = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(documents(rows)).collect()), key=str)
    assert both == lines_by_hand(rows)
    index.delete(second.select("doc_id"))
    assert (sorted(map(tuple, index.counts.collect())), {r.shard: r.n for r in index.filters.collect()}) == before
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(first).collect()), key=str) == lines_by_hand(rows[:40])


def test_line_index_grows(documents):
    rows = repeated_lines(4)
    index = line_dedup.LineIndex(keys_per_shard=50).insert(documents(rows))
    more = [(100 + i, "\n".join(f"one more frequent line, number {n}" for n in range(200))) for i in range(3)]
    index.insert(documents(more))
    assert index.n_shards == 5 and index.filters.filter("buckets IS NULL").count() == 0
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(documents(rows + more)).collect()), key=str)
    assert got == lines_by_hand(rows + more)


def test_line_index_equals_a_fresh_one_after_every_change(documents):
    """Growing inserts and deletes in another order; exact tables, filters and results as if built at once."""
    rng = random.Random(9)
    pool = [f"line number {i} that is long enough" for i in range(400)]
    batches = [[(1000 * b + i, "\n".join(rng.sample(pool[: 20 + 45 * b], min(6, 3 + b)))) for i in range(3 + 3 * b)] for b in range(9)]
    batches[4].append(batches[3][0])  # a document that is there already
    index, held = line_dedup.LineIndex(keys_per_shard=60, folders=4), {}
    steps = [("insert", b) for b in range(9)]
    for at, gone in ((4, 2), (6, 0), (9, 7)):
        steps.insert(at, ("delete", gone))
    for what, b in steps:
        docs = documents(batches[b])
        if what == "insert":
            index.insert(docs)
            held |= dict(batches[b])
        else:
            index.delete(docs.select("doc_id"))
            held = {d: t for d, t in held.items() if d not in dict(batches[b])}
        want = {}
        for d, t in held.items():
            for x in set(t.split("\n")):
                want.setdefault(line_dedup.line_key(x.encode(), 20), set()).add(d)
        assert {(r.k1, r.k2): (r.n_docs, r.keeper) for r in index.counts.collect()} == {k: (len(v), max(v)) for k, v in want.items()}
        frequent = [k for k, v in want.items() if len(v) >= 3]
        filters = {r.shard: r for r in index.filters.collect()}
        assert sum(r.n for r in filters.values()) == len(frequent) and all(r.n <= 120 for r in filters.values())
        for k1, k2 in frequent:
            assert line_dedup.Cuckoo(np.frombuffer(filters[k1 % index.n_shards].buckets, np.uint16)).holds(np.array([k1]), np.array([k2])).all()
    assert index.n_shards > 1 and len(index._logs[0].tables) <= 6
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(documents(list(held.items()))).collect()), key=str) == lines_by_hand(list(held.items()))


def test_a_change_reads_only_its_own_folders(documents):
    """A small change leaves the folders of other keys unread."""
    index = line_dedup.LineIndex(folders=32).insert(documents([(i, f"line number {i} that is long enough") for i in range(64)]))
    index.insert(documents([(100, "one more line that is long enough")]))
    by_key = index._logs[0]
    key = index._new_refs(documents([(1, "one more line that is long enough")]))
    folders = by_key.folders(key)
    assert len(folders) == 1
    base = by_key.tables[0][0].filter(F.col("folder").isin(folders))
    assert base.count() < 16 and re.search(r"PartitionFilters: \[[^]]*folder", base._jdf.queryExecution().toString())


@pytest.mark.parametrize("folders", [None, 8])
def test_a_change_moves_only_its_own_rows(documents, folders):
    """What isn't of the changed keys is neither shuffled nor sorted: it falls in a semi-join with the broadcast keys."""
    index = line_dedup.LineIndex(folders=folders).insert(documents([(i, f"line number {i} that is long enough") for i in range(200)]))
    for i in range(2):
        index.insert(documents([(300 + i, f"one more line {i} that is long enough")]))
    for log, of in zip(index._logs, (["k1", "k2"], ["doc_id"], ["k1", "k2"]), strict=True):
        assert len(log.tables) > 1
        keys = line_dedup.saved(index._new_refs(documents([(300, "one more line 0 that is long enough")])).select(*of), "keys")
        found = log.rows(keys)
        assert found.count() == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"BroadcastHashJoin .*LeftSemi", plan)) == len(log.tables)
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan  # the one of the versions, above the joins


def test_filters_are_probed_in_small_groups(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 20)
    rows = [(i, "\n".join(f"line number {n} that is long enough" for n in range(1 if i else 600))) for i in range(600)]
    index = line_dedup.LineIndex().insert(documents(rows))  # a hot line and a long document
    dealt, salts = index.dealt(index.refs)
    assert salts == 60 and dealt.count() == 1199 and dealt.groupBy("shard", "salt").count().agg(F.max("count")).first()[0] <= 40
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.apply(documents(rows)).collect()), key=str) == lines_by_hand(rows)


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    k1, k2, o1, o2 = rng.integers(-(1 << 63), 1 << 63, (4, 3000), np.int64)
    f = line_dedup.Cuckoo.of(k1, k2)
    assert f.holds(k1, k2).all() and f.holds(o1, o2).mean() < 0.01
    f.delete(k1[:1500], k2[:1500])
    assert f.holds(k1[1500:], k2[1500:]).all() and f.holds(k1[:1500], k2[:1500]).mean() < 0.01


def shingles(t, width):
    w = [x for x in re.split(f"{SPACE}+", lower(t)) if x]
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def components_by_hand(rows, width, percent=80):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        n = len(x & y)
        if x and y and 100 * n >= percent * (len(x) + len(y) - n):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(3):
        base = [rng.choice(words) for _ in range(50 + 20 * g)]
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 3, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((5 * len(rows) + 3, " ".join(t)))
    return rows + [(9001, "one"), (9002, "ONE"), (9003, "one two"), (9004, "two one"), (9005, "\t ")]


@pytest.mark.parametrize(("rows", "width", "block"), [(near_copies(5), 2, 16), (near_copies(6), 2, 512), (near_copies(7), 5, 512), (EDGES, 2, 512), ([], 2, 512)])
def test_near_components(documents, rows, width, block):
    got = near_dedup.near_components(documents(rows), width, 80, block=block).collect()
    want = components_by_hand(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in rows)


def test_near_dedup_keeps_columns(documents):
    rows = near_copies(8)
    docs = documents(rows, extra=True)
    kept = near_dedup.near_dedup(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components_by_hand(rows, 2).values()))


def test_sequential_verification():
    least = near_dedup.least_matches(0.8, 1e-7)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (4000, near_dedup.N_HASHES), np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint32(1))
    c = np.where(rng.random(a.shape) < 0.3, a, a + np.uint32(1))
    assert near_dedup.plausible(a, b, least).all() and not near_dedup.plausible(a, c, least).any()


def contamination_by_hand(rows, items, width=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        w = word(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = word(t), set(), set()
        for s in range(len(w)):
            for n in range(1, width + 1):
                own = tuple(w[s : s + n])
                if len(own) == n and own in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[own]
        out.append((d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 13, 30])))) for i in range(12)] + [(None, "null item words here"), (3, "again ITEM, three!")]
    rows = []
    for d in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            t[rng.randrange(len(t) + 1) : 0] = own[a : a + 20] if rng.random() < 0.5 else own
        rows.append((d, " ".join(t).upper() if d % 7 == 0 else ", ".join(t)))
    return rows, items


@pytest.mark.parametrize("limits", [{}, {"block_chars": 150}])
@pytest.mark.parametrize("case", [planted(1), (EDGES, [(1, "same text of more than"), (2, None), (3, "")]), (planted(2)[0], []), ([], planted(2)[1])], ids=["planted", "edges", "no items", "no rows"])
def test_contamination(spark, documents, case, limits):
    rows, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.contamination(documents(rows, extra=True), benchmark, **limits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == contamination_by_hand(rows, items)


def test_small_segments_and_proximity(spark, documents):
    rows, items = planted(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(documents(rows), segment_words=200)
    assert index.count() > 3
    got = decontamination.search(index, benchmark).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == sorted((x[0], x[2]) for x in contamination_by_hand(rows, items))
    near = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    texts = [(1, "gamma x alpha y beta"), (2, "alpha " + "z " * 30 + "beta gamma"), (3, "alpha beta")]
    got = decontamination.search(decontamination.build_index(documents(texts)), near, slop=4).collect()
    assert {r.doc_id: list(r["items"]) for r in got} == {1: ["1"], 2: [], 3: []}


@pytest.mark.parametrize("width", [1, 2, 5])
@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_intersected_lists_find_every_occurrence(width, at_once):
    rng = random.Random(width)
    for _ in range(40):
        docs = [(d, [b"%d" % rng.randrange(3) for _ in range(rng.randrange(12))]) for d in range(5)]
        items = [(str(i), " ".join(str(rng.randrange(4)) for _ in range(rng.randrange(9)))) for i in range(6)] + [("none", None)]
        block = decontamination.Windows(items, width)
        found = set()
        for window, doc, first, n in block.phrases(decontamination.Segment(decontamination.segment(docs)), at_once):
            at, item = block.items(window)
            found |= {(block.names[k], int(doc[i]), int(first[i]), int(n[i])) for i, k in zip(at, item, strict=True)}
        wanted, begin = set(), 0
        for d, words in docs:
            for name, text in items:
                own = decontamination.words_of(text)
                for s in range(max(1, len(own) - width + 1) if own else 0):
                    w = own[s : s + width]
                    wanted |= {(name, d, begin + p, len(w)) for p in range(len(words)) if words[p : p + len(w)] == w}
            begin += len(words)
        assert found == wanted


def test_decontaminate(documents, spark):
    rows, items = planted(4)
    docs = documents(rows, extra=True)
    kept = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in contamination_by_hand(rows, items) if not x[4])


def labelled(seed, n=900):
    rng = random.Random(seed)
    words = [f"plain{i}" for i in range(150)]
    rows, toxic = [], []
    for d in range(n):
        bad = rng.random() < 0.2
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(1, 4) if bad else 0):
            t[rng.randrange(len(t) + 1) : 0] = [rng.choice(["nasty", "rude", "vileword"])]
        rows.append((d, " ".join(t)))
        toxic.append((d, int(bad)))
    return rows, toxic


def test_toxicity_held_out(spark, documents):
    rows, toxic = labelled(1)
    docs = documents(rows)
    scored = toxicity.fold_model(docs, spark.createDataFrame(toxic, "doc_id long, toxic int")).score(docs).withColumn("held", toxicity.is_held_out()).collect()
    known = dict(toxic)
    held = [r for r in scored if r.held]
    assert 200 < len(held) < 400 and all(0 <= r.score <= 1 for r in scored)
    right = sum((r.score >= 0.7) == bool(known[r.doc_id]) for r in held)
    assert right / len(held) > 0.95


def test_toxicity_edges(spark, documents):
    rows, toxic = labelled(2, 300)
    model = toxicity.fit(documents(rows), spark.createDataFrame(toxic, "doc_id long, toxic int"))
    docs = documents(EDGES, extra=True)
    scored = model.score(docs, "own").collect()
    assert len(scored) == len(EDGES) and all(0 <= r.own < 0.7 for r in scored)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.fit(documents(rows), none).score(documents(EDGES)).collect())
    assert model.score(documents([])).count() == 0


def test_nnpu_uses_the_prior():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (500, 1))
    u = np.concatenate([rng.normal(2, 1, (300, 1)), rng.normal(-2, 1, (700, 1))])
    w, b = toxicity.nnpu(p, u, 0.3)
    called = (1 / (1 + np.exp(-(u @ w + b))) > 0.5).mean()
    assert 0.2 < called < 0.4


def test_quality(spark, documents):
    rng = random.Random(4)
    rows, grades = [], []
    for d in range(600):
        g = rng.randrange(3)
        t = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(20)] + [["junk%%%"] * 6, ["so", "so"] * 3, ["fine", "clear"] * 3][g]
        rng.shuffle(t)
        rows.append((d, " ".join(t)))
        grades.append((d, g))
    docs, known = documents(rows), dict(grades)
    model = quality.fit(docs, spark.createDataFrame([g for g in grades if g[0] % 3], "doc_id long, rating int"))
    assert list(model.thresholds) == sorted(model.thresholds) and model.ratings == [0, 1, 2]
    held = [r for r in model.score(docs, 1).collect() if r.doc_id % 3 == 0]
    assert np.mean([abs(r.expected_grade - known[r.doc_id]) < 0.5 for r in held]) > 0.95
    assert np.mean([(r.tail_probability >= 0.5) == (known[r.doc_id] >= 1) for r in held]) > 0.95
    edges = model.score(documents(EDGES, extra=True), 2)
    assert edges.count() == len(EDGES) and "__score" in edges.columns
    lone = quality.fit(docs, spark.createDataFrame([(1, 4), (None, 2), (2, None)], "doc_id long, rating int"))
    assert {(r.expected_grade, r.tail_probability) for r in lone.score(docs, 4).collect()} == {(4.0, 1.0)}
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, rating int"))
    assert {r.expected_grade for r in none.score(docs, 1).collect()} == {0.0}


def test_license_scan(documents):
    mit = license_scan.TEMPLATES["MIT"][1]
    changed = mit.replace("free of charge", "gratis").replace("sublicense, ", "").replace("copies of the Software,", "copies of this fine Software,")
    rows = [(1, "intro words here " + changed + " outro"), (2, "Released under the MIT license"), (3, "the permission of the software to any person"), (4, "x. All Rights Reserved. y"), (5, mit + " " + "filler " * 500 + mit)] + [(10 + i, t) for i, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: [(m.license, round(m.coverage, 2), m["first"], m["last"]) for m in r.matches] for r in license_scan.scan(documents(rows, extra=True)).collect()}
    n = len(license_scan.words_of(mit))
    assert len(got[1]) == 1 and got[1][0][0] == "MIT" and got[1][0][1] > 0.9 and got[1][0][2] == 3
    assert got[2] == [("MIT", 1.0, 0, 4)] and got[3] == [] and got[4] == [("Proprietary", 1.0, 1, 3)]
    assert got[5] == [("MIT", 1.0, 0, n - 1), ("MIT", 1.0, n + 500, 2 * n + 499)]
    assert all(not got[10 + i] for i in range(len(EDGES)))
    assert license_scan.scan(documents([])).count() == 0


def test_license_scan_finds_changed_words():
    index = license_scan.Index(license_scan.TEMPLATES)
    rng = random.Random(11)
    for i, t in enumerate(index.texts):
        if (n := len(t)) < license_scan.K:
            continue
        least = n - int(0.2 * n + 1e-9)
        changes = [range(4, 5 * (n - least), 5)] + [rng.sample(range(n), n - least) for _ in range(20)]
        changes += [[j] for j in range(n)] if n > least else []
        for changed in changes:
            words = np.concatenate([np.full(7, -1), t, np.full(5, -1)])
            words[[7 + j for j in changed]] = -1
            found = [m for m in index.scan(words, 0.8) if m[0] == index.names[i]]
            assert any(c >= (n - len(changed)) / n - 1e-9 or c >= 0.8 for _, c, _, _ in found), (index.names[i], changed)


def test_license_scan_finds_words_put_in():
    """Short templates: changed words and words put in as far as the band goes; and nothing in texts without enough of their words."""
    index = license_scan.Index(license_scan.TEMPLATES)
    rng = random.Random(12)
    assert len(index.short) > 8 and index.postings
    for i in index.short:
        t, n = index.texts[i], len(index.texts[i])
        most = n - int(np.ceil(0.8 * n - 1e-9))
        for _ in range(200):
            words = [int(w) for w in t]
            for j in rng.sample(range(n), rng.randint(0, most)):
                words[j] = -1
            for _ in range(rng.randint(0, index.band(i))):
                words.insert(rng.randint(1, len(words) - 1), -1)
            found = [c for name, c, _, _ in index.scan(np.array([-1] * 9 + words + [-1] * 9), 0.8) if name == index.names[i]]
            assert found and max(found) >= sum(w >= 0 for w in words) / n - 1e-9
        few = [int(w) for w in t[: max(0, int(np.ceil(0.8 * n - 1e-9)) - 1)]]
        assert all(j != i for j, _, _ in index.short_candidates(np.array(few * 1 + [-1] * (2 * n + 20) + few)))
    assert index.scan(np.array([int(index.word[b"license"])] * 3000), 0.8) == []


def test_license_scan_of_dense_notices():
    """Every notice is found in its place, in a time that grows with the text."""
    index, rng = license_scan.Index(license_scan.TEMPLATES), random.Random(13)
    # none holds another's words in order
    own = [i for i in index.short if not any(j != i and license_scan.aligned(index.texts[j], index.texts[i], -20, 20)[0] >= 0.8 * len(index.texts[j]) for j in range(len(index.texts)))]
    chosen = [rng.choice(own) for _ in range(4000)]
    ends = np.cumsum([len(index.texts[i]) + 3 for i in chosen])
    words = np.concatenate([np.append(index.texts[i], [-1] * 3) for i in chosen])
    began = perf_counter()
    found = {(name, first, last) for name, c, first, last in index.scan(words, 0.8) if c == 1}
    assert perf_counter() - began < 20
    assert found >= {(index.names[i], int(e) - 3 - len(index.texts[i]), int(e) - 4) for i, e in zip(chosen, ends, strict=True)}


def test_license_scan_replaces_its_own_column_only(documents):
    docs = documents([(1, "Released under the MIT license")], extra=True).withColumn("MATCHES", F.lit(1))
    assert license_scan.scan(docs).columns == [c for c in docs.columns if c != "MATCHES"] + ["matches"]


def longest_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_is_the_best_in_its_band():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        n, first, last = license_scan.aligned(np.array(a), np.array(b), -len(a), len(b))
        assert n == longest_common_subsequence(a, b)
        assert not n or (0 <= first <= last < len(b) and longest_common_subsequence(a, b[first : last + 1]) == n)


def test_digest_columns(documents, spark, tmp_path):
    """The thin query's digest is that of the operator's text."""
    rows = repeated_lines(3)
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, _, _, t in lines_by_hand(rows)}


def stays_by_hand(rows, width, percent=80):
    """The doc_ids that name a group of linked texts. A text is named by the smallest doc_id that holds it."""
    own = [(d, frozenset(shingles(t, width))) for d, t in rows if d is not None]
    own = [(d, x) for d, x in own if x or not any(y for e, y in own if e == d)]
    name = {(d, x): min([e for e, y in own if x and y == x] or [d]) for d, x in own}
    group = {n: n for n in name.values()}
    for (p, x), (q, y) in itertools.combinations({(n, x) for (_, x), n in name.items()}, 2):
        n = len(x & y)
        if x and y and 100 * n >= percent * (len(x) + len(y) - n):
            a, b = sorted((group[p], group[q]))
            group = {k: a if g == b else g for k, g in group.items()}
    return {d for (d, _), n in name.items() if group[n] == d}, {(d, x): group[n] for (d, x), n in name.items()}


A, B = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
REPEATED = [[(3, A), (7, A), (7, B), (9, B)], [(3, A), (3, B), (7, B), (8, A), (8, "")], [(5, A), (2, ""), (2, A + " x"), (5, B), (1, B), (None, A)]]


@pytest.mark.parametrize("rows", [*REPEATED, "random 1", "random 2"])
def test_near_dedup_with_several_texts_of_a_document(documents, rows):
    if isinstance(rows, str):
        rng = random.Random(rows)
        rows = [(rng.randrange(80), t) for _, t in near_copies(5)]
    got = near_dedup.near_components(documents(rows), width=2).collect()
    want = components_by_hand(rows, 2)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(d, want.get(d), d is None or want[d] == d) for d, _ in rows}
    stays, group = stays_by_hand(rows, 2)
    kept = sorted((r.doc_id, r.text) for r in near_dedup.near_dedup(documents(rows), width=2).collect() if r.doc_id is not None)
    assert kept == sorted((d, t) for d, t in rows if d in stays)
    assert {g for (d, _), g in group.items() if d in stays} == set(group.values())  # no group of texts is lost


def test_cumulative_link_is_the_likeliest():
    """Against the likelihood written out: no direction improves it."""
    rng = np.random.default_rng(5)
    n, k, ridge = 300, 4, 1e-2
    x = rng.normal(size=(n, k))
    grade = np.digitize(x @ [1.5, -1, 0.5, 0] + rng.logistic(size=n), [-1, 0.5, 2])
    rows, columns = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    w, t = quality.cumulative_link(rows, columns, x.ravel(), grade, k, 4, steps=6000, rate=0.01, ridge=ridge)

    def loss(w, t):
        total = 0.0
        for i in range(n):
            below = [0.0, *(1 / (1 + np.exp(x[i] @ w - c)) for c in t), 1.0]
            total -= np.log(below[grade[i] + 1] - below[grade[i]])
        return total / n + ridge / 2 * (w**2).sum()

    best = loss(w, t)
    assert (np.diff(t) > 0).all()
    for _ in range(60):
        step = rng.normal(size=k + 3) * rng.choice([1e-3, 1e-2, 0.1])
        assert loss(w + step[:k], t + step[k:]) >= best - 1e-7


def test_risk_gradient():
    """Against differences of the risk written out."""
    rng = np.random.default_rng(6)
    p, u, prior = rng.normal(size=(20, 3)), rng.normal(size=(50, 3)), 0.3
    loss = lambda x, w, y: np.mean([np.log1p(np.exp(-y * (r @ w))) for r in x])
    for _ in range(10):
        w = rng.normal(size=3)
        one, negative, as_one, as_zero = toxicity.risk_gradient(p, u, w, prior)
        assert one == pytest.approx(prior * loss(p, w, 1)) and negative == pytest.approx(loss(u, w, -1) - prior * loss(p, w, -1))
        for j in range(3):
            d = np.eye(3)[j] * 1e-6
            assert as_one[j] == pytest.approx(prior * (loss(p, w + d, 1) - loss(p, w - d, 1)) / 2e-6, abs=1e-6)
            both = [loss(u, w + s * d, -1) - prior * loss(p, w + s * d, -1) for s in (1, -1)]
            assert as_zero[j] == pytest.approx((both[0] - both[1]) / 2e-6, abs=1e-6)


def test_repeated_rows_are_one_example(documents, spark):
    rows = [(i % 40, f"text of {i % 40} " + ("good words here " if i % 2 else "bad nasty stuff ") * 5) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, rating int, toxic int")
    assert np.allclose(quality.fit(documents(rows), labels).weights, quality.fit(documents(rows[:40]), labels).weights)
    assert toxicity.fit(documents(rows), labels).weights == pytest.approx(toxicity.fit(documents(rows[:40]), labels).weights)


def test_shapes_are_whole():
    reader = quality.TextFeatures(18)
    a, b = (set(reader.of_text(("A1-" * 20 + end).strip()).tolist()) for end in ("x", "9"))
    assert len(a ^ b) == 4  # the word and its shape
