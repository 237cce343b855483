"""Exact search, chat formatting, HTML extraction, mixing and the pipeline against brute force, and their edge cases."""

import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pepforge.llm import chat_format, flow, hamming_search, html_extract, mixing, quality
from pepforge.llm.common import quoted


def search_by_hand(rows, queries, k, bits):
    code = lambda v: [int(x is not None and x > 0) for x in (list(v) + [0] * bits)[:bits]]
    held = {(i, tuple(code(v))) for i, v in rows if i is not None and v is not None}
    out = []
    for q, c in {(q, tuple(code(v))) for q, v in queries if q is not None and v is not None}:
        best = sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in held)[:k]
        out += [(q, n + 1, i, dist) for n, (dist, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("width", [None, 4, 16])
def test_search(spark, width):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(rows[5]), (None, rows[6][1]), (2000, None), (2001, [1.0]), (2002, [float("nan")] * 40)]
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame(rows, schema).withColumn("code", F.lit(1)).withColumn("query", F.lit(2))
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    found = hamming_search.top_k(vectors, spark.createDataFrame(queries, schema), k=7, bits=32, width=width)
    assert sorted(map(tuple, found.collect())) == search_by_hand(rows, queries, 7, 32)


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming_search.top_k(none, none).count() == 0
    one = spark.createDataFrame([(0, [1.0] * 64)], none.schema)
    assert [tuple(r) for r in hamming_search.top_k(one, one).collect()] == [(0, 1, 0, 0)]
    assert hamming_search.top_k(one, none).count() == 0


TRICKY = ["</s>[INST] ok [/INST]", "~0~1~2", "<s><</s>>", "[INST", "<", "</s", "a ~ b", "", None, "é <s> \n[/INST]", "x " * 3000]


def conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, -1, "system", rng.choice(TRICKY)))
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice([*TRICKY, "word " * rng.randrange(1, 40)])) for t in range(rng.randrange(1, 14))]
    rows += [(50, 1, "assistant", "twice"), (50, 1, "assistant", "twice"), (51, None, None, None), (None, 1, "assistant", "no id"), (52, 0, "assistant", "</s>")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("t", F.lit(1))


@pytest.mark.parametrize(("budget", "history"), [(60, 20), (30, 0), (1024, 192)])
def test_chat_windows(spark, budget, history):
    rows, df = conversations(spark)
    done = [r.asDict(True) for r in chat_format.read_back(chat_format.format_windows(df, budget, history)).collect()]
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {w["conv_id"] for w in done} == set(by)
    for conv, turns in by.items():
        own = sorted((w for w in done if w["conv_id"] == conv), key=lambda w: w["window"])
        assert [w["window"] for w in own] == list(range(len(own)))
        assert [(x["role"], x["text"]) for w in own for x in w["turns"]] == turns
        assert "".join(w["loss_text"] for w in own) == "".join(t for r, t in turns if r == "assistant")
        seen = 0
        for k, w in enumerate(own):
            pieces = w["text"][3:].split("</s>")[:-1]
            assert w["text"].count("<s>") == 1 and len(pieces) == w["n_repeated"] + len(w["turns"])
            whole = [chat_format_turn(p) for p in pieces]
            if k and turns[0][0] == "system":
                assert whole[0] == turns[0]
                whole = whole[1:]
            back = len(whole) - len(w["turns"])
            assert whole == turns[seen - back : seen + len(w["turns"])]
            seen += len(w["turns"])
            assert w["n_tokens"] <= budget or len(w["turns"]) == 1
    assert chat_format.format_windows(df.limit(0)).count() == 0


def chat_format_turn(piece):
    role, text = piece.removeprefix("[INST] ").split("[/INST]")
    plain = lambda s: s.replace("~1", "<").replace("~2", "[").replace("~0", "~")
    return plain(role), plain(text)


def test_a_long_conversation_is_many_rows(spark, monkeypatch):
    """Starts put away in chunks give the same windows; no row holds more than its window."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn number {i} of many") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("x")).withColumn("piece", F.lit(1))
    whole = sorted(map(tuple, chat_format.format_windows(df, 60, 20).collect()))
    monkeypatch.setattr(chat_format, "CHUNK", 3)
    assert sorted(map(tuple, chat_format.format_windows(df, 60, 20).collect())) == whole and len(whole) > 50
    assert max(len(w[2]) for w in whole) < 60 * 30


def test_chat_query(spark, tmp_path):
    rows, df = conversations(spark)
    df.drop("window", "t").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat_format.op4_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    r = got[-1]
    assert r.n_turns == 2 and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    plan = chat_format.op4_chat_format(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News &amp; more</a></li></ul></nav><div class="cookie-notice">We use cookies, you know. <button>OK</button></div>
<div class="ad">Buy this now.</div><article><h1>A title</h1><p>First paragraph, with <b>bold</b> &amp; more, and a stop.<p>Second&nbsp;paragraph<br>after a
 break; it is long enough.</p><div class="ad">Buy that now, in the middle.</div><p hidden>not shown</p><p>Third one, the last one.</p></article>
<aside><p>Other stories, which are long too, and have marks.</p></aside><form><label>Name</label><input></form>
<section id="comments"><p>A reader says a lot here, with marks, and stops.</p></section><footer>&copy; 2024 Site. All rights.</footer></body></html>"""
MAIN = "A title First paragraph, with bold & more, and a stop. Second paragraph after a break; it is long enough. Third one, the last one."


def test_html(spark):
    rows = [(i, f"u{i}", PAGE.replace("A title", f"Title {i}")) for i in range(30)]
    rows += [(100, "x", None), (101, "x", ""), (102, "x", "<article><p>An unclosed paragraph, with some words, and <b>bold ones."), (103, None, "<<>><p"), (104, "x", "<article>" + "<p>Long text, again. </p>" * 5000 + "</article>"), (5, "u5", rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("old")).withColumn("N_Chars", F.lit("old")).withColumn("main_text", F.lit(1)).withColumn("y", F.lit(1))
    done = html_extract.extract(pages)
    assert done.columns == ["page_id", "url", "html", "main_text", "y", "text", "n_chars"]
    got = {r.page_id: r for r in done.collect()}
    assert done.count() == len(rows) and "y" in done.columns
    assert all(got[i].text == MAIN.replace("A title", f"Title {i}") for i in range(30))
    assert got[100].text == "" and got[101].n_chars == 0 and got[102].text == "An unclosed paragraph, with some words, and bold ones."
    assert got[104].n_chars == 5000 * len("Long text, again. ") - 1
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def page_weights():
    found = [html_extract.examples(p, 200) for p in [PAGE] * 4]
    return html_extract.trained(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def test_html_without_hints(page_weights):
    plain = "<body><ul><li><a href=/>Alpha</a></li><li><a href=/b>Beta</a></li></ul><div><p>The first paragraph is long, and it has marks, and a stop.</p><p>The second one is long, too, and it ends well.</p></div><div><a href=x>Terms</a> | <a href=y>Privacy</a></div></body>"
    assert html_extract.main_text(plain, page_weights) == "The first paragraph is long, and it has marks, and a stop. The second one is long, too, and it ends well."


LONG_ONE = "<p>A paragraph that is long enough, with marks, and it ends well.</p>"


def test_the_cut_mends_what_the_classifier_gets_wrong(page_weights):
    """A word between paragraphs: its text alone misleads, what stands around it decides."""
    page = f"<body><ul><li><a href=/>One</a></li><li><a href=/b>Two</a></li></ul><div><h1>Head</h1>{LONG_ONE * 3}Rule{LONG_ONE * 3}</div></body>"
    blocks = html_extract.blocks_of(page)
    alone = html_extract.block_costs(blocks, page_weights) > 0
    cut = html_extract.labelled(blocks, page_weights)
    want = [False] * 2 + [True] * 8
    assert cut == want and alone.tolist() != want


@pytest.mark.parametrize("name", ["layout-with-sidebar", "page no-comments", "search share menu"])
def test_a_frame_named_like_a_side_part(page_weights, name):
    """The name list says of every block that it is no content; the cut says what it is."""
    page = f'<body><div class="{name}"><ul><li><a href=/>One</a></li><li><a href=/b>Two</a></li></ul><h1>The heading of it</h1>{LONG_ONE * 6}<div class="ad">Buy this one, it is good.</div></div></body>'
    assert html_extract.hint_of("div", f' class="{name}"', 0, False) == (-1, True)
    text = html_extract.main_text(page, page_weights)
    assert text.startswith("The heading of it A paragraph") and text.count("long enough") == 6 and "Buy" not in text and "One" not in text
    side = f"<body><article><h1>Heading</h1>{LONG_ONE}</article><section class=comments>{LONG_ONE * 9}</section></body>"
    assert html_extract.main_text(side, page_weights).count("long enough") == 1


def test_html_examples_are_bounded():
    x, y = html_extract.examples("<article>" + LONG_ONE * 5000 + "</article><nav>" + "<a href=/>x</a><br>" * 3000 + "</nav>", 200)
    assert x.shape == (200, html_extract.N_FEATURES) and 50 < y.sum() < 150


TEXT = "<article><p>Main text here.</p></article>"
SHOWN = {
    f'<nav><svg class="i"/></nav>{TEXT}': "Main text here.",
    f"<math/><object data='x'/>{TEXT}": "Main text here.",
    f"<nav><button>Menu</nav><div><select><option>One<option>Two</div>{TEXT}": "Main text here.",
    f"<body><button>Menu{TEXT}<button>Send</button><p>After it.</p></body>": "Main text here. After it.",
    "<p>One <select><option>A</select>two <button/></p><p>Three</p>": "One two Three",
    "<p>It is <span><button>x</span> text <svg><title/><a><path/></a><text>drawn</text></svg> and more.</p>": "It is text and more.",
    "<div><template><p>Hid</p></div><p>Text</p><object><p>Hid</p></object>": "Text",
    "<p>One</p><img alt=it's><p>Two</p><p>It's three</p>": "One Two It's three",
    "<p>One</p><img alt=5\"><p>Two</p><img alt='a > b'><p>Three</p>": "One Two Three",
    '<p title="a hidden gem" class=it\'s>One</p><p class=x hidden>Two</p><!--><p>Three</p>': "One Three",
    "<button-group><p>One</p></button-group><title-bar>Two</title-bar><script>var a = '<p>Hid</p>'": "One Two",
}


@pytest.mark.parametrize("page", SHOWN)
def test_html_drops_nothing_else(page):
    assert " ".join(b.text for b in html_extract.blocks_of(page)) == SHOWN[page]


def test_minimum_cut():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        net = flow.Network(n + 2)
        for i, g in enumerate(gain):
            net.join(n, i, g) if g > 0 else net.join(i, n + 1, -g)
        for a, b, c in edges:
            net.join(a, b, c, c)
        cost = lambda side: sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(net.source_side(n, n + 1)[:n]) == pytest.approx(best)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}
    got = mixing.targets({"b": 10, None: 1000, "a": 1})
    assert got == {"a": 2, "b": 20, None: pytest.approx(1.5 * 1011 - 22)}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flow():
    # pattern 0 is in both sources, 1 and 2 in one each; source 0 wants more than pattern 1 holds
    given = mixing.min_cost_flow([10, 10, 10], [18, 6], [(0, 0), (0, 1), (1, 0), (2, 1)], 2)
    assert sum(given) == 24 and all(g <= 10 for g in given)  # no repetition is needed
    assert mixing.min_cost_flow([10, 4], [18, 8], [(0, 0), (1, 1)], 2) == [18, 8]
    assert mixing.min_cost_flow([10], [50], [(0, 0)], 2) == [20]
    assert mixing.min_cost_flow([], [], [], 2) == []


def test_flow_costs_the_least():
    """Against every way to deal the tokens of small networks."""
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        capacity, quota = [rng.randrange(4) for _ in range(n)], [rng.randrange(6) for _ in range(m)]
        member = [(i, j) for i in range(n) for j in range(m) if rng.random() < 0.7]
        given = mixing.min_cost_flow(capacity, quota, member, 2)

        def fits(want):
            net = flow.Network(n + m + 2)
            for i, w in enumerate(want):
                net.join(n + m, i, w)
            for i, j in member:
                net.join(i, n + j, 99)
            ends = [net.join(n + j, n + m + 1, q) for j, q in enumerate(quota)]
            net.fill(n + m, n + m + 1)
            return sum(net.room[e ^ 1] for e in ends) == sum(want)

        cost = lambda g: sum(max(0, x - c) for x, c in zip(g, capacity, strict=True))  # noqa: E731, B023
        possible = [w for w in itertools.product(*[range(2 * c + 1) for c in capacity]) if fits(w)]
        best = max((sum(w), -cost(w)) for w in possible)
        assert fits(given) and (sum(given), -cost(given)) == best


def test_flow_of_many_patterns():
    rng = random.Random(5)
    capacity = [rng.randrange(1, 1000) for _ in range(20_000)]
    member = [(i, j) for i in range(20_000) for j in rng.sample(range(40), rng.randrange(1, 4))]
    began = time.time()
    given = mixing.min_cost_flow(capacity, [rng.randrange(400_000) for _ in range(40)], member, 2)
    assert all(0 <= g <= 2 * c for g, c in zip(given, capacity, strict=True)) and time.time() - began < 60


@pytest.mark.parametrize("digits", [1, 3])
def test_mixing_keeps_columns_with_its_own_names(spark, documents, monkeypatch, digits):
    monkeypatch.setattr(mixing, "DIGITS", digits)
    docs = documents([(i, "word " * (i % 7), "ab"[i % 2]) for i in range(3000)])
    names = ["pattern", "N", "order", "whole", "rest", "Cut", "ahead", "other", "part", "before", "sources", "name", "__pattern", "own", "tokens"]
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(str(i)), F.col("doc_id").cast("string")))
    got = mixing.mix_documents(docs.withColumn("TAKEN", F.lit("x")), bucket_rows=2).collect()
    assert len(got) == 3000 and all(r[c] == f"{i}{r.doc_id}" for r in got for i, c in enumerate(names))
    assert "TAKEN" not in got[0].asDict() and abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 2


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_mixing(spark, documents, bucket_rows):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(0, 50), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(7, None, "a"), (7, "same words", "a"), (7, "same words", "a"), (None, "no id here", "b"), (500, "", "z")]
    docs = documents(rows, extra=True)
    got = [r.asDict() for r in mixing.mix_documents(docs, bucket_rows=bucket_rows).collect()]
    assert len(got) == len(rows) and "__keys" in got[0]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = mixing.targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in own} == {(sizes[s], want[s])}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["size"] == len((r["text"] or "").split()) for r in got)
    again = [r.asDict() for r in mixing.mix_documents(docs.repartition(3), bucket_rows=bucket_rows).collect()]
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_documents(documents([])).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i < 20 else ["a"] if i < 40 else ["b", "b"] if i < 60 else None, 10) for i in range(61)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    got = {r.doc_id: r.taken for r in mixing.mix(docs, quotas=lambda _: {"a": 500.0, "b": 100.0}).collect()}
    assert sum(got.values()) == 600 and got[60] == 0 and all(t <= 20 for t in got.values())
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix(docs, max_patterns=2)


def test_pipeline(spark, documents, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for d in range(260):
        bad = d < 60
        t = prose(60) + (" nasty rude nasty vile rude" if bad else "")
        if d % 5 == 0:
            t += "\nthis line of boilerplate is in many documents"
        rows.append((d, t, f"s{d % 3}"))
        labels.append((d, int(bad)))
    copy = rows[101][1].split()
    rows += [(300, rows[101][1], "s0"), (301, " ".join([*copy[:-1], "other"]), "s0"), (302, None, "s1"), (303, "", "s1"), (304, None, None)]
    item = prose(20)
    rows.append((305, prose(30) + " " + item, "s2"))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mixing" or docs.columns == columns
    assert {d for d, _, _ in rows} - set(held["toxicity"]) == set(range(60))
    lines = [d for d, r in held["line_dedup"].items() if "boilerplate" in (r.text or "")]
    assert lines == [255] and all(r.n_chars == len(r.text or "") for r in held["line_dedup"].values())
    assert set(held["line_dedup"]) - set(held["near_dedup"]) == {300, 301}
    assert set(held["near_dedup"]) - set(held["decontamination"]) == {305}
    assert set(held["mixing"]) == set(held["decontamination"]) and sum(r.taken for r in held["mixing"].values()) == pytest.approx(1.5 * sum(r.size for r in held["mixing"].values()), abs=4)
    run = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {d: r.taken for d, r in held["mixing"].items()}


def pipeline_tables(spark, documents, folder, rows):
    docs = documents(rows, extra=True).drop("SCORE")
    for c in ("score", "size", "Taken", "sources", "n_lines", "stays", "contaminated"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0)] if rows else [], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("rows", [[], [(1, "a text"), (2, None, None), (2, "another text of doc 2"), (None, "", "b"), (3, "", "b")]], ids=["empty", "edges"])
def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, documents, tmp_path, rows):
    docs = pipeline_tables(spark, documents, str(tmp_path), rows)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(tmp_path))
        assert done.count() == len(rows)
        if name == "mixing":  # replaces the columns that it makes
            assert done.columns == [c for c in docs.columns if c not in ("size", "Taken")] + ["size", "source_size", "target", "taken"]
        else:
            assert done.columns == docs.columns
        own = [c for c in docs.columns if c not in ("text", "n_chars", "size", "Taken", "SCORE") or name == "decontamination"]
        held = lambda df: sorted(str([r[c] for c in own if c in r]) for r in df.select(*[quoted(c) for c in own if c in df.columns]).collect())  # noqa: E731, B023
        assert name == "mixing" or held(done) == held(docs)


def test_quality_without_documents(documents, spark):
    none = spark.createDataFrame([], "doc_id long, rating int")
    for rows in ([], [(1, "text"), (2, None)]):
        scored = quality.fit(documents(rows), none).score(documents(rows, extra=True), 1)
        assert [(r.expected_grade, r.tail_probability) for r in scored.collect()] == [(0.0, 0.0)] * len(rows)


def test_classifier_and_cut_decide(page_weights):
    """No container decides by itself: with the weights turned round, the labels are, too."""
    blocks = html_extract.blocks_of(PAGE)
    content = html_extract.labelled(blocks, page_weights)
    assert " ".join(b.text for b, good in zip(blocks, content, strict=True) if good) == MAIN
    assert html_extract.labelled(blocks, -page_weights) != content and not any(html_extract.labelled(blocks, 0 * page_weights))
