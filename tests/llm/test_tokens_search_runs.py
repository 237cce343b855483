"""Operators 11 to 13 against the library, against brute force, and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from pepforge.llm import lexical_search, periodic_runs, token_counts

SF = "/root/testdata/sf0.001"
ODD = ["a.b", "tick`ed", "n_tokens", "Runs", "tokens", "scanned", "n_bytes", "collapsed", "score", "rank"]


def with_odd(df):
    for i, c in enumerate(ODD):
        df = df.withColumn(c, df.doc_id * i)
    return df


# token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path())


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'LL", "1", "23", "!", "?", "é", "ß", "漢", "字", "\xa0", " ", "😀", "<|endoftext|>", "<|end", "the", " The", "ing", "\x1c", "\x85", "　", "²", "'", "᠎", "​", "՘", "₏", "\U000107bb", "\x00"]


@pytest.mark.parametrize("piece_chars", [5, 1_000_000])
def test_counts_equal_the_librarys(library, piece_chars):
    own = token_counts.Counter(token_counts.prove(token_counts.vocabulary_path()), 100, piece_chars)
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 50)))
        assert own.count(text)[0] == expected(library, text), text


def test_every_code_point_is_of_the_librarys_kind(library):
    own = token_counts.Counter(token_counts.prove(token_counts.vocabulary_path()), 10**6, 10**6)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    begins = lambda s: [x[1] for x in library.pre_tokenizer.pre_tokenize_str(s)]
    rng = random.Random(1)
    rng.shuffle(points)
    for k in range(0, len(points), 5000):
        text = "".join(f"a{c}a1{c}1!{c}! {c}" for c in points[k : k + 5000])
        assert [m.span() for m in own.split.finditer(text)] == begins(text)


def test_whole_strings_are_proved_and_only_those(library):
    proof = token_counts.prove(token_counts.vocabulary_path())
    whole, to_byte = set(proof.whole), token_counts.byte_letters()
    rest = []
    for s in library.get_vocab():
        if all(c in to_byte for c in s):
            try:
                text = bytes(to_byte[c] for c in s).decode()
            except UnicodeDecodeError:
                continue
            if text not in whole:
                rest.append(text)
    assert len(whole) > 49_000
    for text in random.Random(2).sample(sorted(whole), 3000):
        own = library.pre_tokenizer.pre_tokenize_str(text)
        assert len(own) > 1 or expected(library, text) == 1
    for text in rest:
        assert expected(library, text) > 1 or text == "<|endoftext|>"


def test_long_pre_tokens_are_merged_in_order(library):
    own = token_counts.Counter(token_counts.prove(token_counts.vocabulary_path()), 10, 1000)
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 5000, 50_000):
        text = "".join(rng.choices("abcdeinrst", k=n))
        assert own.count(text)[0] == expected(library, text)
        assert own.count("a" * n)[0] == expected(library, "a" * n)
        assert own.count(" " * n)[0] == expected(library, " " * n)


def test_token_counts_of_a_table(documents, library):
    texts = [None, "", " ", "the cat", "the cat", "<|endoftext|>", "word " * 600, "x" * 3000, "é漢😀"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "again")]
    got = token_counts.token_counts(with_odd(documents(rows)), token_counts.vocabulary_path())
    assert {"a.b", "tick`ed", "tokens", "score"} <= set(got.columns)
    found = Counter((r["text"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect())
    want = Counter((t, len((t or "").encode()), n := expected(library, t or ""), n > 512) for _, t in rows)
    assert found == want
    assert token_counts.token_counts(documents([]), token_counts.vocabulary_path()).count() == 0


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.prove(public_tokenizers.path("word_bpe_49k.json"))


def test_token_query_equals_the_library(spark, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op11_token_counts(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet")
    for d, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        n = expected(library, text or "")
        assert got[d] == (len((text or "").encode()), n, n > 512)


# ranked search


def searched(docs, items, k):
    """Brute force: {item: [(doc_id, score), ...]} in order."""
    own = [(d, Counter(w)) for d, t in docs if (w := lexical_search.terms_of(t))]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = {}
    by_item = {}
    for item, text in items:
        by_item.setdefault(item, set()).update(lexical_search.terms_of(text))
    for item, terms in by_item.items():
        scores = []
        for d, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(lexical_search.weight(n_docs, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((d, s))
        scores.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if scores:
            out[item] = scores[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        own = out.setdefault(r["item_id"], [])
        own.append((r["doc_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


@pytest.mark.parametrize("segment_words, block_chars", [(40, 10**6), (500, 60), (10**6, 10**6)])
def test_search_equals_brute_force(spark, documents, segment_words, block_chars):
    rng = random.Random(segment_words)
    words = [f"w{i}" for i in range(40)] + ["É", "漢字", "Alpha"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(rng.randint(-50, 50), " ".join(rng.choices(words, weights, k=rng.randint(0, 25)))) for _ in range(150)]
    rows += [(None, "w3 w4 alpha"), (None, "w3 w4 alpha"), (7, None), (8, ""), (9, "-- !!"), (1, "w3 w4 alpha"), (10, "w5 " * 500)] + [(200 + i, "same words w6 here") for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(12)] + [(50, None), (51, ""), (52, "absent"), (53, "same SAME here"), (53, "w1"), (None, "w2 w9")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = answers(lexical_search.ranked(with_odd(documents(rows)).repartition(3), bench, 10, segment_words, block_chars))
    assert got == searched(rows, items, 10)


def test_search_of_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked(documents([]), bench).count() == 0
    assert lexical_search.ranked(documents([(1, None), (2, "..")]), bench).count() == 0
    assert lexical_search.ranked(documents([(1, "a b")]), bench.limit(0)).count() == 0
    alone = answers(lexical_search.ranked(documents([(1, "A b a"), (2, "c")]), spark.createDataFrame([("x", "a")], "item_id string, text string")))
    assert alone == searched([(1, "A b a"), (2, "c")], [("x", "a")], 50)


def test_treap_keeps_every_cell():
    rng = np.random.default_rng(4)
    rows, cols = rng.integers(0, 500, 3000), rng.integers(0, 70, 3000)
    cells = np.unique(rows * 70 + cols)
    values = rng.integers(1, 1_000_000, len(cells))
    tree = lexical_search.Treap({"doc_ids": list(range(70)), **lexical_search.treap((cells // 70) << lexical_search.STRETCH, cells % 70, values)})
    for r in rng.choice(500, 40):
        best = []
        tree.search(np.array([r]), np.array([1]), best, 100)
        own = cells // 70 == r
        assert sorted(best) == sorted(zip(values[own].tolist(), (-(cells[own] % 70)).tolist(), strict=True))


# periodic runs


def naive_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                size = j - i + q
                s = w[i : i + size]
                if size >= max(least, times * q) and not any(s[p:] == s[: size - p] for p in range(1, q)):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_the_naive_scan():
    rng = random.Random(2)
    for _ in range(1500):
        texts = []
        for _ in range(3):
            w = []
            while len(w) < rng.randint(0, 60):
                if rng.random() < 0.5:
                    p = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
                    w += [p[i % len(p)] for i in range(rng.randint(1, 6 * len(p)))]
                else:
                    w += [rng.choice("abcdxyz") for _ in range(rng.randint(0, 8))]
            texts.append(w)
        assert periodic_runs.runs_of(texts, 6, 4) == [naive_runs(w) for w in texts]


def test_long_texts_are_scanned_quickly():
    from time import perf_counter

    began = perf_counter()
    fib, thue = ["a", "ab"], [bin(i).count("1") % 2 for i in range(1 << 15)]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    assert periodic_runs.runs_of([["x"] * 50_000, list(fib[-1]), [str(i) for i in thue]], 6, 4) == [[(0, 50_000, 1)], [], []]
    block = [str(random.Random(1).random()) + str(i) for i in range(700)]
    assert periodic_runs.runs_of([block * 60], 6, 4) == [[(0, 42_000, 700)]]
    assert perf_counter() - began < 60


def test_runs_of_a_table(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "x " * 6), (6, "ab cd " * 4 + "z"), (6, "ab cd " * 4 + "z"), (None, "k\tl\n" * 9), (7, "\xa0 " * 8)]
    got = periodic_runs.periodic_runs(with_odd(documents(rows)))
    assert {"a.b", "tick`ed", "score", "tokens"} <= set(got.columns)
    found = Counter((r["doc_id"], r["text"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got.collect())
    want = Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = naive_runs(w)
        want[(d, t, tuple(runs), naive_collapsed(w, runs))] += 1
    assert found == want
    assert periodic_runs.periodic_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(documents([]), times=2)


def test_run_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet")
    n_runs = 0
    for d, text in zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = naive_runs(w)
        n_runs += len(runs)
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(naive_collapsed(w, runs).encode()).hexdigest()
        best = None
        for s, k, q in runs:
            if best is None or k * best[2] > best[1] * q:
                best = (s, k, q)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
    assert n_runs
