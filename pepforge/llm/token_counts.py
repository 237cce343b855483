"""Operator 11, token counts of a byte-level BPE vocabulary, with a shortcut for pre-tokens that are one token.

``prove`` runs the merges on every string of the vocabulary, once and away from the data. What they make one token of is *whole*: a
pre-token equal to such a string has one token, whatever stands around it, as merges never cross pre-tokens. Strings that aren't
whole (their merges end elsewhere, or they can't be reached) get no shortcut. In the tasks each pre-token is looked up once; only those
that aren't whole are merged, and their counts are remembered (at most ``memo`` of them, then anew), as words repeat.

Pre-tokens are split by the published pattern. Tables of letters, digits and spaces differ between Unicode versions, so ``prove`` asks the
library's splitter for the kind of every code point and writes the pattern's classes out. A text is split in pieces of about
``piece_chars`` code points, each of which ends before a single space after something else, where a pre-token always ends; so lists stay
bounded whatever the text's length.

Special strings inside a text are one token each, as is the library's default. Files of other kinds are refused: ``prove`` takes .json
files of byte-level BPE that split by the pattern, without normalizer, prefix space or stripping special tokens.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows and null doc_ids keep rows of their own; columns named
n_bytes, n_tokens, n_whole and over_limit are replaced, all others pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, small_batches, table

#: Contractions, letters, digits, all else, and spaces: the published pattern of this family of vocabularies (fixed value), in which the
#: names stand for classes of code points.
PATTERN = "'(?:[stmd]|re|ve|ll)| ?[letter]+| ?[digit]+| ?[other]+|[space]+(?![^space])|[space]+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged(piece: bytes, pairs: dict[tuple[int, int], tuple[int, int]], of_byte: list[int]) -> int:
    """The number of tokens of a pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none has a rank."""
    ids = [of_byte[b] for b in piece]
    n = len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
    heapify(heap)
    while heap:
        _, new, i, left, right = heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue  # one of the two is merged already
        ids[i], ids[j], n = new, -1, n - 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := pairs.get((new, ids[k])):
                heappush(heap, (*found, i, new, ids[k]))
        if (h := before[i]) >= 0 and (found := pairs.get((ids[h], new))):
            heappush(heap, (*found, h, ids[h], new))
    return n


@dataclass
class Proof:
    """What is known of a vocabulary before any text is read. Its size is the vocabulary's, whatever the corpus."""

    whole: list[str]
    pairs: dict[tuple[int, int], tuple[int, int]]
    of_byte: list[int]
    special: list[str]
    ascii_pattern: str
    pattern: str


def kinds(split) -> dict[str, list[tuple[int, int]]]:
    """The ranges of code points of each kind (letter, digit, space, other), as split sees them; it gives the (start, end) of pre-tokens.

    All code points in their order are split as one text: each pre-token is a range of one kind, but that a plain space may lead it.
    The kind of a range is that which makes one pre-token of its first code point between two of the kind.
    """
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    found: dict[str, list[tuple[int, int]]] = {"letter": [], "digit": [], "other": [], "space": [(32, 32)]}
    for start, end in split("".join(points)):
        if points[start] == " ":
            start += 1
        if start < end:
            c = points[start]
            kind = next((k for k, x in (("letter", "a"), ("digit", "1"), ("other", "!")) if len(split(x + c + x)) == 1), "space")
            found[kind].append((ord(c), ord(points[end - 1])))
    return found


def written_out(ranges: dict[str, list[tuple[int, int]]], last: int) -> str:
    """The pattern with the classes' code points up to last. ASCII parts of runs come first, and the long
    classes are tried on other code points only, which is faster."""
    cut = lambda own, end: "".join(f"{re.escape(chr(a))}-{re.escape(chr(min(z, end)))}" for a, z in own if a <= end)
    out, beyond = PATTERN, "(?=[^\\x00-\\x7f])"
    for kind, own in ranges.items():
        if kind != "space" and last > 127:
            out = out.replace(f"[{kind}]+", f"(?:[{cut(own, 127)}]+(?:{beyond}[{kind}]+)?|{beyond}[{kind}]+)")
        out = out.replace(kind, cut(own, last))
    return out


@lru_cache(maxsize=8)
def prove(path: str) -> Proof:
    """Reads a vocabulary file and finds its whole strings; once for each path and process."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    held = json.loads(text)
    model, split = held["model"], held["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or held["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
        raise ValueError(f"special tokens that take what is around them: {path}")
    to_byte = byte_letters()
    bytes_of = lambda s: bytes(to_byte[c] for c in s)
    vocab = {bytes_of(s): i for s, i in model["vocab"].items() if all(c in to_byte for c in s)}
    pairs = {}
    for rank, m in enumerate(model["merges"]):
        a, b = map(bytes_of, m.split(" ") if isinstance(m, str) else m)
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    of_byte = [vocab[bytes([b])] for b in range(256)]
    whole = []
    for s in vocab:
        if merged(s, pairs, of_byte) == 1:
            try:
                whole.append(s.decode())
            except UnicodeDecodeError:
                pass  # a part of a code point is never a pre-token
    library = Tokenizer.from_str(text)
    spans = lambda s: [x[1] for x in library.pre_tokenizer.pre_tokenize_str(s)]
    ranges = kinds(spans)
    return Proof(whole, pairs, of_byte, [t["content"] for t in held["added_tokens"]], written_out(ranges, 127), written_out(ranges, 0x10FFFF))


class Counter(dict):
    """Tokens of each pre-token: 1 for whole ones, else by the merges, remembered."""

    def __init__(self, proof: Proof, memo: int, piece_chars: int):
        super().__init__(dict.fromkeys(proof.whole, 1))
        self.proof, self.limit, self.piece_chars = proof, len(proof.whole) + memo, piece_chars
        self.split, self.ascii_split = re.compile(proof.pattern), re.compile(proof.ascii_pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(proof.special, key=len, reverse=True)))) if proof.special else None

    def __missing__(self, piece: str) -> int:
        n = merged(piece.encode(), self.proof.pairs, self.proof.of_byte)
        if len(piece) <= 64:  # others hardly repeat
            if len(self) >= self.limit:
                self.clear()
                self.update(dict.fromkeys(self.proof.whole, 1))
            self[piece] = n
        return n

    def pieces(self, text: str):
        """Stretches of text that end where a pre-token does."""
        at, n = 0, len(text)
        while n - at > self.piece_chars:
            cut = at + self.piece_chars
            while cut < n and not (text[cut] == " " and not text[cut - 1].isspace()):
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens counted without merging)."""
        n = direct = 0
        parts = self.special.split(text) if self.special else [text]
        n += len(parts) - 1
        for part in parts:
            for piece in self.pieces(part):
                split = self.ascii_split if piece.isascii() else self.split
                each = list(map(self.__getitem__, split.findall(piece)))
                n += sum(each)
                direct += each.count(1)  # what merges to one token is whole
        return n, direct


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", memo: int = 500_000, piece_chars: int = 1_000_000) -> DataFrame:
    """docs with n_bytes, n_tokens, n_whole (pre-tokens that are one token) and over_limit (more than limit tokens).

    path: the vocabulary file, on the driver. What is proved of it goes to the tasks once (its size is the vocabulary's).
    """
    spark = docs.sparkSession
    small_batches(spark)
    proof = spark.sparkContext.broadcast(prove(path))

    @F.pandas_udf("struct<n_tokens:long,n_whole:long>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        counter = held_counter(proof, memo, piece_chars)
        return pd.DataFrame([counter.count(t) if t else (0, 0) for t in texts], columns=["n_tokens", "n_whole"])

    (own,) = fresh(docs, "tokens")
    value = docs[quoted(text)].cast("string")
    out = docs.withColumn(own, counted(value))
    return out.withColumns({
        "n_bytes": F.coalesce(F.octet_length(value), F.lit(0)).cast("long"),
        "n_tokens": F.col(f"{own}.n_tokens"),
        "n_whole": F.col(f"{own}.n_whole"),
        "over_limit": F.col(f"{own}.n_tokens") > limit,
    }).drop(own)


_COUNTERS: dict = {}


def held_counter(proof, memo: int, piece_chars: int) -> Counter:
    """The worker's counter of this proof: batches and tasks of one worker share what is remembered."""
    key = (proof.value.__class__, id(proof.value), memo, piece_chars)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(proof.value, memo, piece_chars)
    return _COUNTERS[key]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), path or vocabulary_path())
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole")
