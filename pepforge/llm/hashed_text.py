"""Hashed text features that the classifiers share."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

#: Letters and digits stay words, all else separates; A-Z lower-cased.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: For shapes: letters become a, digits 0, other marks stay.
SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
PREFIXES = range(4, 9)
MEMO = 500_000


class Memo(dict):
    """What make says of each word; computed once, and forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = self.make(word)
        return found


class WordFeatures:
    """The hashed features of words: the word itself and its prefixes. keep: only those, as {hash: column}."""

    def __init__(self, bits: int, keep: dict[int, int] | None = None):
        self.top, self.keep, self.memo = (1 << bits) - 1, keep, Memo(self.of_word)

    def of_word(self, word: bytes) -> tuple[int, ...]:
        own = {zlib.crc32(b"=" + word) & self.top} | {zlib.crc32(b"^" + word[:k]) & self.top for k in PREFIXES if k <= len(word)}
        return tuple(sorted(own if self.keep is None else {self.keep[h] for h in own if h in self.keep}))

    def of_text(self, text: str | None) -> Counter:
        """Each feature's count over the whole text."""
        found: Counter = Counter()
        words = Counter((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())
        for features, n in zip(map(self.memo.__getitem__, words), words.values(), strict=True):
            for f in features:
                found[f] += n
        return found


class TextFeatures:
    """Hashed words with their marks, the shapes of words, and how long and how repetitive the text is; present or not."""

    def __init__(self, bits: int):
        self.top, self.memo = (1 << bits) - 1, Memo(self.of_word)

    def of_word(self, word: bytes) -> int:
        """The word's feature and, 32 bits up, its shape's."""
        shape = word.translate(SHAPES)
        for c in (b"a", b"A", b"0"):
            while c * 2 in shape:
                shape = shape.replace(c * 2, c)
        return zlib.crc32(b"=" + word.lower()) & self.top | (zlib.crc32(b"~" + shape) & self.top) << 32

    def of_text(self, text: str | None) -> np.ndarray:
        """The sorted features."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        distinct = set(words)
        both = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
        length = zlib.crc32(b"#length %d" % len(words).bit_length()) & self.top
        varied = zlib.crc32(b"#distinct %d" % (10 * len(distinct) // max(1, len(words)))) & self.top
        return np.unique(np.concatenate([both & 0xFFFFFFFF, both >> 32, [length, varied]])).astype(np.int64)
