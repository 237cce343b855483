"""Operator 10, license scans: winnowed fingerprints pick candidates, banded alignment reports matched coverage and spans.

Templates are cut into words; the hashes of their ``K``-word runs are winnowed (of each ``WINDOW`` consecutive ones the smallest is
kept), and the kept ones make an inverted index from fingerprint to (template, place). A document is winnowed alike. So any run of
``K + WINDOW - 1`` words that a document shares with a template gives a common fingerprint. A template too short for the coverage to
force such a run is winnowed more finely: runs of one word, windows of one; its postings are in the same index. A hit's diagonal is its
place in the document less that in the template. A candidate is a stretch of diagonals that a band can hold, with as many hits as a
match must leave there: one run, or as many single words as the coverage asks for. A banded alignment of the template along it tells
which of its words match in order, allowing words that are put in, left out or changed; the candidates of one template are aligned
together. It reports the matched share of the template's words (coverage) and the span of words in the document. Matches of at least
``coverage`` are kept; of those of one template that overlap, the one with the largest coverage.

The index holds the templates only, so its size is fixed; a Python worker makes it once. Documents are scanned whole, each by itself;
nothing is shuffled. No match is reported but from a candidate of the index.

What is found: if words of a template are changed or left out for others, a match of that coverage has a run that long wherever the
template's length forces it, so every such match is found. In a short one, words put in between lose no match either, as far as the band
reaches. Words put into a longer one can break up all of its runs; such a match may be lost.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Defined results: null and empty texts have no match; repeated
rows are scanned each by itself; templates without words match nothing; an empty table gives an empty result. Other columns pass
through ``scan`` unchanged, but one named matches, in any case, is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, table
from .decontamination import words_of

#: Notices and permission texts of well-known licenses, by SPDX-like names.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
K, WINDOW = 3, 2
#: Templates of fewer words are winnowed word by word, and so are those on which the coverage forces no longer run.
SHORT = 16
#: Diagonals to either side that an alignment may take; the share of the template's words adds to it.
BAND, BAND_SHARE = 2, 0.1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def forced_run(n: int, coverage: float) -> int:
    """The run of words that n template words must share with a document in place, if at least this share of them matches."""
    same = min(n, max(1, math.ceil(coverage * n - 1e-9)))
    return -(-same // (n - same + 1))


def runs(words: np.ndarray, k: int = K) -> np.ndarray:
    """The hashes of all runs of k word numbers; NONE where a word is in no template (-1), as such a run can't match."""
    n = max(0, len(words) - k + 1)
    known = np.ones(n, bool)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = words[j : j + n]
            known &= part >= 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return np.where(known, h >> np.uint64(1), NONE)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of the smallest hash of each window consecutive ones."""
    if window == 1:
        return np.flatnonzero(h != NONE)
    if not len(h):
        return np.zeros(0, np.int64)
    padded = np.concatenate([h, np.full(max(0, window - len(h)), NONE)])
    best = np.unique(np.lib.stride_tricks.sliding_window_view(padded, window).argmin(axis=1) + np.arange(len(padded) - window + 1))
    return best[padded[best] != NONE]


class Index:
    def __init__(self, templates: dict[str, tuple[str, ...]], coverage: float = 0.8):
        self.names, self.texts, self.word = [], [], {}
        for name, texts in templates.items():
            for text in texts:
                own = [self.word.setdefault(w, len(self.word)) for w in words_of(text)]
                if own:
                    self.names.append(name)
                    self.texts.append(np.array(own, np.int64))
        self.coverage = coverage
        # by template: the length of its runs and windows, the fewest hits of a match, and the diagonals a candidate spans
        self.grain, self.least, self.span = [], [], []
        found: dict[tuple[int, int], list[np.ndarray]] = {(1, 1): [], (K, WINDOW): []}
        for i, t in enumerate(self.texts):
            need = max(1, math.ceil(coverage * len(t) - 1e-9))
            fine = len(t) < SHORT or forced_run(len(t), coverage) < K + WINDOW - 1
            self.grain.append((1, 1) if fine else (K, WINDOW))
            self.least.append(need if fine else 1)
            self.span.append(len(t) - need + 2 * self.band(i) if fine else self.band(i))
            h = runs(t, self.grain[i][0])
            own = winnow(h, self.grain[i][1])
            found[self.grain[i]].append(np.stack([h[own], np.full(len(own), i, np.uint64), own.astype(np.uint64)], axis=1))
        self.short = [i for i, g in enumerate(self.grain) if g == (1, 1)]
        # the inverted index: fingerprints in order, each with its template and place
        self.postings = {}
        for grain, rows in found.items():
            rows = np.concatenate([np.zeros((0, 3), np.uint64), *rows])
            self.postings[grain] = rows[np.argsort(rows[:, 0], kind="stable")]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, diagonal) of all common fingerprints, in this order."""
        template, diagonal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (k, window), rows in self.postings.items():
            h = runs(words, k)
            place = winnow(h, window)
            first, end = (np.searchsorted(rows[:, 0], h[place], side=side) for side in ("left", "right"))
            n = end - first
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
            template.append(rows[at, 1].astype(np.int64))
            diagonal.append(np.repeat(place, n) - rows[at, 2].astype(np.int64))
        t, d = np.concatenate(template), np.concatenate(diagonal)
        order = np.lexsort((d, t))
        return t[order], d[order]

    def candidates(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(template, least diagonals, largest diagonals) of stretches with enough hits."""
        template, diagonal = self.hits(words)
        out = []
        cuts = np.flatnonzero(np.diff(template, prepend=-1, append=-1))
        for a, z in zip(cuts, cuts[1:], strict=False):
            i, own = int(template[a]), diagonal[a:z]
            if self.grain[i] == (1, 1):
                # every diagonal from which on there are enough words
                first = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
                low = own[first]
                enough = np.searchsorted(own, low + self.span[i], side="right") - first >= self.least[i]
                if enough.any():
                    out.append((i, low[enough], low[enough] + self.span[i]))
            else:
                # runs on diagonals close to each other are one candidate
                first = np.flatnonzero(np.diff(own, prepend=own[0] - self.span[i] - 1) > self.span[i])
                last = np.append(first[1:], len(own)) - 1
                out.append((i, own[first] - self.band(i), own[last] + self.band(i)))
        return out

    def short_candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """The candidates of templates that are winnowed word by word, one by one."""
        return [(i, int(a), int(z)) for i, low, high in self.candidates(words) if i in self.short for a, z in zip(low, high, strict=True)]

    def band(self, template: int) -> int:
        return BAND + int(BAND_SHARE * len(self.texts[template]))

    def scan(self, words: np.ndarray, coverage: float) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first, last) in the order of the document's words."""
        out = []
        for i, low, high in self.candidates(words):
            found = {(int(n), int(a), int(z)) for n, a, z in zip(*aligned_all(self.texts[i], words, low, high), strict=True) if n and n >= coverage * len(self.texts[i])}
            starts: list[int] = []  # of the spans taken, which lie apart, in order
            ends: list[int] = []
            for n, first, last in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                at = bisect_left(starts, first)
                if (at == 0 or ends[at - 1] < first) and (at == len(starts) or starts[at] > last):
                    starts.insert(at, first)
                    ends.insert(at, last)
                    out.append((self.names[i], n / len(self.texts[i]), first, last))
        return sorted(out, key=lambda x: (x[2], x[3], x[0], -x[1]))


def aligned(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """aligned_all() for one candidate."""
    n, first, last = aligned_all(template, words, np.array([low]), np.array([high]))
    return int(n[0]), int(first[0]), int(last[0])


def aligned_all(template: np.ndarray, words: np.ndarray, lows: np.ndarray, highs: np.ndarray, cells: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate the most template words that match in order on its diagonals from low to high, and their first and last place;
    among equal ones the shortest span, so that a word far off isn't taken for one near. So many candidates at once as make up
    cells."""
    found = [np.zeros((3, 0), np.int64)]
    by_width = np.argsort(highs - lows, kind="stable")
    at_once = max(1, cells // int((highs - lows).max() + 1)) if len(lows) else 1
    for k in range(0, len(lows), at_once):
        own = by_width[k : k + at_once]
        found.append(band_alignment(template, words, lows[own], highs[own]))
    out = np.empty((3, len(lows)), np.int64)
    out[:, by_width] = np.concatenate(found, axis=1)
    return out[0], out[1], out[2]


def band_alignment(template: np.ndarray, words: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    count, width = len(lows), int((highs - lows).max()) + 1
    at = np.arange(width)
    beyond = at[None, :] > (highs - lows)[:, None]
    best = np.zeros((count, width), np.int64)  # matches so far, by diagonal
    start = np.full((count, width), -1, np.int64)
    top = np.full((3, count), -1, np.int64)
    top[0] = 0
    rows = np.arange(count)
    far = len(words) + 1
    for i, w in enumerate(template):
        place = lows[:, None] + at + i
        inside = (place >= 0) & (place < len(words)) & ~beyond
        same = inside & (words[np.where(inside, place, 0)] == w) if len(words) else inside
        # what comes before: diagonals up to this one at the previous template word, or a word left out of the document
        lead = np.maximum.accumulate(best * width + at, axis=1) % width
        new, new_start = np.take_along_axis(best, lead, 1), np.take_along_axis(start, lead, 1)
        new[same] += 1
        new_start = np.where(same & (new_start < 0), place, new_start)
        # a template word without counterpart: the next diagonal down
        skip, skip_start = np.zeros_like(best), np.full_like(start, -1)
        skip[:, :-1], skip_start[:, :-1] = best[:, 1:], start[:, 1:]
        better = skip > new
        best, start = np.where(better, skip, new), np.where(better, skip_start, new_start)
        best[beyond], start[beyond] = 0, -1
        ends = same & ~better
        # the most matches, of equals the shortest span, of equals the first diagonal
        value = np.where(ends, best * far - (place - start), -1)
        d = value.argmax(axis=1)
        m, a, z = best[rows, d], start[rows, d], place[rows, d]
        wins = ends[rows, d] & ((m > top[0]) | (m == top[0]) & (z - a < top[2] - top[1]))
        top[:, wins] = np.stack([m, a, z])[:, wins]
    return top


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, tuple[str, ...]], ...], coverage: float) -> Index:
    """A worker's index, made once for all of its tasks."""
    return Index(dict(templates), coverage)


MATCHES = "array<struct<license:string,coverage:double,first:long,last:long>>"


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """docs with matches: license, coverage, and the first and last word (from 0) of each match."""
    small_batches(docs.sparkSession)
    held = tuple((name, tuple(texts)) for name, texts in templates.items())

    @F.pandas_udf(MATCHES)
    def run(texts: pd.Series) -> pd.Series:
        index = index_of(held, coverage)

        def one(text: str | None) -> list[dict]:
            words = np.array([index.word.get(w, -1) for w in words_of(text)], np.int64)
            return [{"license": a, "coverage": float(c), "first": f, "last": z} for a, c, f, z in index.scan(words, coverage)]

        return texts.map(one, na_action=None)

    return docs.select(*[quoted(c) for c in docs.columns if c.lower() != "matches"], run(F.col("text").cast("string")).alias("matches"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's license matches: how many, their names, and name, coverage and span of each."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.to_json("matches").alias("spans"))
