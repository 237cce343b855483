"""Windows of up to 12 letters A-Z as numbers, read as such in base 36: a window is a long in shuffles and aggregations, and its letters
are only spelled for rows of the result. A task tallies its windows by parts of several batches before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import peptides as P

#: Letters that a task tallies at once.
LETTERS = 4_000_000

#: Digits 10 to 35 of this base are A to Z, and a long has room for twelve.
BASE, MOST = 36, 12


def spelled(code: Column | str) -> Column:
    """The letters of a number: in base 36 it reads as its window."""
    return F.conv(P.col(code).cast("string"), 10, BASE)


def windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, codes, at, row, left) of the windows of k letters of all texts: letters of all texts, from 1; where a window begins in them;
    its text; how many letters follow it there."""
    if k > MOST:
        raise ValueError(f"windows of more than {MOST} letters have no number")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.int64) - 64
    if len(letters) and (letters.min() < 1 or letters.max() > 26):
        raise ValueError("windows are numbered for letters A-Z only")
    ends = ends - ends[0]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    left = ends[1:][row] - np.arange(len(letters)) - k
    at = np.flatnonzero(left >= 0)
    codes = np.zeros(max(0, len(letters) - k + 1), np.int64)
    for i in range(k):
        codes = codes * BASE + (letters[i : i + len(codes)] + 9)
    return letters, codes[at], at, row[at], left[at]


def tallied(seqs: DataFrame, seq: str, schema: str, tally: Callable[[pa.Array], dict[str, np.ndarray]]) -> DataFrame:
    """What tally makes of the texts of several batches at once; rows with the same code lie in one partition."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            found = tally(pa.chunked_array(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], list(found))

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size += batch.column(0).nbytes
            if size >= LETTERS:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    return seqs.select(seq).filter(F.col(seq).isNotNull()).mapInArrow(parts, schema).repartition("code")


def sorted_groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): an order by code, equal ones as they were, and where each code's group begins in it."""
    order = np.argsort(codes, kind="stable")
    own = codes[order]
    return order, np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)


def distinct_windows(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code): the distinct windows of k letters of all sequences."""

    def tally(texts: pa.Array) -> dict[str, np.ndarray]:
        codes = np.sort(windows(texts, k)[1])
        return {"code": codes[np.flatnonzero(np.diff(codes, prepend=-1))]}

    return tallied(seqs, seq, "code long", tally).distinct()


def window_counts(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code, n, n_sequences, first_place): how often each window of k letters is, in how many rows, and its first place in any, from 0."""

    def tally(texts: pa.Array) -> dict[str, np.ndarray]:
        _, codes, at, row, _ = windows(texts, k)
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        order, begin = sorted_groups(codes)
        own, row, at = codes[order], row[order], at[order] - (np.cumsum(lengths) - lengths)[row[order]]
        if not len(own):
            return {"code": own, "n": own, "n_sequences": own, "first_place": own.astype(np.int32)}
        fresh = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1])].astype(np.int64)
        return {"code": own[begin], "n": np.diff(np.r_[begin, len(own)]), "n_sequences": np.add.reduceat(fresh, begin), "first_place": np.minimum.reduceat(at, begin).astype(np.int32)}

    rows = tallied(seqs, seq, "code long, n long, n_sequences long, first_place int", tally)
    return rows.groupBy("code").agg(F.sum("n").alias("n"), F.sum("n_sequences").alias("n_sequences"), F.min("first_place").alias("first_place"))


def neighbours(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(code, before, after): for each window of k letters the sets of letters that stand before and after it in any sequence longer than
    k, as bits (1 << letter from A = 1)."""

    def tally(texts: pa.Array) -> dict[str, np.ndarray]:
        texts = texts.filter(pc.greater(pc.binary_length(texts), k))
        letters, codes, at, row, left = windows(texts, k)
        if not len(codes):
            return {"code": codes, "before": codes.astype(np.int32), "after": codes.astype(np.int32)}
        first = np.r_[True, row[1:] != row[:-1]]
        before = np.where(first, 0, 1 << letters[at - 1]).astype(np.int32)
        after = np.where(left == 0, 0, 1 << letters[np.minimum(at + k, len(letters) - 1)]).astype(np.int32)
        order, begin = sorted_groups(codes)
        return {"code": codes[order][begin], "before": np.bitwise_or.reduceat(before[order], begin), "after": np.bitwise_or.reduceat(after[order], begin)}

    rows = tallied(seqs, seq, "code long, before int, after int", tally)
    return rows.groupBy("code").agg(F.bit_or("before").alias("before"), F.bit_or("after").alias("after"))
