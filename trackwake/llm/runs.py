"""Periodic runs of words within a text, by descending-LCP Kruskal.

The suffixes of a text's word sequence are classed by their common prefixes.
Classes are united in the order of falling LCP (longest common prefix) of
neighbours in the suffix array; each keeps its positions in order. Two positions
that become neighbours in a united class, at a distance p within the present LCP,
share that many words, so they seed a repetition of period p. The pair that no
common word precedes is the run's beginning, and the LCP tells its end: every run
is met once, with its smallest period, because a smaller one would have put a
position between the two before.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has at least this many words and repeats its period this often.
MIN_WORDS = 6
MIN_REPEATS = 4

_RESULT = (
    "doc_id {id}, n_words long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def _repeats(codes: np.ndarray, width: int) -> bool:
    """Whether a window of so many words may occur twice; hashes can only add cases."""
    if len(codes) <= width:
        return False
    mixed = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(mixed)].astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return bool((mixed[1:] == mixed[:-1]).any())


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ."""
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    n, width = len(codes), 1
    while width < n and levels[-1].max() + 1 < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = levels[-1][width:] + 1
        pairs = levels[-1] * (n + 1) + after
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return levels


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes next to each other in the suffix array, with their LCP."""
    levels = _ranks(codes)
    n = len(codes)
    order = np.argsort(levels[-1])
    left, right = order[:-1].copy(), order[1:].copy()
    a, b, common = left.copy(), right.copy(), np.zeros(n - 1, np.int64)
    # Ranks of 2^k words are equal where the words are; ends of the text differ
    # from all else, so equal ranks never reach beyond it.
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        same &= np.maximum(a, b) + (1 << k) <= n
        step = same.astype(np.int64) << k
        a, b, common = a + step, b + step, common + step
    return left, right, common


def word_runs(
    codes: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS
) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word codes, in order.

    A run is a longest stretch with smallest period p, of at least `min_words`
    words and `min_repeats` * p words; `min_repeats` is two or more.
    """
    # A run's first word and the one a period on share length - p words or more.
    least = max(1, min_words - min_words // min_repeats)
    if not _repeats(codes, least):
        return []
    left, right, common = _neighbours(codes)
    long = common >= least
    left, right, common = left[long], right[long], common[long]
    order = np.argsort(-common, kind="stable")
    held: dict[int, list[int]] = {}
    root: dict[int, int] = {}

    def find(at: int) -> int:
        while (up := root.setdefault(at, at)) != at:
            root[at] = at = root[up]
        return at

    found = []
    word = codes.tolist()
    for x, y, lcp in zip(left[order].tolist(), right[order].tolist(), common[order].tolist()):
        x, y = find(x), find(y)
        few, many = held.pop(x, None) or [x], held.pop(y, None) or [y]
        if len(few) > len(many):
            few, many, x, y = many, few, y, x
        root[x] = y
        new = set(few)
        if len(few) * 16 < len(many):
            for at in few:
                many.insert(bisect_left(many, at), at)
        else:
            many = sorted(many + few)
        held[y] = many
        for at in few:
            place = bisect_left(many, at)
            for i, j in (
                (many[place - 1] if place else at, at),
                (at, many[place + 1] if place + 1 < len(many) else at),
            ):
                period = j - i
                if not period or (i in new and j in new) or period * (min_repeats - 1) > lcp:
                    continue
                if period + lcp >= min_words and (not i or word[i - 1] != word[j - 1]):
                    found.append((i, period + lcp, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those of a run that follow its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def text_runs(text: bytes) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs and collapsed text of a text in UTF-8."""
    words = text.split()  # bytes.split() parts at exactly the six blanks
    numbers: dict[bytes, int] = {}
    codes = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)
    )
    runs = word_runs(codes)
    return len(words), runs, _collapsed(words, runs) if runs else b" ".join(words)


def _batch_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        # A few texts at a time, so that results stay small beside their input.
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(1).cast(pa.binary()).to_pylist()
            rows = [text_runs(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array(
                        [[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs, _ in rows],
                        pa.list_(entry),
                    ),
                    pa.array([c for _, _, c in rows], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def find_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs and the collapsed text for every row of `docs`.

    `runs` holds (start, length, period) in word numbers from 0, by start, then
    period; `collapsed` the words that no run repeats, joined by single spaces. A
    null, empty or blank text has no word and no run and collapses to "". Texts of
    any length are taken whole; each is worked out in one task, in memory of a
    few numbers a word. Repeated rows give as many results, ids may be null, and
    other columns are neither read nor returned. No shuffle takes place.
    """
    read = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(_batch_runs, _RESULT.format(id=kind))
