"""License scans: word-group fingerprints find candidates, alignment measures them.

Templates are cut into overlapping word groups, as long as the edits that the
coverage allows leave one whole, and put into an inverted index. The groups of a
text, winnowed where that leaves one too, meet the index in an equi-join; hits that lie together give a candidate region and a band of diagonals, and a
local alignment of words inside the band gives what is matched, and where.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trackwake.llm.common import checkpointed, spread_join

GROUP = 4
KEPT_OF = 2
BAND = 8
MIN_COVERAGE = 0.8
#: Templates are scanned for in slices of at most so many words.
SLICE_WORDS = 500_000

_TOKEN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15
_MATCH = ("license", "coverage", "matched", "word_start", "word_end", "start", "end")
_MATCHES = (
    "array<struct<license:string,coverage:double,matched:int,word_start:int,"
    "word_end:int,start:int,end:int>>"
)


class Template(NamedTuple):
    name: str
    text: str


# Notices by which works state their license.
TEMPLATES = (
    Template("mit-line", "Released under the MIT License."),
    Template("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-4.0-line", "Licensed under CC BY 4.0."),
    Template("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    Template("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    Template(
        "gpl-3.0-line",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    Template(
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions",
    ),
    Template(
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "bsd-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    Template(
        "lgpl-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    Template(
        "agpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    Template(
        "isc-permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    Template(
        "cc0-line",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
    Template(
        "unlicense-line",
        "This is free and unencumbered software released into the public domain.",
    ),
)


def tokens(text: str) -> list[str]:
    return [word.lower() for word in _TOKEN.findall(text)]


def word_hashes(found: Sequence[str]) -> np.ndarray:
    return np.fromiter(
        (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found)
    )


def word_groups(found: Sequence[str], group: int = GROUP) -> np.ndarray:
    """A 64-bit hash of every run of `group` words."""
    return grouped(word_hashes(found), group)


def grouped(own: np.ndarray, group: int) -> np.ndarray:
    """The hashes of runs from those of the words."""
    if len(own) < group:
        return np.zeros(0, np.uint64)
    n, mixed = len(own) - group + 1, np.zeros(len(own) - group + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(group):
            mixed = mixed * np.uint64(_BASE) + own[k : k + n] + np.uint64(1)
        return mixed ^ (mixed >> np.uint64(29))


def winnowed(hashes: np.ndarray, kept_of: int = KEPT_OF) -> np.ndarray:
    """Positions that are the smallest of some run of `kept_of` hashes, the last at a tie.

    Two texts that share kept_of + group - 1 words in a row share a kept hash.
    """
    if len(hashes) <= kept_of:
        return np.array([len(hashes) - 1 - hashes[::-1].argmin()] if len(hashes) else [], np.int64)
    n = len(hashes) - kept_of + 1
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, kept_of):
        later = hashes[k : k + n] <= least
        least[later] = hashes[k : k + n][later]
        at[later] = np.flatnonzero(later) + k
    return np.unique(at)


def edits(size: int, coverage: float) -> int:
    """How many of a template's words may be missing at that coverage."""
    return size - next(m for m in range(size + 1) if m >= coverage * size)


def cut(size: int, coverage: float) -> tuple[int, int]:
    """(group, kept_of) for a template of `size` words.

    With all allowed words missing or replaced, a run of size // (edits + 1)
    words stays whole. Groups, and winnowing where there is room for it, fit in it.
    """
    run = size // (edits(size, coverage) + 1)
    group = min(GROUP, run)
    return group, min(KEPT_OF, run - group + 1)


class Cut(NamedTuple):
    """Word groups of the templates that share a cut; `short` has what a short group needs.

    A group of fewer than GROUP words is common in any text. Its hit counts only
    if the words around lack no more of the template's than its edits allow.
    """

    group: int
    kept_of: int
    known: np.ndarray
    short: dict[int, list[tuple[int, int, int, frozenset[str]]]]


def cuts(templates: Sequence[Template], coverage: float) -> list[Cut]:
    by_cut: dict[tuple[int, int], list[list[str]]] = {}
    for t in templates:
        own = tokens(t.text)
        by_cut.setdefault(cut(len(own), coverage), []).append(own)
    found = []
    for (group, kept_of), of_cut in by_cut.items():
        short: dict = {}
        for own in of_cut if group < GROUP else ():
            need = len(own), edits(len(own), coverage), frozenset(own)
            for at, h in enumerate(word_groups(own, group).tolist()):
                short.setdefault(h, []).append((at, *need))
        known = np.unique(np.concatenate([word_groups(own, group) for own in of_cut]))
        found.append(Cut(group, kept_of, known, short))
    return found


def _around(found: list[str], at: int, needs, band: int) -> bool:
    """Whether a short group's hit can be in a match of any of its templates."""
    for t_at, size, missing, own in needs:
        begin = at - t_at
        near = found[max(0, begin - 2 * band) : max(0, begin + size + 2 * band)]
        if len(own.difference(near)) <= missing:
            return True
    return False


def inverted_index(
    spark: SparkSession, templates: Sequence[Template], coverage: float = MIN_COVERAGE
) -> DataFrame:
    """(mark, template, t_at) with every word group of the templates, short ones included.

    Texts are winnowed and templates are not, so that a text's kept group meets
    its template wherever it lies in it.
    """
    rows = [
        (int(h.astype(np.int64)), t.name, at)
        for t in templates
        for own in [tokens(t.text)]
        for at, h in enumerate(word_groups(own, cut(len(own), coverage)[0]))
    ]
    return spark.createDataFrame(rows, "mark long, template string, t_at int")


class Match(NamedTuple):
    matched: int
    first: int
    last: int


def banded_alignment(
    template: Sequence[str], words: Sequence[str], low: int, high: int
) -> Match:
    """The best local alignment with diagonals (word - template place) low..high.

    A match scores 2, any other step -1. Gives the template words matched and the
    first and last word aligned; at a tie the earliest end wins.
    """
    width = high - low + 1
    # Per diagonal: score, matched, first word.
    above = [(0, 0, -1)] * (width + 1)
    best, found = 0, Match(0, 0, -1)
    for t, word in enumerate(template):
        row = [(0, 0, -1)] * (width + 1)
        for d in range(width):
            w = t + low + d
            if not 0 <= w < len(words):
                continue
            if words[w] == word:
                score, matched, first = above[d]
                cell = (score + 2, matched + 1, first if score else w)
            else:
                cell = (above[d][0] - 1, *above[d][1:])
            for other in (above[d + 1], row[d - 1] if d else (0, 0, -1)):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            row[d] = cell if cell[0] > 0 else (0, 0, -1)
            if row[d][0] > best:
                best, found = row[d][0], Match(row[d][1], row[d][2], w)
        above = row
    return found


_HIT = pa.struct([("mark", pa.int64()), ("at", pa.int32())])
_FOUND = "_id long, _key long, text string, hits array<struct<mark: long, at: int>>"


def _marks(docs: DataFrame, index: list[Cut], band: int) -> DataFrame:
    """Rows whose whole text has word groups that the index has, with these groups.

    Texts without any go no further than the task that reads them.
    """

    def kept_groups(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = tokens(text)
        own = word_hashes(found)
        marks, places = [], []
        for part in index:
            hashes = grouped(own, part.group)
            at = winnowed(hashes, part.kept_of)
            at = at[np.isin(hashes[at], part.known)]
            if part.short:
                near = [
                    _around(found, k, part.short[h], band)
                    for k, h in zip(at.tolist(), hashes[at].tolist())
                ]
                at = at[np.array(near, bool)]
            marks.append(hashes[at].astype(np.int64))
            places.append(at)
        return np.concatenate(marks), np.concatenate(places)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for n, text in enumerate(batch.column(2)):
                marks, places = kept_groups(text.as_py() or "")
                if len(marks):
                    rows.append(n)
                    hits.append([{"mark": m, "at": p} for m, p in zip(marks.tolist(), places.tolist())])
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(hits, pa.list_(_HIT))], [*some.schema.names, "hits"]
            )

    return docs.mapInArrow(kept, _FOUND)


def _regions(hits: DataFrame, sizes: DataFrame, band: int) -> DataFrame:
    """(_id, _key, template, low, high): runs of neighbouring diagonals with hits.

    Copies of a template lie on diagonals further apart than half its length, so
    each begins a region of its own.
    """
    sized = spread_join(hits, sizes, "template", F.col("_key"))
    placed = sized.select(
        "_id", "_key", "template", "size", (F.col("at") - F.col("t_at")).alias("_diagonal")
    ).distinct()
    order = Window.partitionBy("_id", "_key", "template").orderBy("_diagonal")
    gap = F.col("_diagonal") - F.lag("_diagonal").over(order)
    apart = gap > F.least(F.lit(band), F.floor(F.col("size") / 2))
    opened = F.when(gap.isNull() | apart, 1).otherwise(0)
    return (
        placed.withColumn("_open", opened)
        .withColumn("_region", F.sum("_open").over(order))
        .groupBy("_id", "_key", "template", "_region")
        .agg(F.min("_diagonal").alias("low"), F.max("_diagonal").alias("high"))
    )


def _align(
    found: list[str], spans: list[tuple[int, int]], region, template: list[str], band: int, coverage: float
) -> Iterator[tuple]:
    """(matched, word span, character span) of all matches that a region's words hold.

    The words of a match are struck out and the rest is aligned again, so copies
    that lie side by side are each found; what two regions both find is one match.
    """
    begin = max(0, region["low"] - band)
    words: list[str | None] = list(found[begin : region["high"] + len(template) + band])
    low, high = region["low"] - begin - band, region["high"] - begin + band
    own = set(template)
    while sum(word in own for word in words) >= coverage * len(template):
        match = banded_alignment(template, words, low, high)
        if match.matched < max(1, coverage * len(template)):
            return
        first, last = begin + match.first, begin + match.last
        yield match.matched, first, last + 1, spans[first][0], spans[last][1]
        words[match.first : match.last + 1] = [None] * (match.last + 1 - match.first)


def _apart(rows: list[dict]) -> list[dict]:
    """Of matches that overlap, the one with most words, then coverage, then the first."""
    starts: list[int] = []
    kept: list[dict] = []
    best_first = sorted(rows, key=lambda r: (-r["matched"], -r["coverage"], r["word_start"], r["license"]))
    for row in best_first:
        at = bisect_left(starts, row["word_start"])
        clear = not at or kept[at - 1]["word_end"] <= row["word_start"]
        if clear and (at == len(kept) or row["word_end"] <= kept[at]["word_start"]):
            starts.insert(at, row["word_start"])
            kept.insert(at, row)
    return kept


def _aligned(band: int, coverage: float):
    """A column function from a text and its regions to what matches in it."""

    @F.pandas_udf(_MATCHES)
    def matches(texts: pd.Series, regions: pd.Series) -> pd.Series:
        answers = []
        for content, of_text in zip(texts, regions, strict=True):
            spans = [m.span() for m in _TOKEN.finditer(content)]
            found = [content[a:b].lower() for a, b in spans]
            rows = []
            for region in of_text:
                template = list(region["words"])
                for match in _align(found, spans, region, template, band, coverage):
                    share = match[0] / len(template)
                    rows.append(dict(zip(_MATCH, (region["template"], share, *match), strict=True)))
            answers.append(_apart(rows))
        return pd.Series(answers)

    return matches


def _slices(templates: Sequence[Template], words: int) -> list[list[Template]]:
    slices, held = [[]], 0
    for template in templates:
        size = len(tokens(template.text))
        if slices[-1] and held + size > words:
            slices.append([])
            held = 0
        slices[-1].append(template)
        held += size
    return slices


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    *,
    id: str = "doc_id",
    text: str = "text",
    band: int = BAND,
    coverage: float = MIN_COVERAGE,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """doc_id, license, coverage, matched, word_start, word_end, start, end per match.

    `coverage` of a match is the share of the template's words that align with
    the text in order; spans are in words and in characters, ends exclusive.
    Texts are compared by their lower-cased runs of letters and digits. Every
    place of a text that holds a template but for as many missing or replaced
    words as `coverage` allows is reported; of templates that fit one
    place, that with most words matched, then the larger coverage. Copies side by
    side are a match each. A null or empty text has no match, repeated rows have as
    many results. Templates of fewer than four words are an error; a list of any
    length is worked off in slices whose index is small enough to send along.
    """
    if short := [t.name for t in templates if len(tokens(t.text)) < GROUP]:
        raise ValueError(f"templates of fewer than {GROUP} words: {short}")
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(id).cast("long").alias("_id"),
        F.xxhash64(F.col(id), F.col(text)).alias("_key"),
        F.col(text).alias("text"),
    )
    hits, read = [], []
    for number, part in enumerate(_slices(templates, slice_words)):
        found = checkpointed(_marks(keyed, cuts(part, coverage), band))
        read.append(found.select("_id", "_key", "text", F.lit(number).alias("_slice")))
        # Rows alike in id and text have the same hits; they count once here.
        marks = found.select("_id", "_key", F.inline("hits")).distinct()
        hits.append(spread_join(marks, inverted_index(spark, part, coverage), "mark", F.col("_key")))
    texts = (
        reduce(DataFrame.union, read)
        .groupBy("_id", "_key", "_slice")
        .agg(F.first("text").alias("text"), F.count("*").alias("_copies"))
        .groupBy("_id", "_key")
        .agg(F.first("text").alias("text"), F.max("_copies").alias("_copies"))
    )
    table = spark.createDataFrame(
        [(t.name, len(w), w) for t in templates for w in [tokens(t.text)]],
        "template string, size int, words array<string>",
    )
    regions = _regions(reduce(DataFrame.union, hits), table.drop("words"), band)
    of_text = (
        spread_join(regions, table.drop("size"), "template", F.col("_key"))
        .groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey"))
        .agg(F.collect_list(F.struct("template", "words", "low", "high")).alias("regions"))
    )
    met = texts.join(
        of_text, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_key") == F.col("_rkey"))
    )
    matches = _aligned(band, coverage)("text", "regions")
    copied = met.select(F.col("_id").alias("doc_id"), "_copies", F.inline(matches))
    every = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")
    return copied.select("*", every).drop("_copies", "_copy")
