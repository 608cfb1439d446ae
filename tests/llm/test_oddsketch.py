from __future__ import annotations

import random
import re

import numpy as np
import pytest

from trackwake.llm import oddsketch


def brute_set(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_groups(rows, width, similarity=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all with all."""
    sets = [brute_set(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    found = [least.get(find(i)) for i in range(len(rows))]
    return sorted(
        repr((d, len(s), c, d == c)) for (d, _), s, c in zip(rows, sets, found)
    )


def as_rows(frame):
    return sorted(repr(tuple(r)) for r in frame.collect())


def texts(seed, groups=14, copies=7, shared=True):
    """Groups of copies with more and more words changed, many around the limit."""
    draw = random.Random(seed)
    word = lambda: f"{draw.choice(['Lo', 'rem', 'ïp', 'sum'])}{draw.randrange(300)}"
    passage = [word() for _ in range(40)]
    rows, number = [], iter(range(10_000))
    for _ in range(groups):
        words = [word() for _ in range(draw.randrange(30, 300))]
        if shared:
            words += passage
        for c in range(copies):
            copy = list(words)
            for _ in range(c * len(copy) // 90):
                copy[draw.randrange(len(copy))] = word()
            rows.append((next(number), " ".join(copy)))
    return rows


ODD = [
    (None, "one two three"), (5000, "ONE two\n three"), (5001, None), (5002, ""), (5003, " \t"),
    (None, ""), (5004, "x"), (5004, "x"), (5005, "y " * 5000), (5006, "Y"), (5007, "é a b c d e"),
    (5008, "É a b c d e"),
]


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 5)])
def test_groups_match_brute_force(make_docs, seed, width):
    rows = texts(seed) + ODD
    got = oddsketch.near_duplicates(make_docs(rows, extra="node row n_shingles root key kept"), width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert as_rows(got) == brute_groups(rows, width)


@pytest.mark.parametrize("chars", [8 << 20, 20_000])
def test_crowds_match_brute_force(make_docs, monkeypatch, chars):
    """Bands shared by many sets, in one block and in several."""
    monkeypatch.setattr(oddsketch, "PAIR_LIMIT", 4)
    monkeypatch.setattr(oddsketch, "BLOCK_CHARS", chars)
    rows = texts(3, groups=2, copies=45, shared=False) + texts(4, groups=5)
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    assert as_rows(oddsketch.near_duplicates(make_docs(rows), width=4)) == brute_groups(rows, 4)


def test_hot_copies_are_dealt(make_docs, monkeypatch):
    monkeypatch.setattr(oddsketch, "SPLIT_ROWS", 5)
    rows = texts(6, groups=4) + [(9000 + k, "the same text in all of these rows") for k in range(60)]
    rows += [(9000, "the same text in all of these rows")] * 3
    assert as_rows(oddsketch.near_duplicates(make_docs(rows))) == brute_groups(rows, 5)


def test_no_rows(make_docs):
    docs = make_docs(ODD)
    assert oddsketch.near_duplicates(docs.limit(0)).collect() == []
    assert oddsketch.near_duplicates(docs.where("text IS NULL")).count() == 1
    with pytest.raises(ValueError):
        oddsketch.near_duplicates(docs, similarity=50)


def sets_of(similarity, size, draw):
    """Two sets of just this similarity."""
    both = round(size * 2 * similarity / (1 + similarity))
    pool = draw.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
    return pool[:size], np.concatenate([pool[:both], pool[size : 2 * size - both]])


@pytest.mark.parametrize("size", [9, 100, 2000])
def test_sketches_keep_what_is_similar(size):
    draw, limit = np.random.default_rng(size), oddsketch.sketch_limit()
    apart = {0.8: [], 0.3: []}
    shared = 0
    for similarity, found in apart.items():
        for _ in range(400):
            a, b = (oddsketch.min_samples(s) for s in sets_of(similarity, size, draw))
            x, y = oddsketch.odd_sketch(a), oddsketch.odd_sketch(b)
            found.append(int(np.bitwise_count(x ^ y).sum()))
            shared += similarity == 0.8 and bool((oddsketch.band_keys(a) == oddsketch.band_keys(b)).any())
    assert max(apart[0.8]) <= limit and shared == 400
    assert np.mean(np.array(apart[0.3]) > limit) > 0.9
    # The estimate that the limit rests on.
    assert abs(np.mean(apart[0.8]) - 68.6) < 6


def test_set_is_the_brute_force_set():
    for _, text in texts(8, groups=3) + ODD:
        for width in (1, 4, 5):
            assert len(oddsketch.shingle_set(text, width)) == len(brute_set(text, width))
    a, b = oddsketch.shingle_set("a b c d", 4), oddsketch.shingle_set("d c b a", 4)
    assert not oddsketch.linked(a, b) and oddsketch.linked(a, a)
