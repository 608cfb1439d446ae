from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from trackwake.llm import phrases


def brute_phrases(rows, min_count=30, longest=4, covered=80, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    often = {key: a for key, a in f.items() if a >= min_count and len(key[1]) > 1}
    held = {}
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = lang, p[i : i + m]
                held[key] = max(held.get(key, 0), a)
    found = []
    for (lang, p), a in often.items():
        if 100 * held.get((lang, p), -1) >= covered * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def texts(seed, docs=300, words=120, letters=9):
    draw = random.Random(seed)
    fixed = [" ".join(f"W{draw.randrange(letters)}" for _ in range(5)) for _ in range(4)]
    rows = [(None, "en"), ("", None), (" \t\n", "de"), ("...", "fr")]
    for _ in range(docs):
        parts = []
        for _ in range(words):
            parts.append(draw.choice(["a", "b", "É", "é", "c\x85d", "x-y", *map(str, range(letters))]))
            parts.append(draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]))
            if draw.random() < 0.1:
                parts.append(draw.choice(fixed) + " ")
        rows.append(("".join(parts), draw.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed,size", [(1, 1 << 20), (2, 500), (3, 3000)])
def test_phrases_match_brute_force(make_docs, monkeypatch, seed, size):
    monkeypatch.setattr(phrases, "SHARD_WORDS", size)
    monkeypatch.setattr(phrases, "RANGE_WORDS", size)
    rows = texts(seed)
    docs = make_docs([(k, t, lang) for k, (t, lang) in enumerate(rows)], extra="id rank a l r n score word")
    got = phrases.mine_phrases(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows)
    assert len(want) > 100 and len({row[0] for row in want}) == 3
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_other_limits(make_docs):
    rows = texts(5, docs=60)
    docs = make_docs([(k, t, lang) for k, (t, lang) in enumerate(rows)])
    got = phrases.mine_phrases(docs, min_count=8, longest=3, covered=60, top=7)
    assert sorted(map(tuple, got.collect())) == sorted(
        brute_phrases(rows, min_count=8, longest=3, covered=60, top=7)
    )


def test_repeated_rows_and_one_long_text(make_docs):
    rows = [("new york city " * 3000, "en")] + [("New York is big", "en")] * 40 + [(None, None)] * 5
    docs = make_docs([(7, t, lang) for t, lang in rows])
    assert sorted(map(tuple, phrases.mine_phrases(docs).collect())) == sorted(brute_phrases(rows))


def test_no_rows(make_docs):
    docs = make_docs([(1, None), (2, "a b c")])
    assert phrases.mine_phrases(docs.limit(0)).collect() == []
    assert phrases.mine_phrases(docs).collect() == []


def test_permutation_can_be_undone():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) * 2 + 1
    keys = np.concatenate([keys, np.arange(5000, dtype=np.uint64), [np.uint64(2**64 - 1)]])
    mixed = phrases.permuted(keys)
    assert (phrases.restored(mixed) == keys).all()
    assert len(np.unique(mixed)) == len(np.unique(keys))


@pytest.mark.parametrize("size,bits", [(1, 0), (1, 12), (2, 4), (300, 4), (40_000, 9), (5000, 0)])
def test_filters_lose_nothing(size, bits):
    draw = np.random.default_rng(size)
    keys = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64))
    if bits:
        keys = np.unique((keys >> np.uint64(bits)) | (np.uint64(5) << np.uint64(64 - bits)))
    counts = draw.choice([1, 2, 254, 255, 256, 10**12], len(keys)).astype(np.int64)
    packed = phrases.pack_filter(keys, counts, bits)
    back = phrases.unpack_filter(packed)
    assert (back[0] == keys).all() and (back[1] == counts).all()
    merged = phrases.merge_filters([packed, phrases.pack_filter(keys[:1], counts[:1], bits), packed])
    assert (merged[0] == keys).all() and merged[1].sum() == 2 * counts.sum() + counts[0]


def test_slots_may_hold_many_keys():
    keys = np.arange(1000, dtype=np.uint64) + np.uint64(1 << 60)
    packed = phrases.pack_filter(keys, np.ones(1000, np.int64), 0)
    assert (phrases.unpack_filter(packed)[0] == keys).all()
