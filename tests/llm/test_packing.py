from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackwake.llm import packing
from trackwake.llm.common import read_table
from trackwake.llm.queries import tokenizer_file

PATH = tokenizer_file()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "",
    " ",
    "  double  spaces ",
    "It's a test, isn't it?\n\n\n New  line.\t tab \r\n",
    "<|endoftext|> inside <|endoftext|>",
    " nbsp    em \x1c \x85 sep",
    "Éèê ñ ü 😀 漢字 عربى ́ ǅ ʼn ﬁ",
    "word,word; a.b 3.14 12 345abc x_y __ -- don't DON'T 'S we'll",
    "a" * 5000,
    "\n" * 3000,
    "trail ",
    "\ttab lead",
]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encoder = packing.TextEncoder(PATH)
    draw = random.Random(1)
    marks = [" ", "  ", "\n", "a", "é", ".", "'s", "1", " ", "　", "b c", "<|endoftext|>", "\x1d", "ß!"]
    texts = TEXTS + ["".join(draw.choices(marks, k=draw.randrange(30))) for _ in range(1500)]
    for text in texts:
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == expected, repr(text)


def test_ids_of_a_corpus(spark, tokenizer):
    encoder = packing.TextEncoder(PATH)
    for row in read_table(spark, "/root/testdata/sf0.001", "documents").collect():
        expected = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert encoder.encode(row.text or "") == expected


def padding(size: int, length: int) -> int:
    return 0 if size & (size - 1) == 0 else length - size


def brute_cost(positions, penalties, length):
    cost = [0.0]
    for j in range(1, len(positions)):
        steps = [
            cost[i] + padding(positions[j] - positions[i], length)
            for i in range(j)
            if positions[j] - positions[i] <= length
        ]
        cost.append(min(steps) + penalties[j])
    return cost[-1]


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    draw = random.Random(seed)
    length = draw.choice([8, 16, 64])
    positions, penalties = [0], [0.0]
    for _ in range(draw.randrange(1, 60)):
        positions.append(positions[-1] + draw.randrange(1, length + 1))
        penalties.append(draw.choice([0.0, 2.0, 2.5]))
    cuts = packing.best_cuts(np.array(positions), np.array(penalties), length)
    assert cuts[-1] == len(positions) - 1
    steps = np.diff([0, *(positions[c] for c in cuts)])
    assert max(steps) <= length
    total = sum(padding(int(s), length) for s in steps) + sum(penalties[c] for c in cuts)
    assert total == brute_cost(positions, penalties, length)


def unpack(pieces):
    """Check gapless sequences and join each document again."""
    by_sequence: dict = {}
    by_doc: dict = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= packing.LENGTH
        sizes.append(at)
    return by_doc, sizes


def test_round_trip(spark, make_docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "x y")]
    rows += [(100 + i, "Some words. " * (i * 37 % 400)) for i in range(60)]
    docs = make_docs(rows, extra="ids offset start length")
    for block in (700, packing.BLOCK_TOKENS):
        pieces = packing.pack_documents(docs, tokenizer=PATH, block=block).collect()
        by_doc, _ = unpack(pieces)
        assert len(by_doc) == len(rows)
        for doc_id, text in rows:
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            parts = sorted(by_doc[doc_id, len(ids)])
            joined = b"".join(p[1] for p in parts)
            assert np.frombuffer(joined, "<u4").tolist() == ids
            assert [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) // 4 for p in parts)])[:-1].tolist()


def test_little_padding_and_repeated_rows(spark, make_docs):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    twice = docs.union(docs)
    _, sizes = unpack([p for p in packing.pack_documents(docs, tokenizer=PATH).collect()])
    assert sum(padding(s, 1024) for s in sizes) < 0.01 * sum(sizes)
    once = packing.pack_documents(docs, tokenizer=PATH).agg({"length": "sum"}).first()[0]
    assert packing.pack_documents(twice, tokenizer=PATH).agg({"length": "sum"}).first()[0] == 2 * once
    assert packing.pack_documents(docs.limit(0), tokenizer=PATH).collect() == []

