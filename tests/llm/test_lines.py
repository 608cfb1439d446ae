from __future__ import annotations

import random

import pytest

from trackwake.llm import lines

BLANK = set(" \t\n\x0b\x0c\r")


def brute(rows: list[tuple]) -> dict:
    """Texts by (doc_id, text) with later windows removed, one row at a time."""
    first: dict = {}
    ordered = sorted(
        {(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)
    )
    for doc_id, text in ordered:
        parts = text.split("\n")
        for i in range(len(parts) - 2):
            first.setdefault(tuple(parts[i : i + 3]), ((doc_id is None, doc_id or 0), i))
    kept = {}
    for doc_id, text in rows:
        if text is None:
            kept[doc_id, text] = (None, 0, 0)
            continue
        parts, gone = text.split("\n"), set()
        for i in range(len(parts) - 2):
            window = tuple(parts[i : i + 3])
            if set("".join(window)) - BLANK and ((doc_id is None, doc_id or 0), i) > first[window]:
                gone |= {i, i + 1, i + 2}
        left = "\n".join(p for i, p in enumerate(parts) if i not in gone)
        kept[doc_id, text] = (left, len(parts), len(gone))
    return kept


def check(make_docs, rows, partitions=3):
    docs = make_docs(rows, extra="_starts line h1", partitions=partitions)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    expected = brute(rows)
    found = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(found, key=key) == sorted(((d, *expected[d, t]) for d, t in rows), key=key)


def test_edges(make_docs):
    passage = "first line\nsecond line\nthird line"
    check(
        make_docs,
        [
            (3, f"a\n{passage}\nb"),
            (1, f"x\ny\n{passage}"),
            (2, passage),
            (4, None),
            (5, ""),
            (6, "\n\n\n\n"),
            (7, " \n\n\t\n"),
            (8, "a\na\na\na\na\na"),
            (9, "first line\nsecond line\nother"),
            (10, "third line\nsecond line\nfirst line\n"),
            (11, passage + "\r"),
            (12, "\n".join(f"row {i % 7}" for i in range(4000))),
            (13, f"{passage}\n{passage}"),
            (None, passage),
            (2, passage),
            (2, f"q\n{passage}"),
        ],
    )


@pytest.mark.parametrize("seed", range(3))
def test_random(make_docs, seed):
    draw = random.Random(seed)
    rows = [
        (i, "\n".join(draw.choice(["a", "b", "", "c d"]) for _ in range(draw.randrange(0, 12))))
        for i in range(60)
    ]
    check(make_docs, rows, partitions=5)


def test_every_line_stays_somewhere(make_docs):
    draw = random.Random(9)
    rows = [(i, "\n".join(draw.choice("abc") for _ in range(9))) for i in range(40)]
    left = {p for r in lines.dedup_lines(make_docs(rows)).collect() for p in r.text.split("\n")}
    assert {"a", "b", "c"} <= left


def test_empty_table(make_docs):
    assert lines.dedup_lines(make_docs([(1, "a")]).limit(0)).collect() == []
