from __future__ import annotations

import random

import pytest

from trackwake.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), rounds=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > rounds * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = float(rounds * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def rows_of(seed: int, sources: list) -> list:
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        source = draw.choices(sources, range(1, len(sources) + 1))[0]
        rows.append((i, "w " * draw.randrange(0, 60), "en", source))
    return rows


@pytest.mark.parametrize("sources", [["a"], ["b", "a", None], ["é", "z", "Z", "", None, "10", "9"]])
def test_shares(make_docs, sources):
    rows = rows_of(7, sources)
    sizes: dict = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets = brute_targets(sizes)
    got = mixing.document_shares(make_docs(rows, extra="size taken copies")).collect()
    assert len(got) == len(rows)
    taken: dict = {}
    for row in got:
        assert row.size == len(rows[row.doc_id][1].split())
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(targets[row.source])
        assert 0 <= row.taken <= 3 * row.size
        taken[row.source] = taken.get(row.source, 0) + row.taken
    for source in sizes:
        assert taken[source] == pytest.approx(targets[source], abs=0.51)
    again = mixing.document_shares(make_docs(rows, partitions=7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_edges(make_docs):
    rows = [(None, None), (None, "a b"), (1, ""), (2, "x y z"), (2, "x y z"), (2, "p q r")]
    got = mixing.document_shares(make_docs(rows)).collect()
    assert len(got) == 6
    assert sum(r.taken for r in got) == sum(r.size for r in got) == 11
    assert mixing.document_shares(make_docs(rows).limit(0)).collect() == []
    empty = mixing.document_shares(make_docs([(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_mix_has_the_words_taken(make_docs):
    rows = rows_of(3, ["a", "b", "c", "d"])
    rows = [(i, f"  {i} {text} é\n", lang, s) for i, text, lang, s in rows]
    docs = make_docs(rows, extra="_doc _copy finish")
    mix = mixing.mix_sources(docs)
    assert mix.columns == docs.columns
    got = mix.collect()
    words: dict = {}
    for row in got:
        full = rows[row.doc_id][1]
        assert full.startswith(row.text)
        words[row.doc_id] = words.get(row.doc_id, 0) + len(row.text.split())
    shares = {r.doc_id: r.taken for r in mixing.document_shares(docs).collect()}
    # The mix breaks ties of the shuffle by text digests; doc_ids here have none.
    assert words == {d: n for d, n in shares.items() if n}
    partial = sum(rows[r.doc_id][1] != r.text for r in got)
    assert partial <= 4


def test_hot_source_is_spread(make_docs):
    docs = make_docs([(i, "w", "en", "hot") for i in range(2000)])
    slots = mixing.virtual_copies(docs, size=mixing.word_count(docs.text), slots=64)
    plan = slots._jdf.queryExecution().toString()
    assert "_slot" in plan and "CartesianProduct" not in plan
