from __future__ import annotations

import random

import pytest
import xxhash

from trackwake.llm import simhash
from trackwake.llm.components import components


def brute_print(text) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(n: int) -> int:
    return n & (1 << 64) - 1


def brute_components(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(
    "text", [None, "", " \n", "One", "one TWO", "a b c d É é \x1c x", "w " * 9000, "x y z " * 50 + " "]
)
def test_fingerprints(text):
    assert unsigned(simhash.text_fingerprint(text)) == brute_print(text)


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def clustered(seed: int, clusters: int, size: int) -> list[int]:
    draw, prints = random.Random(seed), set()
    for _ in range(clusters):
        at = draw.getrandbits(64)
        for _ in range(size):
            prints.add(at)
            for _ in range(draw.randrange(1, 4)):
                at ^= 1 << draw.randrange(64)
    # A crowd that shares two segments, to be linked without pairs.
    base = draw.getrandbits(43)
    prints |= {base | draw.getrandbits(7) << 50 for _ in range(150)}
    return sorted(prints)


@pytest.mark.parametrize("limit", [3, 128])
def test_links_connect_what_is_close(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    prints = clustered(5, 25, 12)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    links = simhash.print_links(frame)
    pairs = [(unsigned(r.a), unsigned(r.b)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    got = {unsigned(r.node): unsigned(r.root) for r in components(links).collect()}
    expected = brute_components(prints)
    groups: dict = {}
    for p, root in zip(prints, expected):
        groups.setdefault(root, set()).add(got.get(p, p))
    assert all(len(names) == 1 for names in groups.values())
    assert len({n for names in groups.values() for n in names}) == len(groups)


def texts(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    word = lambda: draw.choice(["lo", "rem", "ip", "sum", "do"]) + str(draw.randrange(40))
    rows: list[tuple] = [(900, None), (901, ""), (902, " \n"), (None, "one two"), (903, "one two")]
    for k in range(12):
        words = [word() for _ in range(draw.randrange(60, 400))]
        for c in range(6):
            copy = list(words)
            for _ in range(c % 3):
                copy[draw.randrange(len(copy))] = word()
            rows.append((k * 10 + c, " ".join(copy)))
    rows.append((0, rows[5][1]))
    return rows


def test_groups_match_brute_force(make_docs):
    rows = texts(11)
    got = simhash.simhash_groups(make_docs(rows, extra="print component_id fingerprint")).collect()
    assert len(got) == len(rows)
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints)
    least: dict = {}
    for (doc_id, _), root in zip(rows, roots):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    expected = sorted(
        (d is None, d or 0, p, least.get(r)) for (d, _), p, r in zip(rows, prints, roots)
    )
    assert expected == sorted(
        (r.doc_id is None, r.doc_id or 0, unsigned(r.fingerprint), r.component_id) for r in got
    )


def test_one_of_each_group_stays(make_docs):
    rows = texts(12)
    docs = make_docs(rows, extra="_doc component_id _print")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))
    assert simhash.keep_one(docs.limit(0)).collect() == []
    alone = simhash.keep_one(make_docs([(None, "x"), (None, "x")])).collect()
    assert [r.doc_id for r in alone] == [None]


def test_groups_without_an_id_of_their_own_keep_a_row(make_docs):
    draw = random.Random(13)
    text = lambda: " ".join(str(draw.randrange(10**6)) for _ in range(60))
    unnamed, repeated, named = [text() for _ in range(5)], [text() for _ in range(3)], text()
    rows = [(None, t) for t in unnamed * 2] + [(7, t) for t in repeated]
    rows += [(8, repeated[0]), (None, named), (9, named)]
    kept = simhash.keep_one(make_docs(rows)).collect()
    expected = [(None, t) for t in unnamed] + [(7, t) for t in repeated] + [(9, named)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, expected))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 180)] + [(100, 100), (101, 100)]
    links = spark.createDataFrame(path + star, "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)}
    assert components(links.limit(0)).collect() == []
