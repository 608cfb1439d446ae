from __future__ import annotations

import random

import pytest

from trackwake.llm import licenses
from trackwake.llm.common import read_table

APACHE = next(t for t in licenses.TEMPLATES if t.name == "apache-2.0-header")
LINE = "This work is licensed under the GNU General Public License, version 3."


def scan(docs, **options):
    return sorted(
        (r.doc_id, r.license, r.word_start, r) for r in licenses.scan_licenses(docs, **options).collect()
    )


def test_corpus_lines(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    lines = {
        "mit-line": "Released under the MIT License.",
        "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
        "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
        "gpl-3.0-line": LINE,
    }
    expected = {
        (r.doc_id, name) for r in docs.collect() for name, line in lines.items() if line in r.text
    }
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect() if r.coverage == 1}
    assert got == expected and expected


def test_spans_and_edits(make_docs):
    words = APACHE.text.split()
    edited = [w for i, w in enumerate(words) if i not in (9, 20)]
    edited.insert(15, "really")
    filler = "lorem ipsum dolor sit amet "
    rows = [
        (1, filler * 30 + " ".join(edited) + " " + filler * 30),
        (2, filler + APACHE.text + "\n" + filler + APACHE.text.upper()),
        (3, None),
        (4, ""),
        (5, "MIT License. Licensed under"),
        (6, " ".join(words[: len(words) // 2])),
        (7, "😀 é " + LINE),
        (7, "😀 é " + LINE),
        (None, "é\n" * 40000 + LINE),
    ]
    got = scan(make_docs(rows, extra="license coverage start regions").where("doc_id IS NOT NULL"))
    header = [r for *_, r in got if r.license == "apache-2.0-header"]
    assert [r.doc_id for r in header] == [1, 2, 2]
    assert header[0].matched == len(licenses.tokens(APACHE.text)) - 2
    for r in header[1:]:
        text = rows[1][1]
        assert r.coverage == 1.0
        assert licenses.tokens(text[r.start : r.end]) == licenses.tokens(APACHE.text)
    gpl = [r for *_, r in got if r.license == "gpl-3.0-line"]
    assert [(r.doc_id, r.start, r.end) for r in gpl] == [(7, 4, 3 + len(LINE))] * 2
    assert not [r for d, *_, r in got if d in (3, 4, 5)]
    null_id = licenses.scan_licenses(make_docs(rows).where("doc_id IS NULL")).collect()
    assert [(r.license, r.coverage) for r in null_id] == [("gpl-3.0-line", 1.0)]


def test_slices_agree(make_docs):
    docs = make_docs([(1, APACHE.text + " " + LINE)])
    whole = licenses.scan_licenses(docs).collect()
    assert sorted(map(tuple, whole)) == sorted(
        map(tuple, licenses.scan_licenses(docs, slice_words=20).collect())
    )
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, [licenses.Template("short", "one two")])


def brute_local(a, b):
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1)
            score[i][j] = max(0, step, score[i - 1][j] - 1, score[i][j - 1] - 1)
    return max(map(max, score))


@pytest.mark.parametrize("seed", range(20))
def test_full_band_is_a_local_alignment(seed):
    draw = random.Random(seed)
    a = draw.choices("abcd", k=draw.randrange(1, 15))
    b = draw.choices("abcd", k=draw.randrange(1, 15))
    match = licenses.banded_alignment(a, b, -len(a), len(b))
    assert (match.matched > 0) == (brute_local(a, b) > 0)
    if match.matched:
        own = b[match.first : match.last + 1]
        assert brute_local(a, own) == brute_local(a, b)


@pytest.mark.parametrize("seed", range(20))
def test_shared_runs_share_a_kept_hash(seed):
    draw = random.Random(seed)
    run = [str(draw.randrange(10**6)) for _ in range(licenses.GROUP + licenses.KEPT_OF - 1)]
    text = [str(draw.randrange(50)) for _ in range(30)] + run + ["end"] * draw.randrange(9)
    hashes = licenses.word_groups(text)
    kept = set(hashes[licenses.winnowed(hashes)].tolist())
    assert kept & set(licenses.word_groups(run).tolist())


def test_every_allowed_edit_is_found(make_docs):
    draw, rows, expected = random.Random(4), [], {}  # what an unfiltered alignment finds
    for t in licenses.TEMPLATES:
        own = licenses.tokens(t.text)
        n = len(own)
        allowed = n - next(m for m in range(n + 1) if m >= licenses.MIN_COVERAGE * n)
        places = [[k] for k in range(n)] if allowed == 1 else []
        # Evenly spread edits leave the shortest runs.
        places += [[n * (k + 1) // (allowed + 1) for k in range(allowed)]]
        places += [sorted(draw.sample(range(n), allowed)) for _ in range(4)]
        for at in places:
            for word in ("zzz", None):
                edited = [word if k in at else w for k, w in enumerate(own)]
                text = ["lorem ipsum dolor"] * 9 + [w for w in edited if w] + ["sit amet"] * 9
                words = " ".join(text).split()
                full = licenses.banded_alignment(own, words, -n, len(words)).matched
                expected[len(rows)] = full if full >= licenses.MIN_COVERAGE * n else 0
                rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.matched for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert sum(map(bool, expected.values())) > 0.7 * len(rows)
    assert [rows[i] for i, least in expected.items() if got.get(i, 0) < least] == []


def places_of(parts):
    """The text of (words, template or None) parts, and where templates begin."""
    text, expected = [], []
    for words, name in parts:
        if name:
            expected.append((name, len(text)))
        text += words
    return " ".join(text), expected


MIT = licenses.tokens(next(t for t in licenses.TEMPLATES if t.name == "mit-line").text)
LINES = {t.name: licenses.tokens(t.text) for t in licenses.TEMPLATES if t.name.endswith("-line")}


def test_copies_side_by_side_are_each_found(make_docs):
    apache = LINES["apache-2.0-line"]
    rows = [
        (MIT * 2, 2), (MIT + "one two three".split() + MIT, 2), (apache * 2, 2), (apache * 200, 200), (MIT * 300, 300),
    ]
    docs = make_docs([(n, " ".join(words)) for n, (words, _) in enumerate(rows)])
    got: dict = {}
    for r in licenses.scan_licenses(docs).collect():
        assert r.coverage == 1
        got.setdefault(r.doc_id, []).append(r.word_start)
    assert {n: len(starts) for n, starts in got.items()} == {n: c for n, (_, c) in enumerate(rows)}
    assert sorted(got[4]) == [len(MIT) * k for k in range(300)]


@pytest.mark.parametrize("seed", range(3))
def test_mixed_copies_match_brute_force(make_docs, seed):
    """One to five copies, exact or edited, nought to twenty words apart."""
    draw = random.Random(seed)
    names = ["mit-line", "apache-2.0-line", "gpl-3.0-line", "cc0-line"]
    rows, expected = [], {}
    for n in range(60):
        parts = [(["lorem"] * draw.randrange(9), None)]
        for _ in range(draw.randrange(1, 6)):
            name = draw.choice(names)
            words = list(LINES[name])
            if draw.random() < 0.5:
                # An inner word, so that the copy still begins and ends where it did.
                words[draw.randrange(1, len(words) - 1)] = "zzz"
            parts += [(words, name), ([f"w{draw.randrange(50)}" for _ in range(draw.randrange(21))], None)]
        text, places = places_of(parts)
        rows.append((n, text))
        expected[n] = sorted(places)
    got: dict = {n: [] for n in expected}
    for r in licenses.scan_licenses(make_docs(rows)).collect():
        got[r.doc_id].append((r.license, r.word_start))
    assert {n: sorted(found) for n, found in got.items()} == expected


def test_repeated_rows_and_slices(make_docs):
    text = " ".join(MIT * 3 + LINES["gpl-3.0-line"])
    docs = make_docs([(1, text)] * 3 + [(None, text)] * 2 + [(2, "nothing here")], extra="_copies text2 hits")
    for words in (500_000, 20):
        got = [(r.doc_id, r.license, r.word_start) for r in licenses.scan_licenses(docs, slice_words=words).collect()]
        assert len(got) == 20 and len(set(got)) == 8


def test_texts_without_hits_do_not_move(spark, make_docs):
    plan = licenses.scan_licenses(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    # What is joined and matched are the rows that were kept before.
    assert "MapInArrow" not in plan and "ExistingRDD" in plan
