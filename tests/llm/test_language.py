from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwake.llm import language
from trackwake.llm.common import read_table

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read_table(spark, FOLDER, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.97 * len(unseen)


WORDS = {
    "en": "the house is on the hill and they were with their friends that day",
    "de": "das haus ist auf dem berg und sie waren mit ihren freunden an dem tag",
    "fr": "la maison est sur la colline et ils étaient avec leurs amis ce jour",
    "xx": "ωκ ψα λο νε ρω τσι ζη θα ξε",
}


def labelled(n=40):
    rows = []
    for k, (lang, text) in enumerate(WORDS.items()):
        words = text.split()
        for i in range(n):
            rows.append((k * 1000 + i, " ".join(words[(i + j * 3) % len(words)] for j in range(12)), lang))
    return rows


EDGES = [
    (9001, None, "en"),
    (9002, "", "en"),
    (9003, "12 34 !? \n", "de"),
    (9004, "the " * 50000, None),
    (9005, "é", None),
    (None, "the friends were on the hill", None),
    (9005, "é", None),
]


def test_edges(make_docs):
    docs = make_docs(labelled() + EDGES, extra="lang_pred score held_out _p")
    got = language.identify(docs)
    rows = got.collect()
    assert len(rows) == len(labelled()) + len(EDGES)
    by_id = {r.doc_id: r for r in rows}
    for i in (9001, 9002, 9003):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[9004].lang_pred == by_id[None].lang_pred == "en"
    for doc_id, _, lang in labelled():
        assert by_id[doc_id].lang_pred == lang
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 3


def test_labels_of_held_out_rows_are_not_read(make_docs):
    rows = labelled()
    swapped = [
        (d, t, "en" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in rows
    ]
    take = lambda rows: sorted(
        (r.doc_id, r.lang_pred, r.score) for r in language.identify(make_docs(rows)).collect()
    )
    assert take(rows) == take(swapped)


def test_without_labels_or_rows(make_docs):
    got = language.identify(make_docs([(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language.identify(make_docs([(1, "x")]).limit(0)).collect() == []
    only = [(i, "some text", "en") for i in range(20)]
    assert {r.lang_pred for r in language.identify(make_docs(only)).collect()} == {"en"}


def test_families_come_first():
    texts = [(lang, t) for _, t, lang in labelled(10)]
    x = np.stack([language.trigram_features(t) for _, t in texts])
    model = language.fit(x, np.array([lang for lang, _ in texts], dtype=object))
    assert model.families == ["germanic", "romance", "xx"]
    assert len(model.between) == 3
    assert [len(m) for m in model.within.values()] == [1, 0, 0]


@pytest.mark.parametrize("text", ["", " ", "a", "é" * 10, "x" * 100000])
def test_features_have_length_one_or_none(text):
    norm = np.linalg.norm(language.trigram_features(text))
    assert norm == pytest.approx(1, abs=1e-3) or norm == 0


def test_a_corpus_without_labels_stays(make_docs):
    rows = [(i, f"некий текст {i}" if i % 2 else f"some text {i}", None) for i in range(20)]
    rows += [(20, "12 !", None), (21, None, None), (22, "", None), (23, "é", None)]
    kept = language.keep_identified(make_docs(rows, extra="_doc _p score"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 23]


def test_scores_decide_what_stays(make_docs, monkeypatch):
    rows = labelled(12)
    docs = make_docs(rows)
    scores = {r.doc_id: r.score for r in language.identify(docs).collect()}
    middle = sorted(scores.values())[len(scores) // 2]
    monkeypatch.setattr(language, "MIN_SCORE", middle)
    kept = {r.doc_id for r in language.keep_identified(docs).collect()}
    assert kept == {i for i, s in scores.items() if s >= middle} and len(kept) < len(scores)


def test_given_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert language.keep_identified(docs).count() == lettered.count()


def brute_machine(x, y, cost, steps=20_000):
    """Gradient descent on the same squared hinge, bias included in the penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    rate = 1 / (1 + 2 * cost * np.linalg.norm(x, 2) ** 2)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ w))
        w -= rate * (w - 2 * cost * x.T @ (y * slack))
    return w


def test_machines_match_gradient_descent():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(40, 5)).astype(np.float32)
    positive = x[:, 0] + 0.5 * draw.normal(size=40) > 0
    weights, bias = language.fit_machine(x, positive, cost=0.5, rounds=400)
    expected = brute_machine(x.astype(float), np.where(positive, 1, -1), 0.5)
    assert np.allclose([*weights, bias], expected, atol=1e-3)


def test_predictions_follow_from_the_weights():
    texts = [t for _, t, _ in labelled(6)]
    x = np.stack([language.trigram_features(t) for t in texts])
    model = language.fit(x, np.array([lang for *_, lang in labelled(6)], dtype=object))
    names, scores = language.predict(model, texts)
    for features, name, score in zip(x, names, scores):

        def winner(machines, among):
            sides = {n: [] for n in among}
            for m in machines:
                margin = float(features @ m.weights + m.bias)
                sides[m.first].append(margin)
                sides[m.second].append(-margin)
            best = max(among, key=lambda n: sum((s > 0) + 1e-3 * np.tanh(s) for s in sides[n]))
            return best, 1 / (1 + np.exp(-4 * min(sides[best]))) if machines else 1.0

        family, sure = winner(model.between, model.families)
        language_, surer = winner(model.within[family], model.languages[family])
        assert name == language_ and score == pytest.approx(sure * surer, rel=1e-4)
