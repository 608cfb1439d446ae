from __future__ import annotations

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from trackwake.llm import language, lines, mixing, simhash
from trackwake.llm.queries import tokenizer_file

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "'12 !' AS text", "lang", "source", "n_chars")
    copy = docs.limit(3).selectExpr("doc_id + 200000 AS doc_id", "text", "lang", "source", "n_chars")
    current = docs.union(junk).union(copy).selectExpr("*", "'extra' AS _doc")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == current.columns
            assert out.dtypes == current.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = current.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    total = docs.count()
    assert len(seen["language_id"]) == total + 3
    assert not any(100000 <= i < 200000 for i in ids["language_id"])
    assert len(seen["line_dedup"]) == total + 3
    assert not any(i >= 200000 for i in ids["simhash_near_dedup"])
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    before = words(seen["simhash_near_dedup"])
    assert abs(words(seen["source_mix"]) - before) <= 20
    encode = Tokenizer.from_file(tokenizer_file()).encode
    tokens = sum(len(encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["source_mix"])
    assert sum(r.length for r in seen["packing"]) == tokens


def test_stages_match_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    found = language.identify(docs).where("lang_pred != 'und'").select("doc_id")
    kept = stages["language_id"](spark, docs, FOLDER).select("doc_id")
    assert sorted(found.collect()) == sorted(kept.collect())
    thinned = stages["line_dedup"](spark, docs, FOLDER)
    assert sorted(thinned.select("doc_id", "text").collect()) == sorted(
        lines.dedup_lines(docs).select("doc_id", "text").collect()
    )
    for r in thinned.collect():
        assert r.n_chars == len(r.text)
    groups = simhash.simhash_groups(docs).select("component_id").distinct()
    one = stages["simhash_near_dedup"](spark, docs, FOLDER).select("doc_id")
    assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in groups.collect())
    shares = mixing.document_shares(docs).where("taken > 0").select("doc_id")
    mix = stages["source_mix"](spark, docs, FOLDER).select("doc_id").distinct()
    assert sorted(shares.collect()) == sorted(mix.collect())


def test_run_returns_pieces(spark):
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert pieces and all(len(p.ids) == 4 * p.length for p in pieces)
    assert max(np.frombuffer(p.ids, "<u4").max() for p in pieces[:50]) < 50257
