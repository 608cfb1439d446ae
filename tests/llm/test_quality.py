from __future__ import annotations

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st

from trackwake.llm import quality


def brute(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def check(make_docs, texts):
    docs = make_docs(list(enumerate(texts)), extra="n_words kept _words")
    rows = quality.apply_rules(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = brute(texts[row.doc_id])
        assert {k: row[k] for k in expected} == expected
        assert not (row.base_failed and row.kept)


PROSE = "the cat sat on the mat and it was for that in the house of his friend"


def test_counts_match_brute_force(make_docs):
    check(
        make_docs,
        [
            None,
            "",
            " \t\n",
            "one",
            "a b c d e a b c d e",
            "a a a a a a a",
            "x y z w v " * 3000,
            "line\nline\n\n\nline \n#$%\r\nline",
            "\u00a0 a\u2003b \x1c c \U0001f600 é <|> *",
            PROSE,
            PROSE + "\n" + PROSE,
        ],
    )


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab \n\t#é😀", max_size=80), min_size=1, max_size=25))
def test_random_texts(make_docs, texts):
    check(make_docs, texts)


def test_rules(make_docs, spark):
    docs = make_docs([(1, PROSE), (2, "# " * 40 + PROSE), (3, PROSE), (3, PROSE)])
    kept = {r.doc_id: r.kept for r in quality.apply_rules(docs).collect()}
    assert kept == {1: True, 2: False, 3: True}
    assert quality.apply_rules(docs).count() == 4
    strict = [quality.Rule("n_words", 1000, None)]
    assert not any(r.kept for r in quality.apply_rules(docs, strict).collect())
    assert quality.apply_rules(docs.limit(0)).collect() == []


def test_one_projection(make_docs):
    plan = quality.apply_rules(make_docs([(1, "x")]))._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "Aggregate" not in text and "Join" not in text and "Python" not in text


def test_prose_in_other_letters_owes_no_stop_words(make_docs):
    russian = "утром они пошли к реке где тихо стояла лодка и старый рыбак чинил сеть под деревом"
    latin = " ".join(f"qwor{n} zxty{n}" for n in range(40))
    texts = [" ".join(f"{w}{n}" for n in range(5) for w in russian.split()), latin, "漢字 " + latin, "1 2 3 " * 40]
    rows = {r.doc_id: r for r in quality.apply_rules(make_docs(list(enumerate(texts)))).collect()}
    assert len(texts[0].split()) > 72
    assert (rows[0].stop_word_debt, rows[0].kept) == (0, True)
    assert [rows[n].stop_word_debt for n in (1, 2, 3)] == [80, 81, 120]
    assert not rows[1].kept
