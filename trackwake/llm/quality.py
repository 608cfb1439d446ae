"""Quality rules: a threshold table compiled into one projection.

Lengths, symbol, stop-word and line ratios of whole texts in built-in
expressions; a document never leaves its input partition.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from trackwake.llm.common import BLANKS, has_word, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that it is was for on are as with be at by this from or an a he not "
    "le la les de des du un une et en est que qui dans pour par sur au aux il elle avec ou "
    "der die das und den dem ein eine ist nicht zu von mit auf für im sich auch als in "
    "el los las del y que en un una por con para es se lo su al como más no"
).split()


class Rule(NamedTuple):
    """A metric must lie between low and high; None leaves that side open."""

    metric: str
    low: float | None
    high: float | None


#: Generous on purpose. The stop words of a text may fall short of one in twenty words
#: by two, so that a short text without any is no failure. They are those of four
#: languages in Latin letters, so a text mostly in other letters owes none.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_length", 2.0, 24.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_debt", None, 40),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.2),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _repeat_words() -> Column:
    """Words covered by a window of five words found twice or more, from `_s`."""
    same = lambda x, at: F.get("_s", at)["h"] == x["h"]
    repeated = F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda held, i: F.struct(
            (held["n"] + F.least(F.lit(WINDOW), i - held["last"])).alias("n"),
            i.alias("last"),
        ),
        lambda held: held["n"],
    )


def compile_rules(rules: Iterable[Rule]) -> Column:
    """One condition out of the table; a metric that is null fails it."""
    sides = []
    for rule in rules:
        metric = F.col(rule.metric)
        if rule.low is not None:
            sides.append(metric >= F.lit(rule.low))
        if rule.high is not None:
            sides.append(metric <= F.lit(rule.high))
    return F.coalesce(reduce(and_, sides, F.lit(True)), F.lit(False))


def quality_metrics(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of counts and ratios for every row of `docs`, repeated rows included.

    A null text counts as an empty one, which has no words and zero ratios. Other
    columns of `docs` are ignored, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("doc_id"),
        whole.alias("_text"),
        words(F.col(text)).alias("_words"),
        F.filter(F.split(whole, "\n", -1), has_word).alias("_lines"),
    )
    at = lambda i, k: F.get("_words", i + k)
    rows = rows.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - WINDOW),
                lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    # Only the few texts that repeat a window pay for sorting it.
    rows = rows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(
                F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            ),
        ),
    )
    stops = F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))
    rows = rows.select(
        "doc_id",
        "_text",
        "n_words",
        F.length(F.translate("_text", BLANKS, ""))
        .cast("long")
        .alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))
        .cast("long")
        .alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines")))
        .cast("long")
        .alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_s").isNotNull(), _repeat_words()), F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
    )
    owed = F.col("n_words") - 20 * F.col("n_stop_words")
    # Worked out for the few texts that lack stop words only.
    letters, latin = (F.length(F.regexp_replace("_text", p, "")) for p in (r"\P{L}+", r"\P{IsLatin}+"))
    return rows.select(
        *[c for c in rows.columns if c != "_text"],
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        F.when((owed > 0) & (2 * latin < letters), F.lit(0).cast("long"))
        .otherwise(owed)
        .alias("stop_word_debt"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
    )


def apply_rules(
    docs: DataFrame, rules: Iterable[Rule] = RULES, *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Metrics, `base_failed` and `kept` for every row of `docs`.

    `base_failed` is fixed: under ten words, or over a fifth of the words inside
    repeated five-word windows. `kept` also asks for every rule of the table.
    """
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 10) | (100 * repeated > 20 * n)
    return quality_metrics(docs, id=id, text=text).select(
        "*",
        failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"),
    )
