"""Line dedup over windows of three consecutive lines.

Every window of three lines is hashed; windows found more than once in the
corpus are removed wherever they are not the first, by merging the lines that
such windows cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackwake.llm.common import BLANKS, spread_join

WINDOW = 3
_STRIDE = 1 << 32


def _windows(lines: Column) -> Column:
    """Array of (line, h1, h2): the windows that hold a word, with 128 hash bits."""
    at = lambda i: [F.get(lines, i + k) for k in range(WINDOW)]
    starts = F.filter(
        F.sequence(F.lit(0), F.size(lines) - WINDOW),
        lambda i: F.btrim(F.concat(*at(i)), F.lit(BLANKS)) != "",
    )
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("line"),
            F.xxhash64(*at(i)).alias("h1"),
            F.xxhash64(F.lit("second"), *at(i)).alias("h2"),
        ),
    )


def repeated_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, _starts): where windows start that are not the first of their kind.

    The first occurrence is the one with the smallest doc_id, null last, then the
    smallest line. `_key` tells rows apart that share a doc_id; rows that do are
    at one place, so neither is later than the other.
    """
    place = F.coalesce(F.col(id).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    split = docs.select(
        F.col(id).alias("_id"),
        F.xxhash64(F.col(id), F.col(text)).alias("_key"),
        place.alias("_place"),
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("_lines"),
    ).where(F.size("_lines") >= WINDOW)
    windows = split.select(
        "_id",
        "_key",
        "_place",
        F.inline(_windows(F.col("_lines"))),
    ).withColumn(
        "_order", F.col("_place") * F.lit(_STRIDE).cast("decimal(10,0)") + F.col("line")
    )
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.count("*").alias("_n"), F.min("_order").alias("_first"))
        .where("_n > 1")
        .drop("_n")
        .withColumnRenamed("h2", "_h2")
    )
    met = spread_join(
        windows.select("_id", "_key", "line", "_order", "h1", "h2"), repeated, "h1", F.col("_order")
    )
    return (
        met.where("h2 = _h2 and _order > _first")
        .groupBy("_id", "_key")
        .agg(F.collect_set("line").alias("_starts"))
    )


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with later occurrences of repeated windows taken out of the text.

    Adds n_lines and n_removed; other columns ride along. Lines are what `\\n`
    separates, compared exactly. Texts of fewer than three lines have no window
    and stay as they are, as do windows of nothing but blanks. A text may become
    empty. A null text stays null, with no lines. Rows alike in doc_id and text
    are treated alike, so none is a later occurrence of the other; every line
    that goes has an equal earlier line that stays.
    """
    found = repeated_lines(docs, id=id, text=text)
    nested = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    own, content = F.col("_doc")[id], F.col("_doc")[text]
    joined = nested.withColumn("_own", F.xxhash64(own, content)).join(
        found, own.eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left"
    )
    lines = F.split(content, "\n", -1)
    covered = F.flatten(
        F.transform("_starts", lambda s: F.array(*(s + k for k in range(WINDOW))))
    )
    rows = joined.select(
        "_doc",
        lines.alias("_lines"),
        F.array_distinct(F.coalesce(covered, F.array().cast("array<int>"))).alias("_gone"),
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    thinned = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    kept = F.when(F.size("_gone") == 0, content).otherwise(thinned)
    return rows.select(
        *(kept.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
    )
