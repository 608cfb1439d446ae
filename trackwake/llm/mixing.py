"""Mixing sources to target weights by weighted fair queueing.

Each source offers its documents, shuffled, up to three times over. A copy's
virtual finish time is the source's running word count divided by the source's
weight; the mix is the queue in the order of that time, cut where the words
served reach the budget. Serving every source at the speed of its weight and
stopping after three rounds makes each target the share of its weight, with
what a source cannot use going to the others.

All steps are joins, grouping and windows over (source, slot), where a slot is
a slice of the shuffle order: a source with a third of all rows is spread over
all slots, and only one row per slot or source meets in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackwake.llm.common import word_count

WEIGHTS = (5, 2, 1)
ROUNDS = 3
SLOTS = 1024
SEED = 20


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, rounds: int = ROUNDS
) -> DataFrame:
    """One row per source: source_size, weight, level and target, from (source, size).

    Sources take the weights in turn in code point order, null last. `level` is
    the virtual time at which the budget, the size of all sources, is served: the
    largest over k of (budget - what the k sources that run dry first can give) /
    (weight of the others).
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*(F.lit(float(w)) for w in weights))
    most = rounds * F.col("source_size")
    weighed = sources.withColumn(
        "weight", F.get(table, F.pmod(turn, F.lit(len(weights))))
    ).withColumn("_dry", most / F.col("weight"))
    drier = Window.orderBy("_dry", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    every = Window.partitionBy()
    spent = lambda c: F.coalesce(F.sum(c).over(drier), F.lit(0))
    level = (F.sum("source_size").over(every) - spent(most)) / (
        F.sum("weight").over(every) - spent(F.col("weight"))
    )
    return (
        weighed.withColumn("_level", level)
        .withColumn("level", F.max("_level").over(every))
        .select(
            "source",
            "source_size",
            "weight",
            "level",
            F.least(F.col("weight") * F.col("level"), most.cast("double")).alias("target"),
        )
    )


def virtual_copies(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    size: Column,
    source: str = "source",
    ties: Sequence[str] = (),
    carry: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    rounds: int = ROUNDS,
    slots: int = SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of `docs` with its place in the queue.

    Columns: key, ties, carry, source, size, source_size, target and `copies`, an
    array over the rounds of (start, finish: virtual times; taken: words served
    before the cut). The shuffle orders rows by a seeded digest of the key, then
    by size and `ties`; rows alike in all of them are interchangeable, so reruns
    agree. A copy in service at the cut is served in part. A null key is a key
    like any other.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    sized = docs.select(
        key,
        *ties,
        *carry,
        F.col(source).alias("source"),
        size.cast("long").alias("size"),
        digest.alias("_order"),
    )
    # Slots are ranges of the digest, so that they follow each other in its order.
    head = F.conv(F.substring("_order", 1, 6), 16, 10).cast("long")
    sized = sized.withColumn("_slot", F.floor(head * slots / (1 << 24)))
    totals = sized.groupBy("source", "_slot").agg(F.sum("size").alias("_words"))
    earlier = (
        Window.partitionBy("source")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slotted = totals.select(
        F.col("source").alias("_source"),
        F.col("_slot").alias("_at"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"),
    )
    targets = source_targets(
        totals.select("source", F.col("_words").alias("size")), weights, rounds
    ).withColumnRenamed("source", "_of")
    offsets = slotted.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    inside = (
        Window.partitionBy("source", "_slot")
        .orderBy("_order", "size", *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    queued = sized.withColumn(
        "_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))
    ).join(
        offsets,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slot") == F.col("_at")),
    )

    def copy(round: int) -> Column:
        start = round * F.col("source_size") + F.col("_before") + F.col("_inside")
        left = F.round("target").cast("long") - start
        return F.struct(
            (start / F.col("weight")).alias("start"),
            ((start + F.col("size")) / F.col("weight")).alias("finish"),
            F.greatest(F.lit(0), F.least("size", left)).alias("taken"),
        )

    return queued.select(
        key,
        *ties,
        *carry,
        "source",
        "size",
        "source_size",
        "target",
        F.array(*map(copy, range(rounds))).alias("copies"),
    )


def document_shares(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, for every row of `docs`.

    A null text has size 0; `taken` counts the words of all its copies.
    """
    rows = virtual_copies(docs, size=word_count(F.col("text")), **options)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["taken"])
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken")
    )


def cut_to_words(text: Column, size: Column, taken: Column) -> Column:
    """The text up to its word number `taken`, with all blanks before it."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.slice(pieces, F.lit(1), F.greatest(taken, F.lit(1)).cast("int"))
    return F.when(taken >= size, text).otherwise(F.array_join(head, ""))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix: rows of `docs` as often as they are taken, range-sorted by finish time.

    Needs columns doc_id, source and text; the others ride along, whatever their
    names. Rows without a word are never taken. The last copy that a source gets
    in may be cut, and then has the first words of its text only.
    """
    nested = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_src"),
        F.xxhash64("text").alias("_tie"),
    )
    rows = virtual_copies(
        nested,
        key="_id",
        size=word_count(F.col("_doc.text")),
        source="_src",
        ties=("_tie",),
        carry=("_doc",),
        **options,
    )
    queue = (
        rows.select("_doc", "_id", "_tie", "size", F.explode("copies").alias("_copy"))
        .where("_copy.taken > 0")
        .orderBy("_copy.finish", "_id", "_tie")
    )
    text = cut_to_words(F.col("_doc.text"), F.col("size"), F.col("_copy.taken"))
    return queue.select(
        *(
            text.alias(c) if c == "text" else F.col("_doc")[c].alias(c)
            for c in docs.columns
        )
    )
