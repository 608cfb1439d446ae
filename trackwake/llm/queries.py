"""The registered query of each operator, with production parameters.

A query applies its operator to the whole of its table and derives the columns
to return; SQL twins are in `oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackwake.llm import (
    language,
    licenses,
    lines,
    mixing,
    oddsketch,
    packing,
    phrases,
    quality,
    runs,
    secrets,
    simhash,
    topk,
    urls,
)
from trackwake.llm.common import read_table, words


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.apply_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return mixing.document_shares(docs).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read_table(spark, folder, "documents"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    return urls.filter_urls(pages, urls.rule_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op6_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer=tokenizer_file()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


def op9_ball_tree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.inner_product_topk(
        read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0
    )


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, folder, "documents"))
    of = lambda kind: F.size(
        F.filter("base_spans", lambda s: s["kind"] == kind)
    ).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def op11_minhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return oddsketch.near_duplicates(read_table(spark, folder, "documents"), width=4)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by crc32 of its id ends in repetitions.

    There each word from number a on becomes the word a + (i - a) % p. Ids that are
    null leave their text alone.
    """
    found = words(F.col("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size("_words")
    marked = docs.select("doc_id", "text", h.alias("_h")).select(
        "doc_id",
        "text",
        F.when(F.col("_h") % 10 == 0, found).alias("_words"),
        F.floor(F.col("_h") / 10).alias("_g"),
    )
    start = (F.col("_g") % n).cast("int")
    period = (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    placed = marked.withColumn("_a", F.when(n > 0, start)).withColumn("_p", period)
    a, p = F.col("_a"), F.col("_p")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    tail = F.transform("_words", lambda w, i: F.get("_words", place(i)))
    return placed.select(
        "doc_id", F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text")
    )


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = repeated_tails(read_table(spark, folder, "documents"))
    found = runs.find_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # The greatest length first, then the smallest start and period.
    order = F.transform(
        "runs",
        lambda r: F.struct(
            (-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")
        ),
    )
    best = found.withColumn("_best", F.array_min(order))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(read_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        query.__name__: query
        for query in (
            op1_quality_rules,
            op2_license_scan,
            op3_source_mix,
            op4_language_id,
            op5_url_filters,
            op6_simhash_groups,
            op7_packing,
            op8_line_dedup,
            op9_ball_tree_topk,
            op10_secret_scan,
            op11_minhash_groups,
            op12_periodic_runs,
            op13_phrase_collocations,
        )
    }
