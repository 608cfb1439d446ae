"""A corpus from raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackwake.llm import language, lines, mixing, packing, simhash
from trackwake.llm.common import read_table, shared_folder
from trackwake.llm.queries import tokenizer_file


def identified(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; no text or no letter goes."""
    return language.keep_identified(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows."""
    thinned = lines.dedup_lines(docs.select(*docs.columns))
    changed = {
        "n_chars": F.when(F.col("n_removed") > 0, F.length("text"))
        .otherwise(F.col("n_chars"))
        .cast(dict(docs.dtypes).get("n_chars", "long"))
    }
    return thinned.select(
        *(changed[c].alias(c) if c in changed else c for c in docs.columns)
    )


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in the order of the mix."""
    return mixing.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, tokenizer=tokenizer_file())


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("packing", packed),
]

#: Token ids and XXH64 have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    home = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
