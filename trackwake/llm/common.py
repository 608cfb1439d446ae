"""What several corpus operators share."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of characters outside these six.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, GAP)
    )


def word_count(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, GAP))).cast("long")


def has_word(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) != ""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = _local_folder()
    return folder.rstrip("/")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="trackwake-llm-")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from there."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def spread_join(
    rows: DataFrame, lookup: DataFrame, key: str, deal: Column, *, how: str = "inner", salts: int = 8
) -> DataFrame:
    """Join rows, of which a key may have a third, with at most one row per key.

    Each key meets in `salts` places; `deal` says in which, by what a row holds.
    """
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
