"""Tables and text folders replayed as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def replay_table(
    spark: SparkSession, path: str, files_per_trigger: int = 1
) -> DataFrame:
    """A parquet table as a stream, a bounded number of files per trigger.

    Files are taken in order of modification time, each exactly once. ``path``
    may be a file, a folder or a glob; only footers are read here, for the
    schema.
    """
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    if not any(sign in path for sign in "*?[{"):
        # The stream reader takes a single file only by a pattern.
        path = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def stage_rows(table: DataFrame, path: str, rows_per_trigger: int) -> None:
    """Write a table to ``path`` in files of at most so many rows, for ``replay_rows``.

    The file stream takes whole files, so a bound on rows is one on what a file
    holds. The copy is a job over the table's partitions; nothing is gathered, and
    rows that are side by side stay so. ``path`` must not exist yet, since a
    stream over it takes every file once.
    """
    if rows_per_trigger < 1:
        raise ValueError("a trigger takes one row at least")
    writer = table.write.mode("errorifexists")
    writer.option("maxRecordsPerFile", rows_per_trigger).parquet(path)


def replay_rows(spark: SparkSession, path: str) -> DataFrame:
    """A staged table as a stream, one file and so a bounded number of rows per trigger.

    Every row comes once, also over restarts with the same checkpoint: the
    checkpoint says which files were taken.
    """
    return replay_table(spark, path, files_per_trigger=1)


def text_stream(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """New files of a folder as a stream of lines in ``value``."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)
