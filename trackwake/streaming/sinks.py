"""Sinks and query control: console, memory, messages, tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trackwake.streaming.state import start

TRIGGER = "1 second"

# Producer settings of the message sinks.
PRODUCER_OPTIONS = {
    "kafka.batch.size": "163840",
    "kafka.acks": "1",
    "kafka.max.request.size": str(25 * 1024 * 1024),
    "kafka.retries": "0",
    "kafka.linger.ms": "1",
    "kafka.buffer.memory": "33554432",
}


def stream_writer(
    df: DataFrame,
    name: str,
    checkpoint: str,
    mode: str,
    interval: str | None,
    once: bool = False,
) -> DataStreamWriter:
    writer = (
        df.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        return writer.trigger(availableNow=True)
    return writer if interval is None else writer.trigger(processingTime=interval)


def console_sink(
    df: DataFrame,
    name: str,
    checkpoint: str,
    interval: str | None = TRIGGER,
    mode: str = "update",
    once: bool = False,
) -> DataStreamWriter:
    return stream_writer(df, name, checkpoint, mode, interval, once).format("console")


def memory_sink(
    df: DataFrame, name: str, mode: str = "update", interval: str | None = None
) -> DataStreamWriter:
    """Results in a driver table called ``name``, for looking at small states.

    This sink cannot be restarted in update mode, so it takes no checkpoint.
    """
    writer = df.writeStream.queryName(name).outputMode(mode).format("memory")
    return writer if interval is None else writer.trigger(processingTime=interval)


def message_sink_options(bootstrap: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, **PRODUCER_OPTIONS}


def message_sink(
    messages: DataFrame,
    name: str,
    checkpoint: str,
    bootstrap: str,
    interval: str | None = TRIGGER,
    mode: str = "update",
) -> DataStreamWriter:
    """Publish ``(topic, key, value)`` rows, at least once each."""
    return (
        stream_writer(messages, name, checkpoint, mode, interval)
        .format("kafka")
        .options(**message_sink_options(bootstrap))
    )


def table_sink(
    df: DataFrame,
    name: str,
    checkpoint: str,
    path: str,
    mode: str = "update",
    interval: str | None = TRIGGER,
    once: bool = False,
) -> DataStreamWriter:
    """Write each trigger's rows to ``path/batch_id=<n>``.

    A trigger that is run again after a failure replaces its own folder only.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream_writer(df, name, checkpoint, mode, interval, once).foreachBatch(write)


def latest_batches(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Of a ``table_sink`` output, each key's rows from its last trigger.

    The last trigger of a key is an aggregate joined back on key and trigger,
    so rows of one key are never gathered.
    """
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [key, "batch_id"], "left_semi").drop("batch_id")


def view_sink(
    snapshot: DataFrame,
    name: str,
    checkpoint: str,
    view: str,
    query: str,
    path: str | None = None,
    mode: str = "complete",
    interval: str | None = TRIGGER,
    once: bool = False,
    keep: int | None = None,
) -> DataStreamWriter:
    """Each trigger, register the snapshot as ``view`` and run SQL over it.

    The result is written to ``path/batch_id=<n>``, or its first rows are shown
    where no path is given. A whole snapshot a trigger adds up: with ``keep`` only
    the last so many stay, in folders that are used in turn; ``last_snapshot``
    reads the newest of them.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        rows.createOrReplaceTempView(view)
        result = rows.sparkSession.sql(query)
        if path is None:
            print(f"-- {view}, trigger {batch_id}")
            result.show()
        elif keep is None:
            result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        else:
            numbered = result.withColumn("batch_id", F.lit(batch_id))
            numbered.write.mode("overwrite").parquet(f"{path}/turn={batch_id % keep}")

    return stream_writer(snapshot, name, checkpoint, mode, interval, once).foreachBatch(run)


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest result of a ``view_sink`` that keeps a few."""
    rows = spark.read.parquet(path).drop("turn")
    newest = rows.agg(F.max("batch_id").alias("batch_id"))
    return rows.join(F.broadcast(newest), "batch_id").drop("batch_id")


def run_available(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a query built with ``once=True`` and wait for its end."""
    query = start(spark, writer)
    query.awaitTermination()
    return query


def await_any(spark: SparkSession) -> None:
    """Block until one of the session's queries stops."""
    spark.streams.awaitAnyTermination()
