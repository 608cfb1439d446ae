"""Current rows of a running count or position query, read from its own state.

A query over an aggregate keeps one row per key in its state store and commits it
with every trigger, so there is no need for a second copy in a table: a trigger
costs what it touches, and whoever wants all keys, touched or not, reads the
state of the last finished trigger from the checkpoint, partition by partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from trackwake.operators.position import leaves, rebuilt
from trackwake.streaming.sinks import TRIGGER, stream_writer

_SLOT = "__slot"


def state_sink(
    df: DataFrame,
    name: str,
    checkpoint: str,
    interval: str | None = TRIGGER,
    once: bool = False,
) -> DataStreamWriter:
    """Keep the state of a query up to date and write nothing else."""
    return stream_writer(df, name, checkpoint, "update", interval, once).format("noop")


def _buffers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The key columns and the aggregates' buffers as ``__slot0``, ``__slot1``, ...

    The buffers of a state row come in the order of the aggregates: one of a
    count or a maximum, two of a ``max_by``, the value first. Their own names
    repeat, so they are told apart by place.
    """
    held = spark.read.format("statestore").load(checkpoint)
    kinds = [field.dataType for field in held.schema["value"].dataType]
    named = T.StructType([T.StructField(f"{_SLOT}{n}", kind) for n, kind in enumerate(kinds)])
    return held.select("key.*", F.col("value").cast(named).alias("__value")).select(
        *held.schema["key"].dataType.names, "__value.*"
    )


def stored_counts(
    spark: SparkSession, checkpoint: str, key: str = "flight_id", out: str = "n"
) -> DataFrame:
    """All counts that a ``running_count`` query holds as of its last trigger."""
    return _buffers(spark, checkpoint).select(key, F.col(f"{_SLOT}0").alias(out))


def _picked(held: DataFrame, schema: T.StructType, columns: Sequence[str], first: int) -> DataFrame:
    """The columns that ``max_by`` keeps leaf by leaf, from the slot ``first`` on."""
    kinds = {name: schema[name].dataType for name in columns}
    names = [leaf for name, kind in kinds.items() for leaf, _ in leaves(name, kind, F.lit(None))]
    kept = [c for c in held.columns if not c.startswith(_SLOT)]
    values = [F.col(f"{_SLOT}{first + 2 * n}").alias(leaf) for n, leaf in enumerate(names)]
    found = held.select(*kept, *values)
    return found.select(*kept, *[rebuilt(n, k).alias(n) for n, k in kinds.items()])


def stored_positions(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """All rows that a ``last_known_position`` query holds as of its last trigger.

    ``schema`` is that of the query's results: the key, then the columns kept.
    """
    key, *columns = schema.names
    return _picked(_buffers(spark, checkpoint), schema, columns, 0).select(key, *columns)


def stored_latest(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """All rows that a ``latest_report`` query holds as of its last trigger.

    ``schema`` is that of the query's results: the key, ``time`` and the columns.
    """
    key, time, *columns = schema.names
    held = _buffers(spark, checkpoint).withColumnRenamed(f"{_SLOT}0", time)
    return _picked(held, schema, columns, 1).select(key, time, *columns)
