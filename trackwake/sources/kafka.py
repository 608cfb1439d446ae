"""Message-bus sources. The Kafka connector package must be on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Where a record stood in its topic; together these order records by arrival.
ARRIVAL = ("message_time", "message_partition", "message_offset")

# The consumer group's name.
DEFAULT_GROUP = "defaultConsumerGroup"


def kafka_source_options(
    bootstrap: str,
    topic: str,
    starting_offsets: str = "latest",
    group: str | None = None,
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a topic's stream.

    ``max_per_trigger`` bounds the records of a trigger; set it where commands on
    tracks come along, since a track's records are then put in order in memory.
    """
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if group is not None:
        options["kafka.group.id"] = group
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def message_columns(messages: DataFrame, payload: str) -> DataFrame:
    """Payload and arrival columns of raw messages."""
    return messages.select(
        F.col("value").cast(payload).alias("value"),
        F.col("timestamp").alias(ARRIVAL[0]),
        F.col("partition").alias(ARRIVAL[1]),
        F.col("offset").alias(ARRIVAL[2]),
    )


def kafka_stream(
    spark: SparkSession, options: dict[str, str], payload: str = "string"
) -> DataFrame:
    """A topic as a stream of ``value`` (text or binary) with arrival columns."""
    messages = spark.readStream.format("kafka").options(**options).load()
    return message_columns(messages, payload)


def kafka_text_stream(spark: SparkSession, bootstrap: str, topic: str) -> DataFrame:
    return kafka_stream(spark, kafka_source_options(bootstrap, topic))


def kafka_binary_stream(spark: SparkSession, bootstrap: str, topic: str) -> DataFrame:
    return kafka_stream(spark, kafka_source_options(bootstrap, topic), "binary")


def kafka_group_stream(
    spark: SparkSession,
    bootstrap: str,
    topic: str,
    group: str = DEFAULT_GROUP,
    payload: str = "string",
) -> DataFrame:
    """A topic read under a named consumer group."""
    options = kafka_source_options(bootstrap, topic, group=group)
    return kafka_stream(spark, options, payload)
