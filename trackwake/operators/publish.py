"""State rows as keyed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackwake.functions.text import long_bytes, point_message

COUNTS_SUFFIX = "-counts"
STATE_SUFFIX = "-state"


def count_messages(
    counts: DataFrame,
    topic: str,
    key: str = "flight_id",
    count: str = "n",
    suffix: str = COUNTS_SUFFIX,
) -> DataFrame:
    """Messages ``(topic, key, value)`` with the count as a big-endian long."""
    return counts.select(
        F.lit(topic + suffix).alias("topic"),
        F.col(key).cast("string").alias("key"),
        long_bytes(F.col(count)).alias("value"),
    )


def state_messages(
    positions: DataFrame,
    topic: str,
    key: str = "flight_id",
    geometry: str = "geometry",
) -> DataFrame:
    """Messages ``(topic, key, value)`` with the position as text."""
    return positions.select(
        F.lit(topic + STATE_SUFFIX).alias("topic"),
        F.col(key).cast("string").alias("key"),
        point_message(F.col(geometry)).alias("value"),
    )
