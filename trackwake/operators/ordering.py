"""Arrival order: one column or several, compared left to right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# One column such as a sequence number, or several such as a message
# timestamp, partition and offset. Together they must be unique per track.
Arrival = str | Sequence[str]


def arrival_columns(arrival: Arrival) -> list[str]:
    return [arrival] if isinstance(arrival, str) else list(arrival)


def arrival_value(arrival: Arrival) -> Column:
    """A value that orders rows by arrival."""
    names = arrival_columns(arrival)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def number_of(df: DataFrame, name: str) -> Column:
    """A whole number in the order of a column; microseconds for timestamps."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        # Field by field, so that no time zone has a say.
        seconds = (F.date_part(F.lit("SECOND"), name) * 1_000_000).cast("bigint")
        minutes = (F.hour(name) * 60 + F.minute(name)).cast("bigint") * 60_000_000
        return F.unix_date(F.to_date(name)).cast("bigint") * 86_400_000_000 + minutes + seconds
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    return F.col(name)


def arrival_rank(df: DataFrame, name: str) -> Column:
    """A number that falls as the arrival column rises."""
    return -number_of(df, name)


def is_whole(df: DataFrame, name: str) -> bool:
    """Whether ``number_of`` gives a number of at most 64 bits."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return isinstance(df.schema[name].dataType, (*whole, T.TimestampType, T.TimestampNTZType))


def packed_arrival(df: DataFrame, arrival: Arrival) -> Column | None:
    """Arrival as one fixed-width number, None where it cannot be had.

    Three columns are taken for a message's time, partition and offset, with up
    to 10^5 partitions and offsets below 10^15; others stop the query.
    """
    names = arrival_columns(arrival)
    if not all(is_whole(df, name) for name in names):
        return None
    numbers = [number_of(df, name).cast("decimal(20,0)") for name in names]
    if len(names) == 1:
        return numbers[0]
    if len(names) != 3:
        return None
    first, partition, offset = numbers
    fits = partition.between(0, 10**5 - 1) & offset.between(0, 10**15 - 1)
    stop = F.raise_error(F.lit("arrival out of range")).cast("decimal(38,0)")
    tail = (partition * F.lit(10**15).cast("decimal(16,0)") + offset).cast("decimal(20,0)")
    scale = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    packed = first.cast("decimal(17,0)") * scale + tail
    return F.when(fits | partition.isNull() | offset.isNull(), packed.cast("decimal(38,0)")).otherwise(stop)
