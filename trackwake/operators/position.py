"""Last known and latest positions, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackwake.functions.text import position_text, time_text
from trackwake.operators.ordering import (
    Arrival,
    arrival_columns,
    arrival_rank,
    arrival_value,
    is_whole,
    number_of,
    packed_arrival,
)


def leaves(name: str, kind: T.DataType, path: Column) -> list[tuple[str, Column]]:
    """A column's parts without structs, by name; a struct's own part tells if it is there."""
    if not isinstance(kind, T.StructType):
        return [(name, path)]
    found = [(f"{name}.", path.isNotNull())]
    for field in kind:
        found += leaves(f"{name}.{field.name}", field.dataType, path[field.name])
    return found


def rebuilt(name: str, kind: T.DataType) -> Column:
    """The column put together from its ``leaves``."""
    if not isinstance(kind, T.StructType):
        return F.col(f"`{name}`")
    fields = [rebuilt(f"{name}.{f.name}", f.dataType).alias(f.name) for f in kind]
    return F.when(F.col(f"`{name}.`"), F.struct(*fields))


def _picked(df: DataFrame, key: str | list[str], rank: Column, columns: Sequence[str], *more: Column) -> DataFrame:
    """``columns`` of the row with the largest rank, one ``max_by`` for each leaf.

    With a fixed-width rank and fixed-width leaves the buffers stay hash-aggregated.
    """
    kinds = {name: df.schema[name].dataType for name in columns}
    parts = [leaf for name, kind in kinds.items() for leaf in leaves(name, kind, F.col(name))]
    picked = [F.max_by(value, rank).alias(name) for name, value in parts]
    found = df.groupBy(key).agg(*more, *picked) if isinstance(key, str) else df.groupBy(*key).agg(*more, *picked)
    names = [c for c in found.columns if c not in {name for name, _ in parts}]
    return found.select(*names, *[rebuilt(n, k).alias(n) for n, k in kinds.items()])


def last_known_position(
    df: DataFrame,
    key: str = "flight_id",
    arrival: Arrival = "arrival_seq",
    columns: Sequence[str] = ("longitude", "latitude"),
) -> DataFrame:
    """The values of the report that arrived last, whatever its time says."""
    rank = packed_arrival(df, arrival)
    return _picked(df, key, arrival_value(arrival) if rank is None else rank, columns)


def latest_report(
    df: DataFrame,
    key: str,
    time: str,
    arrival: Arrival,
    columns: Sequence[str],
) -> DataFrame:
    """The report with the largest time, the first arrived among equal times.

    This equals the newest entry of any bounded track of at least one entry.
    The report is picked in one aggregate, partly before the shuffle, and works
    on streams in update or complete mode. On tables, time and an arrival of three
    columns, too long for one number together, take two: the first arrived of each
    key and time, then the latest of these, both by numbers and so without a sort.
    """
    names = arrival_columns(arrival)
    if len(names) == 1 and is_whole(df, names[0]) and is_whole(df, time):
        # Two arrivals differ by less than the step from one time to the next.
        step = F.lit("2" + "0" * 19).cast("decimal(20,0)")
        later = number_of(df, time).cast("decimal(18,0)") * step
        rank = later - number_of(df, names[0]).cast("decimal(19,0)")
    elif (
        not df.isStreaming
        and is_whole(df, time)
        and (packed := packed_arrival(df, arrival)) is not None
    ):
        kept = [name for name in columns if name not in {key, time}]
        first = _picked(df, [key, time], -packed, kept)
        # A key without any time has a report nonetheless.
        rank = F.coalesce(number_of(first, time).cast("bigint"), F.lit(-(1 << 63)))
        df = first
    else:
        # Earlier arrival must rank higher among equal times.
        rank = F.struct(time, *[arrival_rank(df, name) for name in names])
    return _picked(df, key, rank, columns, F.max(time).alias("time"))


def snapshot_rows(
    latest: DataFrame, key: str, time: str = "time", geometry: str = "geometry"
) -> DataFrame:
    """Snapshot rows ``(trackId, latestTime, latestPosition)``, all text."""
    return latest.select(
        F.col(key).cast("string").alias("trackId"),
        time_text(F.col(time)).alias("latestTime"),
        position_text(F.col(geometry)).alias("latestPosition"),
    )
