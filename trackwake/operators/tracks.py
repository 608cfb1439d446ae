"""Bounded, time-ordered tracks over whole tables.

The track of a key is the outcome of adding its reports one by one in arrival
order, refusing a report whose time is already held, and dropping the oldest
entry whenever more than ``max_features`` are held. That outcome is the
``max_features`` largest distinct times, each with its first-arrived report: a
time that was dropped can never come back, since all that outrank it only ever
give way to still larger times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackwake.functions import track_array
from trackwake.operators.ordering import Arrival, arrival_columns
from trackwake.operators.skew import join_per_key, shuffle_width

_GROUP = "__group"
_RANK = "__rank"


def _newest(
    df: DataFrame, keys: list[str], time: str, arrival: list[str], limit: int
) -> DataFrame:
    """First-arrived reports of the ``limit`` largest distinct times per group."""
    newest = df.withColumn(
        _RANK, F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    ).where(F.col(_RANK) <= limit)
    first = newest.withColumn(
        _RANK,
        F.row_number().over(Window.partitionBy(*keys, time).orderBy(*arrival)),
    ).where(F.col(_RANK) == 1)
    return first.drop(_RANK)


def timed(df: DataFrame, time: str) -> DataFrame:
    stop = F.raise_error(F.lit("a track report has no time")).cast("boolean")
    return df.where(F.when(F.col(time).isNotNull(), F.lit(True)).otherwise(stop))


def track_state(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """The track entries of every key, one row per entry.

    Two rounds of the same reduction. The first works on a key's reports in
    separate groups, one for each input partition modulo the shuffle width, so
    that each task hands on few reports before the shuffle and no task ever
    holds all reports of a hot track. The second merges what is left. A report
    without a time stops the query.

    ``where`` picks keys before the first round, where it reaches the source; a
    filter on the outcome would have to wait for that round.
    """
    df = df if where is None else df.where(where)
    order = arrival_columns(arrival)
    narrow = timed(df, time).select(
        key, time, *order, *[c for c in columns if c not in {key, time, *order}]
    )
    if max_features <= 0:
        return narrow.where(F.lit(False))
    grouped = narrow.withColumn(
        _GROUP, F.pmod(F.spark_partition_id(), F.lit(shuffle_width(df)))
    )
    partial = _newest(grouped, [key, _GROUP], time, order, max_features)
    return _newest(partial.drop(_GROUP), [key], time, order, max_features)


def track_table(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
) -> DataFrame:
    """One row per key with its ``track``, an array for ``track_array`` functions.

    Entries are ``STRUCT<time, arrival..., columns...>``; the array is bounded
    by ``max_features`` and built where the entries already are, without a
    further shuffle.
    """
    order = arrival_columns(arrival)
    entries = track_state(df, key, time, arrival, max_features, columns)
    entry = F.struct(
        F.col(time).alias("time"), *order, *[c for c in columns if c not in order]
    )
    return entries.groupBy(key).agg(
        F.sort_array(F.collect_list(entry)).alias("track")
    )


def probe_tracks(
    probes: DataFrame, tracks: DataFrame, key: str = "flight_id"
) -> DataFrame:
    """Every probe row with the ``track`` of its key, empty where there is none."""
    kind = tracks.schema["track"].dataType
    joined = join_per_key(probes, tracks, key, "left")
    return joined.withColumn(
        "track", F.coalesce("track", F.array().cast(kind))
    )


def track_previous(
    probes: DataFrame,
    tracks: DataFrame,
    time: str,
    n: int = 1,
    key: str = "flight_id",
    descending: bool = False,
    out: str = "previous",
) -> DataFrame:
    """Probes with the ``n`` entries before them (all ``n`` or none)."""
    found = track_array.previous(F.col("track"), F.col(time), n, descending)
    return probe_tracks(probes, tracks, key).withColumn(out, found).drop("track")


def track_next(
    probes: DataFrame,
    tracks: DataFrame,
    time: str,
    n: int = 1,
    key: str = "flight_id",
    descending: bool = False,
    strict_successor: bool = False,
    out: str = "next",
) -> DataFrame:
    """Probes with the ``n`` entries after them (all ``n`` or none)."""
    found = track_array.next_entries(
        F.col("track"), F.col(time), n, descending, strict_successor
    )
    return probe_tracks(probes, tracks, key).withColumn(out, found).drop("track")


def track_contains(
    probes: DataFrame,
    tracks: DataFrame,
    time: str,
    key: str = "flight_id",
    out: str = "contained",
) -> DataFrame:
    """Probes with whether their track holds an entry of that very time."""
    found = track_array.contains(F.col("track"), F.col(time))
    return probe_tracks(probes, tracks, key).withColumn(out, found).drop("track")


def track_remove(
    tracks: DataFrame,
    removals: DataFrame,
    time: str,
    key: str = "flight_id",
) -> DataFrame:
    """The tracks without the entries whose time is listed for their key.

    Removals may repeat; they are made distinct before they meet the tracks,
    entry by entry, so a long list for one key is never gathered in one place.
    A track that loses all its entries stays, empty.
    """
    entries = tracks.select(key, F.explode_outer("track").alias("entry"))
    listed = removals.select(
        F.col(key).alias("__key"), F.col(time).alias("__time")
    ).distinct()
    marked = entries.join(
        listed,
        (F.col(key) == F.col("__key")) & (F.col("entry.time") == F.col("__time")),
        "left",
    )
    kept = F.when(F.col("__key").isNull(), F.col("entry"))
    return marked.groupBy(key).agg(F.sort_array(F.collect_list(kept)).alias("track"))


def track_range(tracks: DataFrame, start: Column, end: Column) -> DataFrame:
    """Tracks cut down to ``start <= time < end``."""
    return tracks.withColumn(
        "track", track_array.time_range(F.col("track"), start, end)
    )


def track_entries(tracks: DataFrame, key: str = "flight_id") -> DataFrame:
    """One row per entry, the inverse of gathering rows into tracks."""
    return tracks.select(key, F.inline("track"))
