"""Tracks over their whole history, one row per entry.

A history row is a key, a time and the report that arrived first at that time.
Nothing here gathers a key's history in an array, so tracks may be of any
length; ``operators.tracks`` is for tracks that are bounded on purpose.

Lookups around a probe's time sort histories and probes of a key together. A key
with more than its share of rows is cut into time ranges, and each range is
handed the entries next to it, so no task holds more than its share. A history
that is looked up again and again is saved in that layout once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trackwake.operators.ordering import Arrival, arrival_columns, arrival_value
from trackwake.operators.skew import (
    no_cuts,
    numbered_range,
    range_cuts,
    range_numbers,
    shuffle_width,
)
from trackwake.operators.tracks import timed

_RANGE = "__range"
_ENTRY = "__entry"
_NEAR = "__near"
_KIND = "__kind"


def track_history(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    columns: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``time``, the arrival and ``columns`` of the first report per time.

    One aggregate, partly before the shuffle; a report without a time stops the
    query.
    """
    order = arrival_columns(arrival)
    first = [F.min(order[0]).alias(order[0])] if len(order) == 1 else [
        F.min_by(name, arrival_value(arrival)).alias(name) for name in order
    ]
    values = [
        F.min_by(name, arrival_value(arrival)).alias(name)
        for name in columns
        if name not in {key, time, *order}
    ]
    return timed(df, time).groupBy(key, F.col(time).alias("time")).agg(*first, *values)


class SavedHistory(NamedTuple):
    """A history laid out for lookups: rows bucketed by key and range, and the cuts."""

    rows: DataFrame
    cuts: DataFrame | None
    buckets: int


def save_history(
    history: DataFrame, name: str, path: str, key: str = "flight_id", buckets: int | None = None
) -> None:
    """Write a history to ``path`` as the table ``name``, bucketed by key and range, sorted by time.

    Keys with more than their share of rows are cut into ranges here, once, so
    lookups need no pass over the history to find them; the cuts go to the table
    ``<name>_cuts``. The number of buckets is by default that of shuffle partitions.
    The layout is known to the catalog, so that must outlive the session if the
    history is to.
    """
    cuts = range_cuts(history.where(F.col(key).isNotNull()), key, "time")
    placed = numbered_range(history, cuts, key, "time", _RANGE)
    width = buckets or shuffle_width(history)
    (
        placed.repartition(width, key, _RANGE)
        .write.mode("overwrite")
        .bucketBy(width, key, _RANGE)
        .sortBy(key, _RANGE, "time")
        .option("path", f"{path}/rows")
        .saveAsTable(name)
    )
    listed = no_cuts(history, key, "time") if cuts is None else cuts
    listed.write.mode("overwrite").option("path", f"{path}/cuts").saveAsTable(f"{name}_cuts")


def saved_history(spark: SparkSession, name: str) -> SavedHistory:
    """A history that ``save_history`` wrote, for ``history_previous`` and ``history_next``."""
    rows, cuts = spark.table(name), spark.table(f"{name}_cuts")
    described = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()
    return SavedHistory(rows, None if cuts.isEmpty() else cuts, int(described.data_type))


def history_range(history: DataFrame, start: Column, end: Column) -> DataFrame:
    """Entries with ``start <= time < end``."""
    return history.where((F.col("time") >= start) & (F.col("time") < end))


def history_ends(history: DataFrame, key: str = "flight_id", columns: Sequence[str] = ()) -> DataFrame:
    """Latest and oldest time, the ``columns`` there, and the number of entries per key."""
    ends = [
        pick(name, "time").alias(f"{end}_{name}")
        for end, pick in (("latest", F.max_by), ("oldest", F.min_by))
        for name in columns
    ]
    return history.groupBy(key).agg(
        F.max("time").alias("latest_time"),
        F.min("time").alias("oldest_time"),
        *ends,
        F.count(F.lit(1)).alias("entries"),
    )


def history_contains(
    probes: DataFrame,
    history: DataFrame,
    time: str,
    key: str = "flight_id",
    out: str = "contained",
) -> DataFrame:
    """Probes with whether the history holds an entry of that very time.

    Joined on key and time, so a long track is spread by itself; many equal
    probes in one task are split when the query runs (adaptive skew join), since
    each meets one entry at most.
    """
    held = history.select(F.col(key).alias("__key"), F.col("time").alias("__time"))
    met = probes.join(held, (F.col(key) == F.col("__key")) & (F.col(time) == F.col("__time")), "left")
    return met.withColumn(out, F.col("__key").isNotNull()).select(*probes.columns, out)


def history_remove(
    history: DataFrame,
    removals: DataFrame,
    time: str,
    key: str = "flight_id",
    out: str = "removed",
) -> DataFrame:
    """History rows marked ``removed`` where their time is listed for their key."""
    listed = removals.select(
        F.col(key).alias("__key"), F.col(time).alias("__time")
    ).distinct()
    marked = history.join(
        listed,
        (F.col(key) == F.col("__key")) & (F.col("time") == F.col("__time")),
        "left",
    )
    return marked.withColumn(out, F.col("__key").isNotNull()).select(*history.columns, out)


def _nearest(
    probes: DataFrame,
    history: DataFrame | SavedHistory,
    time: str,
    n: int,
    key: str,
    columns: Sequence[str],
    *,
    after: bool,
    touching: bool,
) -> DataFrame:
    """Probes with ``__near``: up to ``n`` entries on one side, the nearest first.

    ``touching`` takes an entry at the probe's own time in.
    """
    named = probes.withColumn("__probe", F.struct(*probes.columns)).select(
        F.col(key).alias(key), F.col(time).alias("time"), "__probe"
    )
    saved = isinstance(history, SavedHistory)
    rows = history.rows if saved else history
    if saved:
        cuts = history.cuts
    else:
        both = history.select(key, "time").union(named.select(key, "time"))
        cuts = range_cuts(both.where(F.col(key).isNotNull()), key, "time")
    # What meets a saved history is dealt as that is, so the history stays where it is.
    deal = lambda df: df.repartition(history.buckets, key, _RANGE) if saved else df
    outward = F.col("time").desc() if after else F.col("time").asc()
    entry = F.struct("time", *columns).alias(_ENTRY)
    placed = (
        rows.select(key, _RANGE, "time", entry)
        if saved
        else numbered_range(rows.select(key, "time", entry), cuts, key, "time", _RANGE)
    )
    inside = Window.partitionBy(key, _RANGE).orderBy(outward).rowsBetween(-(n - 1), 0)
    near = placed.where(F.col(key).isNotNull()).select(
        key, _RANGE, "time", F.reverse(F.collect_list(_ENTRY).over(inside)).alias(_NEAR)
    )
    if cuts is not None:
        near = _carried(near, cuts, key, n, after=after, deal=deal)
    # Without a key or time there is nothing to find: out of every range, dealt evenly.
    lost = -1 - F.pmod(F.xxhash64("__probe"), F.lit(shuffle_width(probes))).cast("int")
    sought = numbered_range(named, cuts, key, "time", _RANGE).withColumn(
        _RANGE, F.when(F.col(key).isNull() | F.col("time").isNull(), lost).otherwise(F.col(_RANGE))
    )
    none, nobody = (F.lit(None).cast(f.dataType) for f in (near.schema[_NEAR], named.schema["__probe"]))
    entries = near.select(
        key, _RANGE, "time", F.lit(0 if touching else 1).alias(_KIND), _NEAR, nobody.alias("__probe")
    )
    asked = deal(sought).select(
        key, _RANGE, "time", F.lit(1 if touching else 0).alias(_KIND), none.alias(_NEAR), "__probe"
    )
    so_far = (
        Window.partitionBy(key, _RANGE)
        .orderBy(outward, _KIND)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # The dealt rows come first: Spark takes a union's partitioning from its first part.
    met = asked.union(entries).withColumn(_NEAR, F.last(_NEAR, ignorenulls=True).over(so_far))
    empty = F.array().cast(near.schema[_NEAR].dataType)
    return met.where(F.col("__probe").isNotNull()).select(
        "__probe.*", F.coalesce(_NEAR, empty).alias(_NEAR)
    )


def _carried(
    near: DataFrame,
    cuts: DataFrame,
    key: str,
    n: int,
    *,
    after: bool,
    deal: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Neighbours completed across range borders, and handed on to the ranges beyond.

    Of each range only its last row takes part, with its neighbours, and only
    ranges of cut keys do: a bounded number of small rows, whatever the data.
    """
    empty = F.slice(_NEAR, 1, 0)
    step = F.col(_RANGE).desc() if after else F.col(_RANGE).asc()
    outward = F.max_by(_NEAR, "time") if not after else F.min_by(_NEAR, "time")
    named = range_numbers(cuts, key, _RANGE)
    last = (
        near.join(F.broadcast(named), [key, _RANGE], "left_semi")
        .groupBy(key, _RANGE)
        .agg(outward.alias(_NEAR))
    )
    # The nearest range first; each is in order from near to far already.
    joined_up = Window.partitionBy(key).orderBy(step).rowsBetween(-(n - 1), 0)
    tails = last.select(
        key,
        _RANGE,
        F.lit(1).alias(_KIND),
        F.slice(F.flatten(F.reverse(F.collect_list(_NEAR).over(joined_up))), 1, n).alias(_NEAR),
    )
    starts = named.select(
        key, _RANGE, F.lit(0).alias(_KIND), F.lit(None).cast(near.schema[_NEAR].dataType).alias(_NEAR)
    )
    so_far = (
        Window.partitionBy(key)
        .orderBy(step, _KIND)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    handed = (
        tails.union(starts)
        .withColumn("__handed", F.last(_NEAR, ignorenulls=True).over(so_far))
        .where((F.col(_KIND) == 0) & F.col("__handed").isNotNull())
        .select(key, _RANGE, "__handed")
    )
    full = F.slice(F.concat(_NEAR, F.coalesce("__handed", empty)), 1, n)
    own = near.join(F.broadcast(handed), [key, _RANGE], "left").select(
        key, _RANGE, "time", full.alias(_NEAR)
    )
    opening = handed.select(
        key,
        _RANGE,
        F.get("__handed", F.lit(0))["time"].alias("time"),
        F.col("__handed").alias(_NEAR),
    )
    return deal(opening).union(own)


def _all_or_none(near: Column, n: int, skipped: int, flip: bool) -> Column:
    found = F.slice(near, 1 + skipped, n)
    whole = F.when(F.size(near) >= n + skipped, found)
    ordered = F.reverse(whole) if flip else whole
    return F.coalesce(ordered, F.slice(near, 1, 0))


def history_previous(
    probes: DataFrame,
    history: DataFrame | SavedHistory,
    time: str,
    n: int = 1,
    key: str = "flight_id",
    columns: Sequence[str] = (),
    descending: bool = False,
    out: str = "previous",
) -> DataFrame:
    """Probes with the ``n`` entries before them (all ``n`` or none)."""
    near = _nearest(
        probes, history, time, max(n, 1), key, columns, after=False, touching=False
    )
    found = _all_or_none(F.col(_NEAR), n, 0, flip=not descending)
    return near.withColumn(out, found).drop(_NEAR)


def history_next(
    probes: DataFrame,
    history: DataFrame | SavedHistory,
    time: str,
    n: int = 1,
    key: str = "flight_id",
    columns: Sequence[str] = (),
    descending: bool = False,
    strict_successor: bool = False,
    out: str = "next",
) -> DataFrame:
    """Probes with the ``n`` entries after them (all ``n`` or none).

    By default the first entry at or after the probe is taken to be the probe
    itself and passed over; ``strict_successor`` looks at later entries only.
    """
    skipped = 0 if strict_successor else 1
    near = _nearest(
        probes,
        history,
        time,
        max(n + skipped, 1),
        key,
        columns,
        after=True,
        touching=not strict_successor,
    )
    found = _all_or_none(F.col(_NEAR), n, skipped, flip=descending)
    return near.withColumn(out, found).drop(_NEAR)
