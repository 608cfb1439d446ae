"""Column functions on one track held as an array.

A track is ``ARRAY<STRUCT<time, ...>>`` in rising time order with no two equal
times; ``operators.tracks.track_table`` builds such columns. Entries are told
apart by time alone. Everything here stays a built-in expression, so the work
per row is bounded by the size the track was limited to.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trackwake.functions.binding import bind


def size(track: Column) -> Column:
    return F.size(track)


def is_empty(track: Column) -> Column:
    return F.size(track) == 0


def latest(track: Column) -> Column:
    """The newest entry, null for an empty track."""
    return F.try_element_at(track, F.lit(-1))


def oldest(track: Column) -> Column:
    """The oldest entry, null for an empty track."""
    return F.try_element_at(track, F.lit(1))


def contains(track: Column, time: Column) -> Column:
    return F.exists(track, lambda entry: entry["time"] == time)


def remove(track: Column, time: Column) -> Column:
    return F.filter(track, lambda entry: entry["time"] != time)


def clear(track: Column) -> Column:
    return F.slice(track, 1, 0)


def time_range(track: Column, start: Column, end: Column) -> Column:
    """Entries with ``start <= time < end``."""
    return F.filter(
        track, lambda entry: (entry["time"] >= start) & (entry["time"] < end)
    )


def ordered(track: Column, descending: bool = False) -> Column:
    """The track in chronological or reversed order."""
    return F.reverse(track) if descending else track


def previous(
    track: Column, time: Column, n: int = 1, descending: bool = False
) -> Column:
    """The ``n`` nearest entries before ``time``, or none if there are fewer."""
    if n <= 0:
        return clear(track)

    def nearest(before: Column) -> Column:
        found = F.when(F.size(before) >= n, F.slice(before, -n, n))
        return found.otherwise(clear(before))

    before = F.filter(track, lambda entry: entry["time"] < time)
    return ordered(bind(before, nearest), descending)


def next_entries(
    track: Column,
    time: Column,
    n: int = 1,
    descending: bool = False,
    strict_successor: bool = False,
) -> Column:
    """The ``n`` entries that follow ``time``, or none if there are fewer.

    By default the first entry at or after ``time`` is taken to be the probe
    itself and is passed over, also when the probe is not in the track. With
    ``strict_successor`` only entries later than ``time`` are looked at and
    none is passed over.
    """
    if n <= 0:
        return clear(track)
    skipped = 0 if strict_successor else 1

    def following(after: Column) -> Column:
        found = F.when(F.size(after) >= n + skipped, F.slice(after, 1 + skipped, n))
        return found.otherwise(clear(after))

    after = F.filter(
        track,
        lambda entry: entry["time"] > time
        if strict_successor
        else entry["time"] >= time,
    )
    return ordered(bind(after, following), descending)


def add(track: Column, entry: Column, max_features: int) -> Column:
    """Insert by time unless that time is held, then drop one oldest if too long."""
    grown = F.concat(
        F.filter(track, lambda held: held["time"] < entry["time"]),
        F.array(entry),
        F.filter(track, lambda held: held["time"] > entry["time"]),
    )
    purged = F.when(
        F.size(grown) > max_features, F.slice(grown, 2, max(max_features, 0) + 1)
    ).otherwise(grown)
    return F.when(contains(track, entry["time"]), track).otherwise(purged)
