"""Bounded tracks on streams.

``stream_track_state`` is the streaming twin of ``operators.tracks.track_state``
and ends in the same entries for the same records, however they are cut into
batches and in whatever order those come.

Records are thinned out column by column before the shuffle, to what a track can
still take, so the state's processor meets a few rows per key and merges them
with the few that it holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackwake.operators.ordering import Arrival, arrival_columns

STATE_NAME = "track"
IDLE_EXPIRY_MS = 30 * 60 * 1000
#: The column that tells a removal from an entry.
GONE = "gone"
#: Rows that a task holds while it thins out, and that a merge takes in at once.
HELD_ROWS = 200_000
MERGED_ROWS = 10_000

_ACTION = "__action"
REMOVE, CLEAR = "remove", "clear"


def reduce_batches(
    df: DataFrame, key: str, time: str, arrival: Arrival, max_features: int
) -> DataFrame:
    """Thin a stream out before its shuffle, without changing any track.

    A task keeps only the first-arrived records of a key's newest ``max_features``
    times; the others could not be in the track once they are applied. It hands
    on what it holds when that outgrows ``HELD_ROWS``, as a partial aggregate
    does, so a hot track's share of the shuffle stays small and memory bounded.
    """
    order = arrival_columns(arrival)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows or max_features <= 0:
                continue
            held.append(_newest(pa.Table.from_batches([batch]), key, time, order, max_features))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_newest(pa.concat_tables(held), key, time, order, max_features)]
                rows = held[0].num_rows
                if 2 * rows > HELD_ROWS:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from _newest(pa.concat_tables(held), key, time, order, max_features).to_batches()

    return df.mapInArrow(thin, df.schema)


def _newest(rows: pa.Table, key: str, time: str, order: list[str], limit: int) -> pa.Table:
    # A missing time sorts first, so that it is kept and stops the query later.
    at = pc.sort_indices(
        rows,
        sort_keys=[(key, "ascending"), (time, "descending")]
        + [(name, "ascending") for name in order],
        null_placement="at_start",
    )
    key_starts = _starts(rows[key].take(at))
    time_starts = key_starts | _starts(rows[time].take(at))
    ordinal = np.cumsum(time_starts)
    base = np.maximum.accumulate(np.where(key_starts, ordinal, 0))
    return rows.take(at.filter(pa.array(time_starts & (ordinal - base < limit)))).combine_chunks()


def _starts(values: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted column takes on its next value."""
    codes = values.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.concatenate(([True], codes[1:] != codes[:-1]))


def plain(value, kind: T.DataType):
    """Nested records as tuples, the form the state takes and gives back."""
    if value is None or not isinstance(kind, T.StructType):
        return value
    parts = value.values() if isinstance(value, dict) else value
    return tuple(plain(part, f.dataType) for part, f in zip(parts, kind.fields))


def named(value, kind: T.DataType):
    """Nested tuples as rows with field names, the form results need."""
    if value is None:
        return value
    if isinstance(kind, T.ArrayType):
        return [named(part, kind.elementType) for part in value]
    if not isinstance(kind, T.StructType):
        return value
    parts = [named(part, field.dataType) for part, field in zip(value, kind.fields)]
    return Row(*kind.names)(*parts)


class TrackProcessor(StatefulProcessor):
    """Holds one key's entries as list states of at most ``max_features`` rows.

    There is one state per branch. Branches keep the same times and differ in the
    columns that they hold beside time and arrival: ``branches`` gives their
    entries, by the name of their state. Input rows have the time and arrival,
    then each branch's columns in a struct of that name.

    Once per trigger, the entries of each touched track are emitted. With an idle
    expiry, a track without records for that long is forgotten, and a row with
    ``gone`` set tells so.
    """

    def __init__(
        self,
        branches: Mapping[str, T.StructType],
        output: T.StructType,
        order: int,
        max_features: int,
        idle_ms: int | None = None,
    ) -> None:
        self.branches = dict(branches)
        self.output = output
        self.order = order  # number of arrival columns
        self.max_features = max_features
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = {name: handle.getListState(name, kind) for name, kind in self.branches.items()}
        if self.idle_ms is not None:
            self.seen = handle.getValueState("seen", "at long")

    def close(self) -> None:
        pass

    # A track is a list of (time, arrival, values of each branch), the oldest first.

    def load(self) -> list[tuple]:
        tail = 1 + self.order
        held = [
            [plain(entry, kind) for entry in self.states[name].get()]
            for name, kind in self.branches.items()
        ]
        return [
            (same[0][0], same[0][1:tail], tuple(entry[tail:] for entry in same))
            for same in zip(*held)
        ]

    def store(self, track: list[tuple]) -> None:
        for at, state in enumerate(self.states.values()):
            if track:
                state.put([(time, *arrival, *values[at]) for time, arrival, values in track])
            else:
                state.clear()

    def entry(self, row: Row) -> tuple:
        time, *arrival = row[1 : 2 + self.order]
        if time is None:
            raise ValueError("a track report has no time")
        values = zip(row[2 + self.order :], self.branches.values())
        return (
            time,
            tuple(arrival),
            tuple(
                plain(value, T.StructType(kind.fields[1 + self.order :])) for value, kind in values
            ),
        )

    def merged(self, entries: Iterable[tuple]) -> list[tuple]:
        """The newest distinct times, of equal ones the first arrived, in order."""
        ranked = sorted(entries, key=itemgetter(1))
        ranked.sort(key=itemgetter(0), reverse=True)
        firsts = (next(same) for _, same in groupby(ranked, key=itemgetter(0)))
        return list(islice(firsts, max(self.max_features, 0)))[::-1]

    def taken(self, track: list[tuple], rows: Iterator[Row]) -> list[tuple]:
        while some := [self.entry(row) for row in islice(rows, MERGED_ROWS)]:
            track = self.merged(track + some)
        return track

    def touch(self, timers) -> None:
        """Note the time; one timer a track is enough, put off when it goes off early."""
        if self.idle_ms is None:
            return
        now = timers.getCurrentProcessingTimeInMs()
        if not self.seen.exists():
            self.handle.registerTimer(now + self.idle_ms)
        self.seen.update((now,))

    def emit(self, *values) -> Row:
        return named(values, self.output)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        track = self.taken(self.load(), rows)
        self.store(track)
        yield from self.results(key, track)

    def results(self, key, track: list[tuple]) -> Iterator[Row]:
        told = () if self.idle_ms is None else (False,)
        for at, name in enumerate(self.branches):
            label = (name,) if len(self.branches) > 1 else ()
            for time, arrival, values in track:
                yield self.emit(*label, *key, time, *arrival, *values[at], *told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.seen.get()[0] + self.idle_ms
        if due > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(due)
            return
        self.seen.clear()
        self.store([])
        blank = len(self.output) - len(key) - 1 - (len(self.branches) > 1)
        for name in self.branches:
            label = (name,) if len(self.branches) > 1 else ()
            yield self.emit(*label, *key, *[None] * blank, True)


class CommandedTracks(TrackProcessor):
    """Tracks that commands take entries from, among the records in arrival order.

    A key's records and commands of one trigger are put in order in memory, as a
    later row may be a command on an earlier one; the source's limit per trigger
    bounds them.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.touch(timerValues)
        track = self.load()
        arrived = sorted(rows, key=lambda row: tuple(row[2 : 2 + self.order]))
        for action, some in groupby(arrived, key=lambda row: row[-1]):
            if action is None:
                track = self.taken(track, iter([Row(*row[:-1]) for row in some]))
            elif action == CLEAR:
                track = []
            elif action == REMOVE:
                times = {row[1] for row in some}
                track = [entry for entry in track if entry[0] not in times]
            else:
                raise ValueError(f"unknown track command {action!r}")
        self.store(track)
        yield from self.results(key, track)


# -- the stream's columns -----------------------------------------------------------


def narrowed(
    df: DataFrame, key: str, time: str, order: list[str], branches: Mapping[str, Sequence[str]]
) -> tuple[DataFrame, dict[str, T.StructType], set[str]]:
    """What tracks need, the entries of each branch, and the timestamps among them.

    Timestamps go through Python and the state as microseconds, which no time
    zone of a worker can touch.
    """
    kinds = df.schema
    own = {
        name: [c for c in columns if c not in {key, time, *order}] for name, columns in branches.items()
    }
    stamps = {
        n
        for n in [time, *order, *[c for columns in own.values() for c in columns]]
        if isinstance(kinds[n].dataType, T.TimestampType)
    }
    value = lambda n: (F.unix_micros(n) if n in stamps else F.col(n)).alias(n)
    some = F.lit(None).cast("int").alias("__none")  # a struct needs a field
    structs = [
        F.struct(*([value(c) for c in columns] or [some])).alias(name) for name, columns in own.items()
    ]
    kept = df.select(key, *[value(n) for n in (time, *order)], *structs)
    head = [T.StructField(n, kept.schema[n].dataType) for n in (time, *order)]
    entries = {
        name: T.StructType(
            head + [T.StructField(f.name, f.dataType) for f in kept.schema[name].dataType if f.name in columns]
        )
        for name, columns in own.items()
    }
    return kept, entries, stamps


def restored(df: DataFrame, stamps: set[str]) -> DataFrame:
    return df.select(
        *[
            F.timestamp_micros(n).alias(n) if n in stamps else F.col(n)
            for n in df.columns
        ]
    )


def _output(
    kept: DataFrame, key: str, entry: T.StructType, idle_ms: int | None, label: str | None = None
) -> T.StructType:
    first = [T.StructField(label, T.StringType())] if label else []
    last = [T.StructField(GONE, T.BooleanType())] if idle_ms is not None else []
    return T.StructType([*first, kept.schema[key], *entry.fields, *last])


def _time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def stream_track_state(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    idle_expiry_ms: int | None = None,
) -> DataFrame:
    """Per trigger, all entries of each track that got records in it.

    State is kept for good unless ``idle_expiry_ms`` is given. Then a track that
    gets no records for that long is forgotten, and a row with its key and
    ``gone`` true, otherwise null, is returned; entries have ``gone`` false. Such a
    query runs on a live trigger: it always has a next batch to look for idle
    tracks in.
    """
    order = arrival_columns(arrival)
    kept, entries, stamps = narrowed(df, key, time, order, {STATE_NAME: columns})
    thinned = reduce_batches(kept, key, time, arrival, max_features)
    output = _output(kept, key, entries[STATE_NAME], idle_expiry_ms)
    tracks = thinned.groupBy(key).transformWithState(
        TrackProcessor(entries, output, len(order), max_features, idle_expiry_ms),
        output,
        "Update",
        _time_mode(idle_expiry_ms),
    )
    return restored(tracks, stamps)


def stream_track_branches(
    df: DataFrame,
    branches: Mapping[str, Mapping[str, str]],
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
) -> DataFrame:
    """Several tracks per key from one read and one shuffle of the input.

    ``branches`` names each branch and its columns, as result name to column of
    ``df``; all have the same names and types, such as a position before and
    after a projection. Each branch has a list state of its own, which
    ``stored_tracks`` reads by the branch's name. Per trigger the entries of the
    touched tracks are returned, with their ``branch``.
    """
    order = arrival_columns(arrival)
    kept, entries, stamps = narrowed(
        df, key, time, order, {name: list(columns.values()) for name, columns in branches.items()}
    )
    shared = {}
    for name, columns in branches.items():
        again = {column: out for out, column in columns.items()}
        shared[name] = T.StructType(
            [T.StructField(again.get(f.name, f.name), f.dataType) for f in entries[name]]
        )
    first, *others = shared.values()
    if any(entry != first for entry in others):
        raise ValueError("branches differ in the names or types of their columns")
    output = _output(kept, key, first, None, "branch")
    thinned = reduce_batches(kept, key, time, arrival, max_features)
    tracks = thinned.groupBy(key).transformWithState(
        TrackProcessor(shared, output, len(order), max_features), output, "Update", "None"
    )
    renamed = {out for columns in branches.values() for out, column in columns.items() if column in stamps}
    return restored(tracks, (stamps & {time, *order}) | renamed)


def stream_commanded_tracks(
    df: DataFrame,
    commands: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    action: str = "action",
) -> DataFrame:
    """Tracks of a stream of records, with entries taken out by a stream of commands.

    A command has a key, the arrival columns, the ``action`` ``remove`` with a time,
    or ``clear``. It acts on what arrived before it, in its trigger and in earlier
    ones: ``remove`` takes out the entry of that very time, if there is one, and
    ``clear`` all entries. What was dropped before does not come back; a report
    at a removed time is taken in again. Per trigger the entries of every touched
    track are returned; a track without entries gives no row and has no state.
    """
    order = arrival_columns(arrival)
    kept, entries, stamps = narrowed(df, key, time, order, {STATE_NAME: columns})
    told = commands.select(
        key,
        *[(F.unix_micros(n) if n in stamps else F.col(n)).alias(n) for n in (time, *order)],
        F.lit(None).cast(kept.schema[STATE_NAME].dataType).alias(STATE_NAME),
        F.coalesce(action, F.lit("")).alias(_ACTION),
    )
    both = kept.withColumn(_ACTION, F.lit(None).cast("string")).union(told)
    output = _output(kept, key, entries[STATE_NAME], None)
    tracks = both.groupBy(key).transformWithState(
        CommandedTracks(entries, output, len(order), max_features), output, "Update", "None"
    )
    return restored(tracks, stamps)


def stored_tracks(
    spark: SparkSession,
    checkpoint: str,
    timestamps: Sequence[str] = (),
    name: str = STATE_NAME,
) -> DataFrame:
    """All entries a track query holds as of its last trigger, touched or not.

    Reads the state partitions of the checkpoint in parallel, one row per
    entry. ``timestamps`` names the columns that were timestamps (with time
    zone) in the stream, since the state holds those as microseconds; ``name`` is
    that of the branch, where there are several.
    """
    held = (
        spark.read.format("statestore")
        .option("stateVarName", name)
        .load(checkpoint)
    )
    return restored(held.select("key.*", "list_element.*"), set(timestamps))
