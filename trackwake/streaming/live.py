"""Per-record results and lookups against live tracks.

A stateful operator meets a key's rows in one task and in no order. So it only
says, per trigger and key, what was held, in one row; the trigger's own rows pass
it by and meet those rows in a batch job, where windows, ranges of hot keys and
built-in functions do the rest. Both come from one query, so state and results
advance together; a trigger that is run again replaces its own results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from trackwake.operators.ordering import Arrival, arrival_columns
from trackwake.operators.records import record_tracks
from trackwake.operators.skew import join_per_key
from trackwake.operators.tracks import timed
from trackwake.streaming.sinks import TRIGGER, stream_writer
from trackwake.streaming.tracks import (
    STATE_NAME,
    TrackProcessor,
    narrowed,
    reduce_batches,
)

_ROWS = "__records"
_OWN = "__own_"
_HELD = "__is_held"


class HeldBefore(TrackProcessor):
    """Emits, per touched key, the number of records and the track before the trigger."""

    def init(self, handle) -> None:
        super().init(handle)
        self.number = handle.getValueState("records", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.load()
        count = self.number.get()[0] if self.number.exists() else 0
        own = 0

        def counted():
            nonlocal own
            for row in rows:
                own += row[-1]
                if not row[-1]:
                    yield Row(*row[:-1])

        self.store(self.taken(before, counted()))
        self.number.update((count + own,))
        entries = [(time, *arrival, *values[0]) for time, arrival, values in before]
        yield self.emit(*key, count, entries)


class HeldAfter(TrackProcessor):
    """Emits, per key with records or probes, the track after the trigger."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.load()
        track = self.taken(before, (row for row in rows if row[1] is not None))
        if track != before:
            self.store(track)
        entries = [(time, *arrival, *values[0]) for time, arrival, values in track]
        yield self.emit(*key, 0, entries)


def _counted(df: DataFrame, key: str, time: str, arrival: Arrival, max_features: int) -> DataFrame:
    """Thinned records, and the number of all records of a key, in a row of its own."""
    blanks = [T.StructField(f.name, f.dataType) for f in df.schema]  # may be null here
    schema = T.StructType([*blanks, T.StructField(_ROWS, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(batch[key])
            keys, counts = found.field("values"), found.field("counts")
            blank = [
                keys.cast(field.type) if field.name == key else pa.nulls(len(keys), field.type)
                for field in batch.schema
            ]
            yield pa.RecordBatch.from_arrays([*blank, counts], [*batch.schema.names, _ROWS])

    thinned = reduce_batches(df, key, time, arrival, max_features)
    return thinned.withColumn(_ROWS, F.lit(0).cast("long")).union(df.mapInArrow(count, schema))


def _held_rows(kept: DataFrame, key: str, entry: T.StructType) -> T.StructType:
    return T.StructType(
        [
            kept.schema[key],
            T.StructField("n", T.LongType()),
            T.StructField("track", T.ArrayType(entry)),
        ]
    )


def _with_held(own: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """A trigger's own rows, and after them the rows that say what was held."""
    nothing = lambda field: F.lit(None).cast(field.dataType)
    rows = own.select(
        F.col(key),
        *[F.col(c).alias(f"{_OWN}{c}") for c in own.columns],
        *[nothing(held.schema[c]).alias(c) for c in ("n", "track")],
        F.lit(False).alias(_HELD),
    )
    return rows.union(
        held.select(key, *[nothing(f) for f in own.schema], "n", "track", F.lit(True))
    )


def _entries_restored(held: DataFrame, stamps: set[str]) -> DataFrame:
    """The held track with its timestamps as such."""
    names = held.schema["track"].dataType.elementType.names
    entry = lambda e: F.struct(
        *[(F.timestamp_micros(e[n]) if n in stamps else e[n]).alias(n) for n in names]
    )
    return held.withColumn("track", F.transform("track", entry))


def _sink(
    rows: DataFrame,
    outcome: Callable[[DataFrame, DataFrame], DataFrame],
    key: str,
    name: str,
    checkpoint: str,
    path: str,
    interval: str | None,
    once: bool,
) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        # Used more than once below; what does not fit in memory goes to disk.
        found = batch.persist()
        try:
            names = [c for c in found.columns if c.startswith(_OWN)]
            own = found.where(~F.col(_HELD)).select(
                *[F.col(c).alias(c.removeprefix(_OWN)) for c in names]
            )
            held = found.where(_HELD).select(key, "n", "track")
            outcome(own, held).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            found.unpersist()

    return stream_writer(rows, name, checkpoint, "update", interval, once).foreachBatch(write)


def record_sink(
    df: DataFrame,
    name: str,
    checkpoint: str,
    path: str,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    interval: str | None = TRIGGER,
    once: bool = False,
) -> DataStreamWriter:
    """For each record, its track's count, whether it was added, and the newest entry then.

    Writes ``key``, the arrival columns, ``n``, ``added``, ``latest_time`` (called
    after ``time``) and ``latest_<column>`` to ``path/batch_id=<n>``. Records are
    taken trigger by trigger, those of a trigger in arrival order; of equal times
    the first arrived is the track's entry. A trigger may hold any number of
    records of a key: they are never in one task's memory.
    """
    order = arrival_columns(arrival)
    limit = max(max_features, 0)
    kept, entries, stamps = narrowed(df, key, time, order, {STATE_NAME: columns})
    # The newest entry is asked for even of tracks that hold none.
    counted = _counted(timed(kept, time), key, time, arrival, max(limit, 1))
    output = _held_rows(kept, key, entries[STATE_NAME])
    held = counted.groupBy(key).transformWithState(
        HeldBefore(entries, output, len(order), max(limit, 1)), output, "Update", "None"
    )
    wanted = list(dict.fromkeys([key, time, *order, *columns]))
    rows = _with_held(df.select(*wanted), _entries_restored(held, stamps), key)

    def outcome(own: DataFrame, before: DataFrame) -> DataFrame:
        return record_tracks(own, key, time, arrival, limit, columns, before)

    return _sink(rows, outcome, key, name, checkpoint, path, interval, once)


def probe_sink(
    df: DataFrame,
    probes: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    name: str,
    checkpoint: str,
    path: str,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    interval: str | None = TRIGGER,
    once: bool = False,
) -> DataStreamWriter:
    """Answers to a stream of probes from the live tracks of a stream of records.

    A probe is a row with a ``key``. It meets its track as it is after the records
    of the probe's trigger, as the array column ``track`` of entries with ``time``,
    the arrival and ``columns``, empty where there is none; ``answer`` makes the
    result of these rows, as a rule with ``functions.track_array``: previous, next,
    contains. Results go to ``path/batch_id=<n>``.
    """
    order = arrival_columns(arrival)
    kept, entries, stamps = narrowed(df, key, time, order, {STATE_NAME: columns})
    asked = probes.select(
        key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema if f.name != key]
    )
    thinned = reduce_batches(timed(kept, time), key, time, arrival, max(max_features, 1))
    both = thinned.union(_distinct(asked, key))
    output = _held_rows(kept, key, entries[STATE_NAME])
    held = both.groupBy(key).transformWithState(
        HeldAfter(entries, output, len(order), max_features), output, "Update", "None"
    )
    rows = _with_held(probes, _entries_restored(held, stamps), key)

    def outcome(own: DataFrame, after: DataFrame) -> DataFrame:
        kind = after.schema["track"].dataType
        renamed = T.StructType(
            [T.StructField("time" if f.name == time else f.name, f.dataType) for f in kind.elementType]
        )
        tracks = after.select(key, F.col("track").cast(T.ArrayType(renamed)).alias("track"))
        met = join_per_key(own, tracks, key, "left")
        none = F.array().cast(T.ArrayType(renamed))
        return answer(met.withColumn("track", F.coalesce("track", none)))

    return _sink(rows, outcome, key, name, checkpoint, path, interval, once)


def _distinct(df: DataFrame, key: str) -> DataFrame:
    """One row per key and Arrow batch; the rows are alike but for the key."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch[key].dictionary_encode("encode").indices.to_numpy()
            yield batch.take(pa.array(np.unique(codes, return_index=True)[1]))

    return df.mapInArrow(first, df.schema)
