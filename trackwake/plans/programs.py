"""The complete jobs: from an input table or stream to what is published.

Each ``..._messages``/``..._snapshot`` function maps a DataFrame to a DataFrame
and runs on tables and streams alike. The ``start_...`` functions attach a sink
to a stream, with one checkpoint folder per query and the state in RocksDB;
message sinks can be replaced by any other, and topics are read by
``sources.kafka`` and ``kafka_features``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trackwake.functions.text import update_trace
from trackwake.operators.aggregates import running_count
from trackwake.operators.ingest import parse_flights
from trackwake.operators.ordering import Arrival, arrival_columns
from trackwake.operators.position import (
    last_known_position,
    latest_report,
    snapshot_rows,
)
from trackwake.operators.publish import (
    COUNTS_SUFFIX,
    STATE_SUFFIX,
    count_messages,
    state_messages,
)
from trackwake.operators.schema import (
    apply_feature_schema,
    geometry_column,
    read_feature_schema,
    track_updates,
    with_track_id,
)
from trackwake.operators.spatial import project_points
from trackwake.sources.kafka import (
    ARRIVAL,
    kafka_source_options,
    kafka_stream,
)
from trackwake.streaming.sinks import (
    console_sink,
    message_sink,
    view_sink,
)
from trackwake.streaming.state import start
from trackwake.streaming.stored import (
    state_sink,
    stored_latest,
    stored_positions,
)
from trackwake.streaming.tracks import stream_track_state

TRACK_LENGTH = 2

# From messages, a query name and a checkpoint folder to a writer.
MessageSink = Callable[[DataFrame, str, str], DataStreamWriter]


def topic_sink(bootstrap: str) -> MessageSink:
    """Publish to the topics named in the messages."""
    return partial(message_sink, bootstrap=bootstrap)


def flight_count_messages(lines: DataFrame, topic: str) -> DataFrame:
    """Flight lines to running-count messages on ``<topic>-counts``."""
    return count_messages(running_count(parse_flights(lines)), topic, suffix=COUNTS_SUFFIX)


def start_flight_counter(
    lines: DataFrame, topic: str, checkpoint: str, sink: MessageSink
) -> StreamingQuery:
    messages = flight_count_messages(lines, topic)
    return start(lines.sparkSession, sink(messages, "flight_counter", checkpoint))


def flight_positions(lines: DataFrame, arrival: Arrival = ARRIVAL) -> DataFrame:
    """Flight lines to the last known position of every flight."""
    order = tuple(arrival_columns(arrival))
    return last_known_position(parse_flights(lines, keep=order), arrival=arrival)


def flight_traces(lines: DataFrame) -> DataFrame:
    """Flight lines to one trace text per report."""
    reports = parse_flights(lines)
    trace = update_trace(F.col("flight_id"), F.col("longitude"), F.col("latitude"))
    return reports.select(trace.alias("trace"))


def start_position_keeper(
    lines: DataFrame, checkpoint: str, arrival: Arrival = ARRIVAL
) -> StreamingQuery:
    """Keep the last known positions of all flights as state; can be restarted."""
    sink = state_sink(flight_positions(lines, arrival), "position_keeper", checkpoint)
    return start(lines.sparkSession, sink)


def kept_positions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The positions a position keeper holds as of its last trigger, running or not."""
    schema = T.StructType.fromDDL("flight_id string, longitude double, latitude double")
    return stored_positions(spark, checkpoint, schema)


def start_position_traces(lines: DataFrame, checkpoint: str) -> StreamingQuery:
    """Show one trace text per report on the console, the first ones of a trigger."""
    traces = flight_traces(lines)
    sink = console_sink(traces, "position_traces", checkpoint, mode="append")
    return start(lines.sparkSession, sink.option("truncate", False))


def feature_count_messages(features: DataFrame, schema: str, topic: str) -> DataFrame:
    """Features to running counts per track on ``<topic>-state``."""
    updates = track_updates(apply_feature_schema(features, schema))
    counts = running_count(updates, "trackId")
    return count_messages(counts, topic, key="trackId", suffix=STATE_SUFFIX)


def start_feature_counter(
    features: DataFrame, schema: str, topic: str, checkpoint: str, sink: MessageSink
) -> StreamingQuery:
    messages = feature_count_messages(features, schema, topic)
    return start(features.sparkSession, sink(messages, "feature_counter", checkpoint))


def projected_features(
    features: DataFrame, schema: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Features with their track key, moved to Web Mercator."""
    typed = with_track_id(apply_feature_schema(features, schema, keep))
    return project_points(typed, geometry_column(typed.schema))


def start_track_publisher(
    features: DataFrame,
    schema: str,
    topic: str,
    checkpoint: str,
    sink: MessageSink,
    arrival: Arrival = ARRIVAL,
) -> StreamingQuery:
    """Publish the latest projected position of each touched track."""
    messages = latest_state_messages(features, schema, topic, arrival)
    return start(features.sparkSession, sink(messages, "track_publisher", checkpoint))


def latest_state_messages(
    features: DataFrame, schema: str, topic: str, arrival: Arrival = ARRIVAL
) -> DataFrame:
    """Features to position messages on ``<topic>-state``.

    A message holds a track's newest entry, which needs no track state: it is
    an aggregate for any track length of at least one.
    """
    order = tuple(arrival_columns(arrival))
    moved = projected_features(features, schema, order)
    shape = geometry_column(moved.schema)
    latest = latest_report(moved, "trackId", "time", order, [shape])
    return state_messages(latest, topic, "trackId", shape)


def projected_tracks(
    features: DataFrame,
    schema: str,
    arrival: Arrival = ARRIVAL,
    max_features: int = TRACK_LENGTH,
) -> DataFrame:
    """A feature stream to the projected entries of each touched track."""
    order = tuple(arrival_columns(arrival))
    moved = projected_features(features, schema, order)
    shape = geometry_column(moved.schema)
    return stream_track_state(
        moved, "trackId", "time", order, max_features, [shape]
    )


def start_replay_tracker(
    features: DataFrame, schema: str, checkpoint: str, arrival: Arrival = ARRIVAL
) -> StreamingQuery:
    """Show the projected tracks of a replayed feature table on the console."""
    tracks = projected_tracks(features, schema, arrival)
    return start(
        features.sparkSession, console_sink(tracks, "replay_tracker", checkpoint)
    )


def track_latest(
    features: DataFrame,
    schema: str,
    arrival: Arrival = ARRIVAL,
    project: bool = False,
) -> DataFrame:
    """Features to ``trackId``, ``time`` and the geometry of every track's newest entry."""
    order = tuple(arrival_columns(arrival))
    typed = with_track_id(apply_feature_schema(features, schema, order))
    shape = geometry_column(typed.schema)
    if project:
        typed = project_points(typed, shape)
    return latest_report(typed, "trackId", "time", order, [shape])


def track_snapshot(
    features: DataFrame,
    schema: str,
    arrival: Arrival = ARRIVAL,
    project: bool = False,
) -> DataFrame:
    """Features to ``(trackId, latestTime, latestPosition)`` of every track.

    In complete mode a stream gives all tracks each trigger, touched or not.
    """
    latest = track_latest(features, schema, arrival, project)
    return snapshot_rows(latest, "trackId", geometry=latest.columns[-1])


def start_track_keeper(
    features: DataFrame,
    schema: str,
    checkpoint: str,
    arrival: Arrival = ARRIVAL,
    project: bool = False,
) -> StreamingQuery:
    """Keep every track's newest entry as state, for ``kept_snapshot``."""
    latest = track_latest(features, schema, arrival, project)
    return start(features.sparkSession, state_sink(latest, "track_keeper", checkpoint))


def kept_snapshot(
    spark: SparkSession, checkpoint: str, schema: str, view: str | None = None
) -> DataFrame:
    """The snapshot of all tracks of a track keeper, touched or not, as of its last trigger.

    A trigger writes no snapshot; this reads the state where one is wanted. With
    ``view`` the rows are registered for SQL under that name.
    """
    kinds = read_feature_schema(schema)
    shape = geometry_column(kinds)
    latest = T.StructType(
        [
            T.StructField("trackId", T.StringType()),
            T.StructField("time", T.TimestampType()),
            T.StructField(shape, kinds[shape].dataType),
        ]
    )
    rows = snapshot_rows(stored_latest(spark, checkpoint, latest), "trackId", geometry=shape)
    if view is not None:
        rows.createOrReplaceTempView(view)
    return rows


def start_snapshots(
    features: DataFrame,
    schema: str,
    checkpoint: str,
    arrival: Arrival = ARRIVAL,
    query: str = "select * from {view}",
) -> list[StreamingQuery]:
    """Two branches over one input, raw and projected, each with its own state."""
    started = []
    for view, project in (("gateway", False), ("projected", True)):
        snapshot = track_snapshot(features, schema, arrival, project)
        sink = view_sink(
            snapshot,
            f"snapshot_{view}",
            f"{checkpoint}/{view}",
            view,
            query.format(view=view),
        )
        started.append(start(features.sparkSession, sink))
    return started


def decode_features(messages: DataFrame, schema: str) -> DataFrame:
    """Binary messages to feature columns, other columns carried along.

    A message is a JSON object keyed by the schema's names: the geometry as
    ``{"x": ..., "y": ...}`` or null, the time as milliseconds since 1970 or
    null. A message that is not such an object stops the query.
    """
    fields = [
        T.StructField(f.name, T.LongType() if f.name == "time" else T.StringType())
        if isinstance(f.dataType, T.TimestampType)
        else f
        for f in read_feature_schema(schema).fields
    ]
    record = F.from_json(
        F.col("value").cast("string"), T.StructType(fields), {"mode": "FAILFAST"}
    )
    carried = [name for name in messages.columns if name != "value"]
    return messages.select(record.alias("__record"), *carried).select(
        *[
            F.timestamp_millis("__record.time").alias("time")
            if f.name == "time"
            else F.col("__record")[f.name].alias(f.name)
            for f in fields
        ],
        *carried,
    )


def kafka_features(
    spark: SparkSession,
    bootstrap: str,
    topic: str,
    schema: str,
    group: str | None = None,
) -> DataFrame:
    """A topic of feature messages as feature columns with arrival columns."""
    options = kafka_source_options(bootstrap, topic, group=group)
    return decode_features(kafka_stream(spark, options, "binary"), schema)
