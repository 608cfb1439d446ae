"""Entry point, registered queries and their SQL twins."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackwake.functions import track_array
from trackwake.functions.geometry import WEB_MERCATOR
from trackwake.functions.shapes import shape_to_wkb, wkb_to_shape
from trackwake.functions.text import update_trace
from trackwake.operators.aggregates import running_count
from trackwake.operators.ingest import (
    flight_lines,
    flight_rejects,
    parse_flights,
    text_payload,
)
from trackwake.operators.position import (
    last_known_position,
    latest_report,
    snapshot_rows,
)
from trackwake.operators.publish import count_messages, state_messages
from trackwake.operators.records import record_updates
from trackwake.operators.schema import (
    apply_feature_schema,
    feature_rows,
    geometry_column,
    projected_schema,
    read_feature_schema,
    track_updates,
)
from trackwake.operators.spatial import (
    null_geometry,
    points_to_wkb,
    project_points,
    transform_records,
    wkb_to_points,
)
from trackwake.operators.history import (
    history_contains,
    history_ends,
    history_next,
    history_previous,
    history_range,
    history_remove,
    save_history,
    saved_history,
    track_history,
)
from trackwake.operators.tracks import (
    track_next,
    track_previous,
    track_state,
    track_table,
)
from trackwake.plans.event_flights import (
    events_path,
    flights,
    flights_of,
    with_geometry,
)
from trackwake.plans.programs import (
    feature_count_messages,
    kept_snapshot,
    track_latest as newest_entries,
    track_snapshot,
)
from trackwake.sources.replay import (
    replay_rows,
    replay_table,
    stage_rows,
    text_stream,
)
from trackwake.streaming.folders import new_folder
from trackwake.streaming.sinks import (
    latest_batches,
    run_available,
    table_sink,
    view_sink,
)
from trackwake.streaming.stored import state_sink, stored_counts, stored_positions
from trackwake.streaming.live import probe_sink, record_sink
from trackwake.streaming.tracks import (
    stored_tracks,
    stream_commanded_tracks,
    stream_track_branches,
    stream_track_state,
)

Query = Callable[[SparkSession, str], DataFrame]

# The flight feature schema.
FLIGHT_SCHEMA = json.dumps(
    {
        "attributes": [
            {
                "name": "flightId",
                "dataType": "String",
                "nullable": False,
                "tags": [{"name": "TRACK_ID", "types": ["String"]}],
            },
            {
                "name": "flightTime",
                "dataType": "Date",
                "nullable": False,
                "tags": [{"name": "START_TIME", "types": ["Date"]}],
            },
            {"name": "longitude", "dataType": "Float64", "nullable": False},
            {"name": "latitude", "dataType": "Float64", "nullable": False},
            {"name": "origin", "dataType": "String", "nullable": False},
            {"name": "destination", "dataType": "String", "nullable": False},
            {"name": "aircraft", "dataType": "String", "nullable": False},
            {"name": "altitude", "dataType": "Int32", "nullable": False},
        ],
        "geometry": {
            "geometryType": "GeometryPoint",
            "spatialReference": {"wkid": 4326},
            "fieldName": "Geometry",
        },
        "time": {"timeType": "Instant"},
    }
)

# All files of a replayed table go into few triggers; tests use one file each.
FILES_PER_TRIGGER = 1000
ROWS_PER_TRIGGER = 40_000


# -- inputs ------------------------------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The flights as message bytes, with their arrival."""
    lines = flight_lines(flights(spark, folder), keep=("arrival_seq", "event_id"))
    return text_payload(lines.withColumn("value", F.col("value").cast("binary")))


def _broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The flight lines, every 97th with an altitude that is no whole number."""
    source = flights(spark, folder)
    altitude = F.when(F.col("event_id") % 97 == 0, F.lit("12.5")).otherwise(
        F.col("altitude").cast("string")
    )
    return flight_lines(
        source.withColumn("altitude", altitude), keep=("event_id",)
    )


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return flights_of(replay_table(spark, events_path(folder), FILES_PER_TRIGGER))


def _features(df: DataFrame) -> DataFrame:
    """Flights as feature columns: attributes, geometry, time."""
    return with_geometry(df).select(
        F.col("flight_id").alias("flightId"),
        F.col("flight_time").alias("flightTime"),
        "longitude",
        "latitude",
        "origin",
        "destination",
        "aircraft",
        "altitude",
        F.col("geometry").alias("Geometry"),
        F.col("flight_time").alias("time"),
        "arrival_seq",
    )


def _tracks(
    spark: SparkSession, folder: str, max_features: int = 2
) -> DataFrame:
    """Bounded tracks by day, so that many reports of a flight share a time."""
    return track_table(
        flights(spark, folder),
        time="track_day",
        max_features=max_features,
        columns=["longitude", "latitude"],
    )


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Whole tracks by day, one row per entry."""
    return track_history(
        flights(spark, folder), time="track_day", columns=["longitude", "latitude"]
    )


def _present(spark: SparkSession, folder: str) -> DataFrame:
    """Probes at times that are in the flight's history."""
    return flights(spark, folder).select(
        "event_id", "flight_id", F.col("track_day").alias("probe_time")
    )


def _absent(spark: SparkSession, folder: str) -> DataFrame:
    """Probes half a day off, at times no track holds."""
    shifted = F.col("track_day") + F.expr("INTERVAL 12 HOURS")
    return flights(spark, folder).select(
        "event_id", "flight_id", shifted.alias("probe_time")
    )


def _centimetres(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


# -- batch queries -----------------------------------------------------------


def csv_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return parse_flights(_lines(spark, folder))


def csv_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return parse_flights(
        _broken_lines(spark, folder), mode="reject", keep=("event_id",)
    ).select("event_id", "flight_id", "altitude")


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return flight_rejects(_broken_lines(spark, folder)).select("event_id", "reason")


def running_count_query(spark: SparkSession, folder: str) -> DataFrame:
    return running_count(parse_flights(_lines(spark, folder)))


def count_message_rows(spark: SparkSession, folder: str) -> DataFrame:
    messages = count_messages(running_count(flights(spark, folder)), "flights")
    return messages.withColumn("value", F.hex("value"))


def feature_count_message_rows(spark: SparkSession, folder: str) -> DataFrame:
    features = _features(flights(spark, folder))
    messages = feature_count_messages(features, FLIGHT_SCHEMA, "flights")
    return messages.withColumn("value", F.hex("value"))


def last_known_position_query(spark: SparkSession, folder: str) -> DataFrame:
    return last_known_position(flights(spark, folder))


def update_trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    trace = update_trace(F.col("flight_id"), F.col("longitude"), F.col("latitude"))
    return parse_flights(_lines(spark, folder)).select(trace.alias("trace"))


def feature_schema_rows(spark: SparkSession, folder: str) -> DataFrame:
    typed = apply_feature_schema(_features(flights(spark, folder)), FLIGHT_SCHEMA)
    return feature_rows(typed).select(
        "flightId",
        F.col("flightTime").cast("timestamp_ntz").alias("flightTime"),
        "longitude",
        "latitude",
        "origin",
        "destination",
        "aircraft",
        F.col("altitude").cast("bigint").alias("altitude"),
        F.col("SHAPE.x").alias("shape_x"),
        F.col("SHAPE.y").alias("shape_y"),
    )


def feature_rename(spark: SparkSession, folder: str) -> DataFrame:
    typed = apply_feature_schema(_features(flights(spark, folder)), FLIGHT_SCHEMA)
    return track_updates(typed).select(
        "trackId",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("geometry.x").alias("x"),
        F.col("geometry.y").alias("y"),
    )


def project_points_query(spark: SparkSession, folder: str) -> DataFrame:
    moved = project_points(with_geometry(flights(spark, folder)))
    return moved.select(
        "event_id",
        "flight_id",
        _centimetres("geometry.x").alias("x_cm"),
        _centimetres("geometry.y").alias("y_cm"),
    )


def projected_null_geometry(spark: SparkSession, folder: str) -> DataFrame:
    located = with_geometry(flights(spark, folder))
    moved = located.transform(null_geometry).transform(project_points)
    return moved.select(
        "event_id",
        "flight_id",
        _centimetres("geometry.x").alias("x_cm"),
        _centimetres("geometry.y").alias("y_cm"),
    )


def _northward(batch: pa.RecordBatch, schema) -> pa.RecordBatch:
    """Records with their latitude moved up by one degree."""
    at = schema.names.index("latitude")
    moved = pc.add(batch.column(at), 1.0)
    columns = [moved if i == at else c for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def transformed_columns(spark: SparkSession, folder: str) -> DataFrame:
    located = flights(spark, folder).select("event_id", "longitude", "latitude")
    return located.transform(
        lambda df: df.withColumn("latitude", F.col("latitude") + 1.0)
    )


def transformed_records(spark: SparkSession, folder: str) -> DataFrame:
    located = flights(spark, folder).select("event_id", "longitude", "latitude")
    return transform_records(located, _northward, located.schema)


def projected_schema_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Projected features, with the reference their schema names."""
    schema = projected_schema(read_feature_schema(FLIGHT_SCHEMA), WEB_MERCATOR)
    typed = apply_feature_schema(_features(flights(spark, folder)), FLIGHT_SCHEMA)
    shape = geometry_column(schema)
    moved = project_points(typed, shape)
    return moved.select(
        F.lit(schema[shape].metadata["wkid"]).alias("schema_wkid"),
        F.lit(moved.schema[shape].metadata["wkid"]).alias("wkid"),
        F.col("flightId").alias("flight_id"),
        _centimetres(f"{shape}.x").alias("x_cm"),
        _centimetres(f"{shape}.y").alias("y_cm"),
    )


def wkb_bytes(spark: SparkSession, folder: str) -> DataFrame:
    packed = points_to_wkb(with_geometry(flights(spark, folder)))
    return packed.select("event_id", F.hex("geometry").alias("wkb"))


def wkb_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    located = with_geometry(flights(spark, folder))
    back = wkb_to_points(points_to_wkb(located))
    return back.select(
        "event_id", F.col("geometry.x").alias("lon"), F.col("geometry.y").alias("lat")
    )


def _xy(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def track_lines_wkb(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded tracks as lines in WKB."""
    points = F.transform("track", lambda e: _xy(e["longitude"], e["latitude"]))
    line = F.struct(F.lit("line").alias("kind"), F.array(points).alias("parts"))
    return _tracks(spark, folder, 5).select("flight_id", F.hex(shape_to_wkb(line)).alias("wkb"))


def shapes_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The box around each flight's reports, as a polygon to WKB and back."""
    box = flights(spark, folder).groupBy("flight_id").agg(
        *[f(c).alias(f"{n}_{c[:3]}") for c in ("longitude", "latitude") for n, f in (("low", F.min), ("high", F.max))]
    )
    corners = (("low", "low"), ("high", "low"), ("high", "high"), ("low", "high"), ("low", "low"))
    ring = F.array(*[_xy(F.col(f"{a}_lon"), F.col(f"{b}_lat")) for a, b in corners])
    polygon = F.struct(F.lit("polygon").alias("kind"), F.array(ring).alias("parts"))
    back = box.select("flight_id", wkb_to_shape(shape_to_wkb(polygon)).alias("shape"))
    return back.select("flight_id", "shape.kind", F.posexplode(F.flatten("shape.parts"))).select(
        "flight_id",
        "kind",
        F.col("pos").cast("bigint").alias("place"),
        F.col("col.x").alias("x"),
        F.col("col.y").alias("y"),
    )


def track_state_query(spark: SparkSession, folder: str) -> DataFrame:
    return track_state(flights(spark, folder), time="track_day", max_features=2)


def track_ends(spark: SparkSession, folder: str) -> DataFrame:
    return history_ends(_history(spark, folder), columns=["arrival_seq"]).select(
        "flight_id",
        "latest_time",
        F.col("latest_arrival_seq").alias("latest_arrival"),
        "oldest_time",
        F.col("oldest_arrival_seq").alias("oldest_arrival"),
        "entries",
    )


def track_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_report(
        flights(spark, folder),
        "flight_id",
        "track_day",
        "arrival_seq",
        ["arrival_seq", "longitude", "latitude"],
    )


def _entries(found: DataFrame, column: str) -> DataFrame:
    return found.select("event_id", "flight_id", "probe_time", F.posexplode(column)).select(
        "event_id",
        "flight_id",
        "probe_time",
        F.col("pos").cast("bigint").alias("place"),
        F.col("col.time").alias("entry_time"),
        F.col("col.longitude").alias("longitude"),
        F.col("col.latitude").alias("latitude"),
    )


def _previous(probes, n: int, descending: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = history_previous(
            probes(spark, folder),
            _history(spark, folder),
            "probe_time",
            n,
            columns=["longitude", "latitude"],
            descending=descending,
        )
        return _entries(found, "previous")

    return query


def _next(probes, n: int, descending: bool = False, strict: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = history_next(
            probes(spark, folder),
            _history(spark, folder),
            "probe_time",
            n,
            columns=["longitude", "latitude"],
            descending=descending,
            strict_successor=strict,
        )
        return _entries(found, "next")

    return query


def bounded_previous(spark: SparkSession, folder: str) -> DataFrame:
    """Among the last two entries only, the bound that track_state keeps."""
    found = track_previous(
        _present(spark, folder), _tracks(spark, folder), "probe_time"
    )
    return _entries(found, "previous")


def bounded_next(spark: SparkSession, folder: str) -> DataFrame:
    found = track_next(_present(spark, folder), _tracks(spark, folder), "probe_time")
    return _entries(found, "next")


def saved_previous(spark: SparkSession, folder: str) -> DataFrame:
    """Lookups in a history that was laid out for them."""
    path = new_folder(spark, "history")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    save_history(_history(spark, folder), name, path)
    found = history_previous(
        _present(spark, folder),
        saved_history(spark, name),
        "probe_time",
        2,
        columns=["longitude", "latitude"],
    )
    return _entries(found, "previous")


def track_range_query(spark: SparkSession, folder: str) -> DataFrame:
    start, end = (F.lit(day).cast("timestamp_ntz") for day in RANGE)
    cut = history_range(_history(spark, folder), start, end)
    return cut.select("flight_id", "time", "arrival_seq")


def track_contains_query(spark: SparkSession, folder: str) -> DataFrame:
    return history_contains(
        _present(spark, folder), _history(spark, folder), "probe_time"
    ).select("event_id", "flight_id", "probe_time", "contained")


def track_remove_query(spark: SparkSession, folder: str) -> DataFrame:
    errors = flights(spark, folder).where(F.col("origin") == "ERR")
    marked = history_remove(_history(spark, folder), errors, "track_day")
    stays = ~F.col("removed")
    return marked.groupBy("flight_id").agg(
        F.count_if(stays).alias("entries"),
        F.max(F.when(stays, F.col("time"))).alias("latest_time"),
    )


def record_updates_query(spark: SparkSession, folder: str) -> DataFrame:
    return record_updates(
        flights(spark, folder), time="flight_time", columns=["longitude", "latitude"]
    )


def snapshot_raw(spark: SparkSession, folder: str) -> DataFrame:
    located = with_geometry(flights(spark, folder))
    latest = latest_report(
        located, "flight_id", "track_day", "arrival_seq", ["geometry"]
    )
    rows = snapshot_rows(latest, "flight_id")
    return spark.sql("select * from {gateway}", gateway=rows)


def snapshot_projected(spark: SparkSession, folder: str) -> DataFrame:
    located = project_points(with_geometry(flights(spark, folder)))
    latest = latest_report(
        located, "flight_id", "track_day", "arrival_seq", ["geometry"]
    )
    rows = latest.select(
        F.col("flight_id").alias("trackId"),
        F.col("time").cast("string").alias("latestTime"),
        _centimetres("geometry.x").alias("x_cm"),
        _centimetres("geometry.y").alias("y_cm"),
    )
    return spark.sql("select * from {projected}", projected=rows)


def state_message_rows(spark: SparkSession, folder: str) -> DataFrame:
    located = with_geometry(flights(spark, folder))
    latest = latest_report(
        located, "flight_id", "track_day", "arrival_seq", ["geometry"]
    )
    return state_messages(latest, "flights")


# -- stream queries: run over all that is there, then read the outcome ------------


def _run_state(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Run a query that keeps state only; its checkpoint."""
    checkpoint = new_folder(spark, name)
    run_available(spark, state_sink(rows, name, checkpoint, once=True))
    return checkpoint


def running_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    counts = running_count(_stream(spark, folder))
    return stored_counts(spark, _run_state(spark, counts, "running_count"))


def last_known_position_stream(spark: SparkSession, folder: str) -> DataFrame:
    last = last_known_position(_stream(spark, folder))
    return stored_positions(spark, _run_state(spark, last, "last_position"), last.schema)


def text_stream_count(spark: SparkSession, folder: str) -> DataFrame:
    """Flight lines in text files, read as a stream and counted."""
    source = new_folder(spark, "lines")
    flight_lines(flights(spark, folder)).write.text(source)
    counts = running_count(parse_flights(text_stream(spark, source)))
    return stored_counts(spark, _run_state(spark, counts, "text_count"))


def snapshot_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Two stateful branches over one stream, raw and projected."""
    work = new_folder(spark, "branches")
    features = _features(_stream(spark, folder))
    found = []
    for view, project in (("gateway", False), ("projected", True)):
        snapshot = track_snapshot(features, FLIGHT_SCHEMA, "arrival_seq", project)
        query = run_available(
            spark,
            view_sink(
                snapshot,
                f"branch_{view}",
                f"{work}/{view}",
                view,
                f"select * from {view}",
                f"{work}/{view}-rows",
                once=True,
            ),
        )
        last = query.lastProgress["batchId"]
        rows = spark.read.parquet(f"{work}/{view}-rows/batch_id={last}")
        found.append(rows.select(F.lit(view).alias("branch"), "trackId", "latestTime"))
    return found[0].union(found[1])


def restarted_count_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A count stopped and started again over its checkpoint: nothing counts twice."""
    checkpoint = new_folder(spark, "restart")
    for _ in range(2):
        counts = running_count(_stream(spark, folder))
        run_available(spark, state_sink(counts, "restarted", checkpoint, once=True))
    return stored_counts(spark, checkpoint)


def track_state_stream(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "track-state")
    tracks = stream_track_state(
        _stream(spark, folder), time="track_day", max_features=2
    )
    run_available(
        spark,
        table_sink(tracks, "track_state", f"{work}/state", f"{work}/rows", once=True),
    )
    return latest_batches(spark, f"{work}/rows", "flight_id")


def track_branches_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw and projected tracks from one read of a stream, each with its own state."""
    work = new_folder(spark, "branches")
    located = with_geometry(_stream(spark, folder))
    both = project_points(located.withColumn("raw", F.col("geometry"))).select(
        "flight_id", "track_day", "arrival_seq", "raw", F.col("geometry").alias("moved")
    )
    branches = {"gateway": {"geometry": "raw"}, "projected": {"geometry": "moved"}}
    tracks = stream_track_branches(both, branches, time="track_day", max_features=2)
    run_available(
        spark,
        table_sink(tracks, "track_branches", f"{work}/state", f"{work}/rows", once=True),
    )
    held = [
        stored_tracks(spark, f"{work}/state", name=name).select(
            F.lit(name).alias("branch"),
            "flight_id",
            F.col("track_day").alias("time"),
            "arrival_seq",
            _centimetres("geometry.x").alias("x_cm"),
            _centimetres("geometry.y").alias("y_cm"),
        )
        for name in branches
    ]
    return held[0].union(held[1])


def track_commands_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of a stream with another stream's removals, in order of arrival."""
    work = new_folder(spark, "commands")
    columns = ["flight_id", "track_day", "arrival_seq"]
    reports = _stream(spark, folder).withColumn("arrival_seq", F.col("arrival_seq") * 2)
    every = lambda n: F.col("event_id") % n == 0
    commands = (
        _stream(spark, folder)
        .where(every(11))
        .withColumn("arrival_seq", F.col("arrival_seq") * 2 + 1)
        .select(*columns, F.when(every(55), F.lit("clear")).otherwise(F.lit("remove")).alias("action"))
    )
    tracks = stream_commanded_tracks(
        reports.select(*columns), commands, time="track_day", max_features=1000
    )
    run_available(
        spark, table_sink(tracks, "commands", f"{work}/state", f"{work}/rows", once=True)
    )
    return stored_tracks(spark, f"{work}/state")


def track_probes_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Probes of a stream, answered from the live tracks of another."""
    work = new_folder(spark, "probes")
    stream = _stream(spark, folder)
    probes = stream.select("event_id", "flight_id", F.col("track_day").alias("probe_time"))

    def answer(rows: DataFrame) -> DataFrame:
        before = track_array.previous(F.col("track"), F.col("probe_time"))
        return rows.select("event_id", "flight_id", "probe_time", before.alias("previous"))

    sink = probe_sink(
        stream,
        probes,
        answer,
        "probes",
        f"{work}/state",
        f"{work}/rows",
        time="track_day",
        max_features=2,
        columns=["longitude", "latitude"],
        once=True,
    )
    run_available(spark, sink)
    return _entries(spark.read.parquet(f"{work}/rows"), "previous")


def stored_tracks_stream(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "stored-tracks")
    tracks = stream_track_state(
        _stream(spark, folder), time="track_day", max_features=3
    )
    run_available(
        spark,
        table_sink(tracks, "stored_tracks", f"{work}/state", f"{work}/rows", once=True),
    )
    return stored_tracks(spark, f"{work}/state")


def track_records_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's outcome, summed up per flight."""
    work = new_folder(spark, "track-records")
    sink = record_sink(
        _stream(spark, folder),
        "track_records",
        f"{work}/state",
        f"{work}/rows",
        time="flight_time",
        max_features=2,
        once=True,
    )
    run_available(spark, sink)
    return (
        spark.read.parquet(f"{work}/rows")
        .groupBy("flight_id")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if("added").alias("added"),
            F.max("latest_flight_time").alias("newest"),
        )
    )


def snapshot_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of all tracks, from the state of a stream of features."""
    features = _features(_stream(spark, folder))
    latest = newest_entries(features, FLIGHT_SCHEMA, "arrival_seq")
    checkpoint = _run_state(spark, latest, "snapshot")
    kept_snapshot(spark, checkpoint, FLIGHT_SCHEMA, view="featureTracks")
    return spark.sql("select * from featureTracks")


def replay_table_stream(spark: SparkSession, folder: str) -> DataFrame:
    work = new_folder(spark, "replay")
    rows = replay_table(spark, events_path(folder), FILES_PER_TRIGGER)
    run_available(
        spark,
        table_sink(
            rows, "replay", f"{work}/state", f"{work}/rows", mode="append", once=True
        ),
    )
    return spark.read.parquet(f"{work}/rows").drop("batch_id")


def replay_rows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events a bounded number of rows per trigger, and how many triggers that took."""
    work = new_folder(spark, "replay-rows")
    stage_rows(spark.read.parquet(events_path(folder)), f"{work}/staged", ROWS_PER_TRIGGER)
    rows = replay_rows(spark, f"{work}/staged")
    run_available(
        spark,
        table_sink(rows, "replay_rows", f"{work}/state", f"{work}/rows", mode="append", once=True),
    )
    replayed = spark.read.parquet(f"{work}/rows")
    sizes = replayed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
    bounded = sizes.select("batch_id", (F.col("rows") <= ROWS_PER_TRIGGER).alias("bounded"))
    return replayed.join(F.broadcast(bounded), "batch_id").select(
        "event_id", "user_id", "event_type", "value", "bounded"
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flight lines to parsed, projected, bounded tracks and their snapshot."""
    folder = "/root/testdata/sf0.001"
    reports = parse_flights(_lines(spark, folder), keep=("arrival_seq",))
    timed = reports.withColumn("time", F.col("flight_time").cast("timestamp_ntz"))
    moved = project_points(with_geometry(timed))
    tracks = track_table(moved, max_features=2, columns=["geometry"])
    newest = track_array.latest(F.col("track"))
    return snapshot_rows(
        tracks.select(
            "flight_id",
            newest["time"].alias("time"),
            newest["geometry"].alias("geometry"),
        ),
        "flight_id",
    )


def _installed(module: str):
    """A module of the corpus operators; None where they are not installed."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name not in (module, "trackwake.llm"):
            raise
        return None


def _corpus_queries() -> dict[str, Query]:
    operators = _installed("trackwake.llm.queries")
    pipeline = operators and _installed("corpus_pipeline")
    found = operators.queries() if operators else {}
    return found | ({"pipeline": pipeline.run} if pipeline else {})


def _corpus_sql() -> dict[str, str]:
    operators = _installed("trackwake.llm.oracles")
    pipeline = operators and _installed("corpus_pipeline")
    found = operators.oracle_sql() if operators else {}
    sql = pipeline.ORACLE_SQL if pipeline else None
    return found | ({"pipeline": sql} if sql else {})


def queries() -> dict[str, Query]:
    return {
        "csv_ingest": csv_ingest,
        "csv_accepted": csv_accepted,
        "csv_rejects": csv_rejects,
        "running_count": running_count_query,
        "running_count_stream": running_count_stream,
        "count_messages": count_message_rows,
        "feature_count_messages": feature_count_message_rows,
        "last_known_position": last_known_position_query,
        "last_known_position_stream": last_known_position_stream,
        "update_trace": update_trace_rows,
        "feature_schema": feature_schema_rows,
        "feature_rename": feature_rename,
        "project_points": project_points_query,
        "projected_null_geometry": projected_null_geometry,
        "wkb_roundtrip": wkb_roundtrip,
        "track_lines_wkb": track_lines_wkb,
        "shapes_roundtrip": shapes_roundtrip,
        "track_state": track_state_query,
        "track_state_stream": track_state_stream,
        "stored_tracks_stream": stored_tracks_stream,
        "track_branches_stream": track_branches_stream,
        "track_commands_stream": track_commands_stream,
        "track_probes_stream": track_probes_stream,
        "track_ends": track_ends,
        "track_latest": track_latest,
        "track_previous_1": _previous(_present, 1),
        "track_previous_2": _previous(_present, 2),
        "track_previous_2_reversed": _previous(_present, 2, descending=True),
        "track_previous_absent": _previous(_absent, 1),
        "track_previous_saved": saved_previous,
        "track_next_1": _next(_present, 1),
        "track_next_2": _next(_present, 2),
        "track_next_2_reversed": _next(_present, 2, descending=True),
        "track_next_absent": _next(_absent, 1),
        "track_next_absent_strict": _next(_absent, 1, strict=True),
        "transformed_columns": transformed_columns,
        "transformed_records": transformed_records,
        "projected_schema": projected_schema_rows,
        "wkb_bytes": wkb_bytes,
        "text_stream_count": text_stream_count,
        "snapshot_branches": snapshot_branches,
        "restarted_count_stream": restarted_count_stream,
        "track_previous_bounded": bounded_previous,
        "track_next_bounded": bounded_next,
        "track_range": track_range_query,
        "track_contains": track_contains_query,
        "track_remove": track_remove_query,
        "record_updates": record_updates_query,
        "track_records_stream": track_records_stream,
        "snapshot_raw": snapshot_raw,
        "snapshot_projected": snapshot_projected,
        "snapshot_stream": snapshot_stream,
        "state_messages": state_message_rows,
        "replay_table": replay_table_stream,
        "replay_rows_stream": replay_rows_stream,
    } | _corpus_queries()


# -- SQL twins -----------------------------------------------------------------

RANGE = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")

_FLIGHTS = """flights AS (
  SELECT concat('F', CAST(user_id AS VARCHAR)) AS flight_id,
         ts AS flight_time,
         CAST(event_id * 37 % 36000 AS DOUBLE) / 100e0 - 180e0 AS longitude,
         CAST(event_id * 17 % 17000 AS DOUBLE) / 100e0 - 85e0 AS latitude,
         upper(substr(event_type, 1, 3)) AS origin,
         concat('D', CAST(user_id % 7 AS VARCHAR)) AS destination,
         concat('A', CAST(event_id % 5 AS VARCHAR)) AS aircraft,
         CAST(floor(value * 100e0) AS BIGINT) AS altitude,
         CAST(date_trunc('day', ts) AS TIMESTAMP) AS track_day,
         xor(event_id, 5461) AS arrival_seq,
         event_id
  FROM events)"""


def _first_arrived(time: str, limit: int | None, name: str = "track") -> str:
    bound = "" if limit is None else f"WHERE age <= {limit}"
    return f"""distinct_times AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id, {time}
                               ORDER BY arrival_seq) AS copy
  FROM flights),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY {time} DESC) AS age
  FROM distinct_times WHERE copy = 1),
{name} AS (
  SELECT flight_id, {time} AS time, arrival_seq, longitude, latitude
  FROM ranked {bound})"""


_TRACK = _first_arrived("track_day", None)
_LATEST = _first_arrived("track_day", 1, "latest")
_MERCATOR = """CAST(round(6378137e0 * radians(longitude) * 100) AS BIGINT) AS x_cm,
       CAST(round(6378137e0 * ln(tan(pi() / 4 + radians(latitude) / 2)) * 100)
            AS BIGINT) AS y_cm"""


def _little_endian(name: str) -> str:
    """A double's bytes as hexadecimal text, the last byte first."""
    digits = f"hex(CAST(CAST({name} AS BIT) AS BLOB))"
    pairs = ", ".join(f"substr({digits}, {at}, 2)" for at in range(15, 0, -2))
    return f"concat({pairs})"


def _probe_sql(shift: str, pick: str, limit: int | None) -> str:
    return f"""WITH {_FLIGHTS}, {_first_arrived("track_day", limit)},
probes AS (
  SELECT event_id, flight_id, track_day + INTERVAL {shift} AS probe_time FROM flights),
{pick}
SELECT event_id, flight_id, probe_time, place, entry_time, longitude, latitude
FROM found"""


def _previous_sql(
    n: int,
    shift: str = "0 HOUR",
    descending: bool = False,
    limit: int | None = None,
) -> str:
    place = f"age - 1" if descending else f"{n} - age"
    return _probe_sql(
        shift,
        f"""met AS (
  SELECT p.*, t.time AS entry_time, t.longitude, t.latitude,
         row_number() OVER (PARTITION BY p.event_id ORDER BY t.time DESC) AS age,
         count(*) OVER (PARTITION BY p.event_id) AS available
  FROM probes p JOIN track t ON p.flight_id = t.flight_id AND t.time < p.probe_time),
found AS (SELECT *, {place} AS place FROM met WHERE age <= {n} AND available >= {n})""",
        limit,
    )


def _next_sql(
    n: int,
    shift: str = "0 HOUR",
    descending: bool = False,
    strict: bool = False,
    limit: int | None = None,
) -> str:
    skip = 0 if strict else 1
    compare = ">" if strict else ">="
    place = f"{n} - (nth - {skip})" if descending else f"nth - {skip} - 1"
    return _probe_sql(
        shift,
        f"""met AS (
  SELECT p.*, t.time AS entry_time, t.longitude, t.latitude,
         row_number() OVER (PARTITION BY p.event_id ORDER BY t.time) AS nth,
         count(*) OVER (PARTITION BY p.event_id) AS available
  FROM probes p
  JOIN track t ON p.flight_id = t.flight_id AND t.time {compare} p.probe_time),
found AS (
  SELECT *, {place} AS place FROM met
  WHERE nth > {skip} AND nth <= {n + skip} AND available >= {n + skip})""",
        limit,
    )


def oracle_sql() -> dict[str, str]:
    columns = (
        "flight_id, CAST(flight_time AS VARCHAR) AS flight_time, longitude, latitude, "
        "origin, destination, aircraft, altitude"
    )
    counts = f"WITH {_FLIGHTS} SELECT flight_id, count(*) AS n FROM flights GROUP BY 1"
    last = f"""WITH {_FLIGHTS}
SELECT flight_id, arg_max(longitude, arrival_seq) AS longitude,
       arg_max(latitude, arrival_seq) AS latitude
FROM flights GROUP BY 1"""

    def hex_counts(topic: str) -> str:
        return f"""WITH {_FLIGHTS}
SELECT '{topic}' AS topic, flight_id AS key,
       lpad(printf('%X', count(*)), 16, '0') AS value
FROM flights GROUP BY flight_id"""

    def entries(limit: int) -> str:
        return f"""WITH {_FLIGHTS}, {_first_arrived('track_day', limit)}
SELECT flight_id, time AS track_day, arrival_seq FROM track"""

    moved = f"""WITH {_FLIGHTS}
SELECT event_id, longitude, latitude + 1 AS latitude FROM flights"""
    snapshot = f"""WITH {_FLIGHTS}, {_LATEST}
SELECT flight_id AS "trackId", CAST(time AS VARCHAR) AS "latestTime",
       concat('(', CAST(longitude AS VARCHAR), ', ', CAST(latitude AS VARCHAR), ', 0.0)')
         AS "latestPosition"
FROM latest"""
    return {
        "csv_ingest": f"WITH {_FLIGHTS} SELECT {columns} FROM flights",
        "csv_accepted": f"""WITH {_FLIGHTS}
SELECT event_id, flight_id, altitude FROM flights WHERE event_id % 97 <> 0""",
        "csv_rejects": f"""WITH {_FLIGHTS}
SELECT event_id, 'bad altitude' AS reason FROM flights WHERE event_id % 97 = 0""",
        "running_count": counts,
        "running_count_stream": counts,
        "count_messages": hex_counts("flights-counts"),
        "feature_count_messages": hex_counts("flights-state"),
        "last_known_position": last,
        "last_known_position_stream": last,
        "update_trace": f"""WITH {_FLIGHTS}
SELECT concat('Update received for flightId=', flight_id, ', longitude=',
              CAST(longitude AS VARCHAR), ', latitude=', CAST(latitude AS VARCHAR), '!')
         AS trace
FROM flights""",
        "feature_schema": f"""WITH {_FLIGHTS}
SELECT flight_id AS "flightId", flight_time AS "flightTime", longitude, latitude,
       origin, destination, aircraft, altitude,
       longitude AS shape_x, latitude AS shape_y
FROM flights""",
        "feature_rename": f"""WITH {_FLIGHTS}
SELECT flight_id AS "trackId", flight_time AS "timestamp",
       longitude AS x, latitude AS y
FROM flights""",
        "project_points": f"""WITH {_FLIGHTS}
SELECT event_id, flight_id, {_MERCATOR} FROM flights""",
        "projected_null_geometry": f"""WITH {_FLIGHTS}
SELECT event_id, flight_id, CAST(NULL AS BIGINT) AS x_cm, CAST(NULL AS BIGINT) AS y_cm
FROM flights""",
        "wkb_roundtrip": f"""WITH {_FLIGHTS}
SELECT event_id, longitude AS lon, latitude AS lat FROM flights""",
        "track_lines_wkb": f"""WITH {_FLIGHTS}, {_first_arrived('track_day', 5)}
SELECT flight_id, concat('0102000000', printf('%02X000000', count(*)),
  string_agg(concat({_little_endian('longitude')}, {_little_endian('latitude')}), '' ORDER BY time)) AS wkb
FROM track GROUP BY 1""",
        "shapes_roundtrip": f"""WITH {_FLIGHTS},
box AS (
  SELECT flight_id, min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1
  FROM flights GROUP BY 1)
SELECT flight_id, 'polygon' AS kind, unnest([0, 1, 2, 3, 4])::BIGINT AS place,
       unnest([x0, x1, x1, x0, x0]) AS x, unnest([y0, y0, y1, y1, y0]) AS y
FROM box""",
        "track_state": entries(2),
        "track_state_stream": entries(2),
        "stored_tracks_stream": entries(3),
        "track_branches_stream": f"""WITH {_FLIGHTS}, {_first_arrived('track_day', 2)}
SELECT 'gateway' AS branch, flight_id, time, arrival_seq,
       CAST(round(longitude * 100) AS BIGINT) AS x_cm, CAST(round(latitude * 100) AS BIGINT) AS y_cm
FROM track
UNION ALL
SELECT 'projected' AS branch, flight_id, time, arrival_seq, {_MERCATOR} FROM track""",
        "track_commands_stream": f"""WITH {_FLIGHTS},
clears AS (
  SELECT flight_id, max(2 * arrival_seq + 1) AS at FROM flights WHERE event_id % 55 = 0 GROUP BY 1),
removals AS (
  SELECT flight_id, track_day, max(2 * arrival_seq + 1) AS at FROM flights
  WHERE event_id % 11 = 0 AND event_id % 55 <> 0 GROUP BY 1, 2)
SELECT f.flight_id, f.track_day, min(2 * f.arrival_seq) AS arrival_seq
FROM flights f LEFT JOIN clears c ON f.flight_id = c.flight_id
LEFT JOIN removals r ON f.flight_id = r.flight_id AND f.track_day = r.track_day
WHERE 2 * f.arrival_seq > coalesce(c.at, -1) AND 2 * f.arrival_seq > coalesce(r.at, -1)
GROUP BY 1, 2""",
        "track_probes_stream": _previous_sql(1, limit=2),
        "track_ends": f"""WITH {_FLIGHTS}, {_TRACK}
SELECT flight_id, max(time) AS latest_time,
       arg_max(arrival_seq, time) AS latest_arrival,
       min(time) AS oldest_time, arg_min(arrival_seq, time) AS oldest_arrival,
       count(*) AS entries
FROM track GROUP BY 1""",
        "track_latest": f"""WITH {_FLIGHTS}, {_LATEST}
SELECT flight_id, time, arrival_seq, longitude, latitude FROM latest""",
        "track_previous_1": _previous_sql(1),
        "track_previous_2": _previous_sql(2),
        "track_previous_2_reversed": _previous_sql(2, descending=True),
        "track_previous_absent": _previous_sql(1, "12 HOUR"),
        "track_next_1": _next_sql(1),
        "track_next_2": _next_sql(2),
        "track_next_2_reversed": _next_sql(2, descending=True),
        "track_next_absent": _next_sql(1, "12 HOUR"),
        "track_next_absent_strict": _next_sql(1, "12 HOUR", strict=True),
        "transformed_columns": moved,
        "transformed_records": moved,
        "projected_schema": f"""WITH {_FLIGHTS}
SELECT 3857 AS schema_wkid, 3857 AS wkid, flight_id, {_MERCATOR} FROM flights""",
        "wkb_bytes": f"""WITH {_FLIGHTS}
SELECT event_id, concat('0101000000', {_little_endian('longitude')}, {_little_endian('latitude')}) AS wkb
FROM flights""",
        "text_stream_count": counts,
        "restarted_count_stream": counts,
        "snapshot_branches": f"""WITH {_FLIGHTS}
SELECT branch, flight_id AS "trackId", CAST(max(flight_time) AS VARCHAR) AS "latestTime"
FROM flights CROSS JOIN (VALUES ('gateway'), ('projected')) AS b(branch) GROUP BY 1, 2""",
        "track_previous_saved": _previous_sql(2),
        "track_previous_bounded": _previous_sql(1, limit=2),
        "track_next_bounded": _next_sql(1, limit=2),
        "track_range": f"""WITH {_FLIGHTS}, {_TRACK}
SELECT flight_id, time, arrival_seq FROM track
WHERE time >= TIMESTAMP '{RANGE[0]}' AND time < TIMESTAMP '{RANGE[1]}'""",
        "track_contains": f"""WITH {_FLIGHTS}, {_TRACK}
SELECT f.event_id, f.flight_id, f.track_day AS probe_time,
       t.time IS NOT NULL AS contained
FROM flights f
LEFT JOIN track t ON f.flight_id = t.flight_id AND f.track_day = t.time""",
        "track_remove": f"""WITH {_FLIGHTS}, {_TRACK},
errors AS (
  SELECT DISTINCT flight_id, track_day AS time FROM flights WHERE origin = 'ERR')
SELECT t.flight_id, count(*) FILTER (WHERE e.time IS NULL) AS entries,
       max(t.time) FILTER (WHERE e.time IS NULL) AS latest_time
FROM track t LEFT JOIN errors e ON t.flight_id = e.flight_id AND t.time = e.time
GROUP BY 1""",
        "record_updates": f"""WITH {_FLIGHTS}
SELECT flight_id, arrival_seq, count(*) OVER w AS n,
       max(flight_time) OVER w AS latest_time,
       arg_max(longitude, flight_time) OVER w AS latest_longitude,
       arg_max(latitude, flight_time) OVER w AS latest_latitude
FROM flights
WINDOW w AS (PARTITION BY flight_id ORDER BY arrival_seq ROWS UNBOUNDED PRECEDING)""",
        "track_records_stream": f"""WITH {_FLIGHTS}
SELECT flight_id, count(*) AS records, count(DISTINCT flight_time) AS added,
       max(flight_time) AS newest
FROM flights GROUP BY 1""",
        "snapshot_raw": snapshot,
        "snapshot_projected": f"""WITH {_FLIGHTS}, {_LATEST}
SELECT flight_id AS "trackId", CAST(time AS VARCHAR) AS "latestTime", {_MERCATOR}
FROM latest""",
        "snapshot_stream": f"""WITH {_FLIGHTS}, {_first_arrived('flight_time', 1, 'latest')}
SELECT flight_id AS "trackId", CAST(time AS VARCHAR) AS "latestTime",
       concat('(', CAST(longitude AS VARCHAR), ', ', CAST(latitude AS VARCHAR), ', 0.0)')
         AS "latestPosition"
FROM latest""",
        "state_messages": f"""WITH {_FLIGHTS}, {_LATEST}
SELECT 'flights-state' AS topic, flight_id AS key,
       concat('Point(', CAST(longitude AS VARCHAR), ', ', CAST(latitude AS VARCHAR),
              ', 0.0)') AS value
FROM latest""",
        "replay_rows_stream": """SELECT event_id, user_id, event_type, value, true AS bounded
FROM events""",
        "replay_table": "SELECT * FROM events",
    } | _corpus_sql()
