"""Current rows read from the state of running and stopped queries."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import FLIGHT_SCHEMA, _features
from tests.test_streaming import write_splits
from trackwake.operators.aggregates import running_count
from trackwake.operators.position import last_known_position, latest_report
from trackwake.plans import programs
from trackwake.plans.event_flights import flights
from trackwake.sources.replay import replay_table
from trackwake.streaming.sinks import last_snapshot, run_available, view_sink
from trackwake.streaming.state import start
from trackwake.streaming.stored import (
    state_sink,
    stored_counts,
    stored_latest,
    stored_positions,
)

SCHEMA = "k string, t bigint, v bigint, g struct<x: double, y: double>, s bigint, p int, o bigint"
ROWS = [
    ("a", 5, 1, (1.0, 2.0), 0, 0, 0),
    ("b", 7, 2, None, 1, 0, 1),
    ("a", 9, 3, (3.0, None), 2, 1, 2),
    (None, 1, 4, (5.0, 6.0), 3, 0, 3),
    ("a", 9, 5, (7.0, 8.0), 4, 0, 4),
    ("c", 2, None, None, 5, 1, 5),
    ("a", 3, 6, (9.0, 9.0), 6, 0, 6),
]


@pytest.fixture
def folder(spark, tmp_path):
    return write_splits(spark, ROWS, SCHEMA, str(tmp_path / "in"), 4, 4)


def stream(spark, folder):
    return replay_table(spark, folder).withColumn("t", F.timestamp_millis("t"))


def table(spark, folder):
    return spark.read.parquet(folder).withColumn("t", F.timestamp_millis("t"))


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


def test_counts_of_all_keys(spark, folder, tmp_path):
    state = str(tmp_path / "state")
    run_available(spark, state_sink(running_count(stream(spark, folder), "k"), "c", state, once=True))
    got = {r.k: r.n for r in stored_counts(spark, state, "k").collect()}
    assert got == {"a": 4, "b": 1, "c": 1, None: 1}


@pytest.mark.parametrize("arrival", ["s", ("t", "p", "o")])
def test_positions_with_structs(spark, folder, tmp_path, arrival):
    state = str(tmp_path / "state")
    last = last_known_position(stream(spark, folder), "k", arrival, ["g", "v"])
    run_available(spark, state_sink(last, "p", state, once=True))
    expected = last_known_position(table(spark, folder), "k", arrival, ["g", "v"])
    got = stored_positions(spark, state, last.schema)
    assert got.columns == expected.columns and rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("arrival", ["s", ("t", "p", "o")])
def test_latest_with_structs(spark, folder, tmp_path, arrival):
    state = str(tmp_path / "state")
    latest = latest_report(stream(spark, folder), "k", "t", arrival, ["v", "g"])
    run_available(spark, state_sink(latest, "l", state, once=True))
    expected = latest_report(table(spark, folder), "k", "t", arrival, ["v", "g"])
    got = stored_latest(spark, state, latest.schema)
    assert rows_of(got) == rows_of(expected)


def test_state_is_read_while_the_query_runs(spark, folder, tmp_path):
    """Each finished trigger is seen, with keys that it did not touch."""
    state, live = str(tmp_path / "state"), str(tmp_path / "live")
    os.makedirs(live)
    files = sorted(os.listdir(folder))
    shutil.copy(f"{folder}/{files[0]}", f"{live}/{files[0]}")
    query = start(spark, state_sink(running_count(stream(spark, live), "k"), "r", state, interval=None))
    try:
        seen = []
        for name in files:
            shutil.copy(f"{folder}/{name}", f"{live}/{name}")
            query.processAllAvailable()
            seen.append({r.k: r.n for r in stored_counts(spark, state, "k").collect()})
    finally:
        query.stop()
    assert seen == [
        {"a": 1, "b": 1},
        {"a": 2, "b": 1, None: 1},
        {"a": 3, "b": 1, None: 1, "c": 1},
        {"a": 4, "b": 1, None: 1, "c": 1},
    ]


@pytest.mark.parametrize("project", [False, True])
def test_kept_snapshot_and_its_view(spark, tmp_path, project):
    source = _features(flights(spark, "/root/testdata/sf0.001").limit(300))
    source.write.parquet(str(tmp_path / "features"))
    features = replay_table(spark, str(tmp_path / "features"))
    state = str(tmp_path / "state")
    query = programs.start_track_keeper(features, FLIGHT_SCHEMA, state, "arrival_seq", project)
    query.processAllAvailable()
    query.stop()
    programs.kept_snapshot(spark, state, FLIGHT_SCHEMA, view="kept")
    expected = programs.track_snapshot(
        spark.read.parquet(str(tmp_path / "features")), FLIGHT_SCHEMA, "arrival_seq", project
    )
    assert rows_of(spark.sql("select * from kept")) == rows_of(expected)


def test_few_snapshots_are_kept(spark, folder, tmp_path):
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")
    counts = running_count(stream(spark, folder), "k")
    sink = view_sink(counts, "v", state, "counts", "select * from counts", rows, once=True, keep=2)
    query = run_available(spark, sink)
    assert query.lastProgress["batchId"] == 3
    assert sorted(n for n in os.listdir(rows) if n.startswith("turn")) == ["turn=0", "turn=1"]
    assert {r.k: r.n for r in last_snapshot(spark, rows).collect()} == {"a": 4, "b": 1, "c": 1, None: 1}
