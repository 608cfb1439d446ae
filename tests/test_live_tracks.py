"""Live tracks: records one by one, expiry, commands, probes and branches."""

import os
import random
import shutil
import time as clock
from glob import glob

import pytest
from pyspark.sql import functions as F

from tests.model import SCHEMA, TrackModel, held_entries, random_reports, replayed
from tests.test_streaming import write_splits
from trackwake.functions import track_array
from trackwake.operators.records import record_tracks
from trackwake.operators.tracks import (
    track_contains,
    track_next,
    track_previous,
    track_table,
)
from trackwake.sources.replay import replay_table
from trackwake.streaming.live import probe_sink, record_sink
from trackwake.streaming.sinks import latest_batches, run_available, table_sink
from trackwake.streaming.state import rocksdb_state
from trackwake.streaming.tracks import (
    reduce_batches,
    stored_tracks,
    stream_commanded_tracks,
    stream_track_branches,
    stream_track_state,
)

pytestmark = pytest.mark.filterwarnings("ignore")


@pytest.fixture(scope="module")
def reports():
    return random_reports(seed=21, keys=20, most=30, times=14)


def outcomes(reports, limit):
    """(key, arrival) to (n, added, latest time, latest value), one by one."""
    found, tracks, counts = {}, {}, {}
    for key, time, arrival, value in sorted(reports, key=lambda row: row[2]):
        track = tracks.setdefault(key, TrackModel(limit))
        counts[key] = counts.get(key, 0) + 1
        added = track.add(time, value)
        newest = max(track.held, default=None)
        found[key, arrival] = (counts[key], added, newest, track.held.get(newest))
    return found


def shown(frame):
    rows = frame.collect()
    found = {(r.flight_id, r.arrival_seq): (r.n, r.added, r.latest_time, r.latest_value) for r in rows}
    assert len(found) == len(rows)
    return found


# -- one output per record ------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_records_of_a_table(spark, reports, limit):
    frame = spark.createDataFrame(reports, SCHEMA).repartition(5)
    got = record_tracks(frame, max_features=limit, columns=["value"])
    assert shown(got) == outcomes(reports, limit)


def hot_reports(seed, n=900):
    draw = random.Random(seed)
    base = random_reports(seed=seed, keys=4, most=10, times=12)
    times = sorted({row[1] for row in base})
    rows = [("hot", draw.choice(times), 10_000 + k, float(k)) for k in range(n)]
    return base + rows


@pytest.mark.parametrize("limit", [0, 2])
def test_hot_keys_are_cut_into_ranges(spark, limit):
    rows = hot_reports(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = record_tracks(frame, max_features=limit, columns=["value"])
    assert "__cuts" in got._jdf.queryExecution().optimizedPlan().toString()
    assert shown(got) == outcomes(rows, limit)


@pytest.mark.parametrize("splits,limit", [(3, 2), (2, 0)])
def test_records_of_a_stream(spark, reports, tmp_path, splits, limit):
    folder = write_splits(spark, reports, SCHEMA, str(tmp_path / "in"), splits, 2)
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")
    sink = record_sink(
        replay_table(spark, folder), "records", state, rows, max_features=limit, columns=["value"], once=True
    )
    query = run_available(spark, sink)
    assert query.lastProgress["batchId"] == splits - 1
    assert shown(spark.read.parquet(rows)) == outcomes(reports, limit)


def test_hot_records_of_a_stream(spark, tmp_path):
    rows = hot_reports(4)
    folder = write_splits(spark, rows, SCHEMA, str(tmp_path / "in"), 3, 2)
    out = str(tmp_path / "rows")
    sink = record_sink(
        replay_table(spark, folder), "hot", str(tmp_path / "state"), out, max_features=2, columns=["value"], once=True
    )
    run_available(spark, sink)
    assert shown(spark.read.parquet(out)) == outcomes(rows, 2)


def test_records_with_nothing_to_show(spark, tmp_path):
    rows = [("A", None, 1, 0.0)]
    folder = write_splits(spark, rows, SCHEMA, str(tmp_path / "in"), 1, 2)
    sink = record_sink(replay_table(spark, folder), "none", str(tmp_path / "s"), str(tmp_path / "r"), once=True)
    with pytest.raises(Exception, match="no time"):
        run_available(spark, sink)
    frame = spark.createDataFrame([], SCHEMA)
    assert record_tracks(frame, columns=["value"]).collect() == []


def test_a_million_records_of_one_key_in_one_trigger(spark, tmp_path):
    source = spark.range(1_000_000).select(
        F.lit("one").alias("flight_id"),
        F.timestamp_micros(F.xxhash64("id") % 10**15).alias("time"),
        F.col("id").alias("arrival_seq"),
        F.col("id").cast("double").alias("value"),
    )
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = str(tmp_path / "rows")
    stream = replay_table(spark, str(tmp_path / "in"))
    run_available(spark, record_sink(stream, "million", str(tmp_path / "s"), rows, once=True))
    got = spark.read.parquet(rows)
    assert got.agg(F.count("*"), F.max("n"), F.sum(F.col("added").cast("int"))).first() == (
        1_000_000, 1_000_000, source.select("time").distinct().count(),
    )
    last = got.where("n = 1000000").first().latest_time
    assert last == source.agg(F.max("time")).first()[0]


# -- thinning ------------------------------------------------------------------------------


def test_thinning_is_bounded_and_loses_nothing(spark, monkeypatch):
    import trackwake.streaming.tracks as module

    rows = random_reports(seed=8, keys=40, most=60, times=20)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    expected = held_entries(replayed(rows, 2))
    for held in (10, 100_000):
        monkeypatch.setattr(module, "HELD_ROWS", held)
        thinned = reduce_batches(frame, "flight_id", "time", "arrival_seq", 2)
        left = [tuple(r) for r in thinned.collect()]
        assert len(left) < len(rows) and held_entries(replayed(left, 2)) == expected


# -- expiry -----------------------------------------------------------------------------------


def test_an_idle_track_leaves_the_snapshot(spark, reports, tmp_path):
    folder = write_splits(spark, reports, SCHEMA, str(tmp_path / "in"), 1, 2)
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")
    keys = {row[0] for row in reports}
    stays = sorted(keys)[0]
    newest = max(row[1] for row in reports)
    turns = iter(range(100))

    def report():
        """One more report of the track that stays."""
        turn = next(turns)
        extra = write_splits(spark, [(stays, newest, 20_000 + turn, 0.0)], SCHEMA, str(tmp_path / f"more{turn}"), 1, 2)
        shutil.copy(f"{extra}/000.parquet", f"{folder}/9{turn:02}.parquet")

    def gone():
        if not glob(f"{rows}/batch_id=*/_SUCCESS"):
            return set()
        return {r.flight_id for r in spark.read.parquet(rows).where("gone").collect()}

    tracks = stream_track_state(
        replay_table(spark, folder), max_features=2, columns=["value"], idle_expiry_ms=15_000
    )
    # The triggers after the first, which may take long, have a report of it too.
    report()
    report()
    with rocksdb_state(spark):
        query = table_sink(tracks, "idle", state, rows).start()
    try:
        deadline = clock.time() + 200
        while len(gone()) < len(keys) - 1:
            assert clock.time() < deadline and query.exception() is None
            report()
            clock.sleep(0.5)
    finally:
        query.stop()
    found = spark.read.parquet(rows)
    assert gone() == keys - {stays}
    assert all(r.time is None and r.value is None for r in found.where("gone").collect())
    left = latest_batches(spark, rows, "flight_id").where("not gone")
    assert {r.flight_id for r in left.select("flight_id").distinct().collect()} == {stays}
    assert {r.flight_id for r in stored_tracks(spark, state).collect()} == {stays}


# -- commands ------------------------------------------------------------------------------------

COMMANDS = "flight_id string, time timestamp_ntz, arrival_seq bigint, action string"


def commanded(reports, commands, limit, splits):
    tracks = {}
    for row in sorted([*reports, *commands], key=lambda r: r[2]):
        track = tracks.setdefault(row[0], TrackModel(limit))
        if row[3] == "remove":
            track.held.pop(row[1], None)
        elif row[3] == "clear":
            track.held.clear()
        else:
            track.add(row[1], row[2])
    return {(k, t, a) for k, track in tracks.items() for t, a in track.held.items()}


@pytest.mark.parametrize("splits", [3])
def test_commands_on_live_tracks(spark, reports, tmp_path, splits):
    draw = random.Random(5)
    spread = [(k, t, 10 * a, v) for k, t, a, v in reports]
    keys, times = sorted({r[0] for r in reports}), sorted({r[1] for r in reports})
    last = max(r[2] for r in spread)
    places = iter(draw.sample(range(5, last, 10), 60))
    commands = [(draw.choice(keys), draw.choice(times), next(places), "remove") for _ in range(45)]
    commands += [(draw.choice(keys), None, next(places), "clear") for _ in range(15)]
    commands += [(keys[0], None, last + 5, "clear"), ("unknown", times[0], last + 6, "remove")]
    size = -(-len(spread) // splits)
    ordered = sorted(spread, key=lambda r: r[2])
    folder = write_splits(spark, ordered, SCHEMA, str(tmp_path / "in"), splits, 2)
    # Commands come with the trigger of the reports that arrived around them.
    bounds = [ordered[min(n * size, len(ordered)) - 1][2] for n in range(1, splits + 1)]
    parts = [[c for c in commands if (c[2] <= b or n == splits - 1) and (n == 0 or c[2] > bounds[n - 1])] for n, b in enumerate(bounds)]
    told = tmp_path / "commands"
    told.mkdir()
    for n, part in enumerate(parts):
        staged = write_splits(spark, part or [("nobody", None, -1, "clear")], COMMANDS, f"{told}-{n}", 1, 2)
        shutil.copy(f"{staged}/000.parquet", told / f"{n:03}.parquet")
        os.utime(told / f"{n:03}.parquet", (1_700_000_000 + 10 * n,) * 2)
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")
    tracks = stream_commanded_tracks(
        replay_table(spark, folder), replay_table(spark, str(told)), max_features=3, columns=["value"]
    )
    run_available(spark, table_sink(tracks, "told", state, rows, once=True))
    held = stored_tracks(spark, state).select("flight_id", "time", "arrival_seq")
    assert {tuple(r) for r in held.collect()} == commanded(spread, commands, 3, splits)


def test_unknown_commands_stop_the_query(spark, reports, tmp_path):
    folder = write_splits(spark, reports, SCHEMA, str(tmp_path / "in"), 1, 2)
    for n, action in enumerate(("erase", None)):
        told = write_splits(spark, [("x", None, 1, action)], COMMANDS, str(tmp_path / f"c{n}"), 1, 2)
        tracks = stream_commanded_tracks(replay_table(spark, folder), replay_table(spark, told))
        with pytest.raises(Exception, match="unknown track command"):
            run_available(spark, table_sink(tracks, f"bad{n}", str(tmp_path / f"s{n}"), str(tmp_path / f"r{n}"), once=True))


# -- probes ------------------------------------------------------------------------------------------

PROBES = "flight_id string, probe_time timestamp_ntz, probe_id bigint"


def answered(rows):
    at = F.col("probe_time")
    return rows.select(
        "probe_id",
        "flight_id",
        "probe_time",
        track_array.previous(F.col("track"), at, 2).alias("previous"),
        track_array.next_entries(F.col("track"), at, 1).alias("next"),
        track_array.contains(F.col("track"), at).alias("contained"),
    )


def test_probes_of_live_tracks_equal_the_table_form(spark, reports, tmp_path):
    draw = random.Random(6)
    keys, times = sorted({r[0] for r in reports}), sorted({r[1] for r in reports})
    asked = [(draw.choice([*keys, "unknown"]), draw.choice(times), n) for n in range(120)]
    asked += [(None, times[0], 120), (keys[0], None, 121)]
    splits = 3
    folder = write_splits(spark, reports, SCHEMA, str(tmp_path / "in"), splits, 2)
    probing = write_splits(spark, asked, PROBES, str(tmp_path / "probes"), splits, 2)
    out = str(tmp_path / "rows")
    sink = probe_sink(
        replay_table(spark, folder),
        replay_table(spark, probing),
        answered,
        "probes",
        str(tmp_path / "state"),
        out,
        max_features=4,
        columns=["value"],
        once=True,
    )
    query = run_available(spark, sink)
    assert query.lastProgress["batchId"] == splits - 1
    ordered = sorted(reports, key=lambda r: r[2])
    size = -(-len(ordered) // splits)
    for n in range(splits):
        seen = spark.createDataFrame(ordered[: (n + 1) * size], SCHEMA)
        probes = spark.read.parquet(f"{probing}/{n:03}.parquet")
        tracks = track_table(seen, max_features=4, columns=["value"])
        expected = track_previous(probes, tracks, "probe_time", 2)
        expected = {r.probe_id: r.previous for r in expected.collect()}
        got = {r.probe_id: r for r in spark.read.parquet(f"{out}/batch_id={n}").collect()}
        assert len(got) == probes.count()
        assert {k: r.previous for k, r in got.items()} == expected
        later = {r.probe_id: r.next for r in track_next(probes, tracks, "probe_time", 1).collect()}
        assert {k: r.next for k, r in got.items()} == later
        held = {r.probe_id: r.contained for r in track_contains(probes, tracks, "probe_time").collect()}
        assert {k: bool(r.contained) for k, r in got.items()} == {k: bool(v) for k, v in held.items()}


# -- branches -------------------------------------------------------------------------------------------


def test_two_branches_of_one_read(spark, reports, tmp_path):
    folder = write_splits(spark, reports, SCHEMA, str(tmp_path / "in"), 3, 2)
    stream = replay_table(spark, folder).withColumn("moved", F.col("value") * 2)
    rows, state = str(tmp_path / "rows"), str(tmp_path / "state")
    tracks = stream_track_branches(
        stream, {"raw": {"shown": "value"}, "projected": {"shown": "moved"}}, max_features=3
    )
    query = run_available(spark, table_sink(tracks, "branches", state, rows, once=True))
    assert len(query.lastProgress["sources"]) == 1
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(reports)
    values = {r[2]: r[3] for r in reports}
    for name, factor in (("raw", 1), ("projected", 2)):
        held = stored_tracks(spark, state, name=name).collect()
        assert {(r.flight_id, r.time, r.arrival_seq) for r in held} == held_entries(replayed(reports, 3))
        assert all(r.shown == factor * values[r.arrival_seq] for r in held)
        last = latest_batches(spark, rows, "flight_id").where(F.col("branch") == name)
        assert {tuple(r) for r in last.select("flight_id", "time", "arrival_seq", "shown").collect()} == {
            (r.flight_id, r.time, r.arrival_seq, r.shown) for r in held
        }


def test_branches_must_be_alike(spark, reports, tmp_path):
    frame = spark.createDataFrame(reports, SCHEMA)
    with pytest.raises(ValueError):
        stream_track_branches(frame, {"a": {"x": "value"}, "b": {"y": "value"}})
