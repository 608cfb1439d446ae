import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import FLIGHT_SCHEMA
from tests import samples
from tests.model import (
    SCHEMA,
    START,
    TrackModel,
    held_entries,
    random_reports,
    replayed,
)
from trackwake.functions import track_array
from trackwake.operators.aggregates import running_count
from trackwake.operators.position import last_known_position, latest_report
from trackwake.operators.schema import apply_feature_schema, with_track_id
from trackwake.operators.tracks import (
    track_contains,
    track_entries,
    track_next,
    track_previous,
    track_range,
    track_remove,
    track_state,
    track_table,
)

LIMITS = [0, 1, 2, 3, 5]


def _hour(n):
    return START + dt.timedelta(hours=n)


def _frame(spark, rows, partitions=7):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def _entries(df):
    return {(row.flight_id, row.time, row.arrival_seq) for row in df.collect()}


@pytest.fixture(scope="module")
def reports():
    return random_reports(seed=5, keys=60, most=40, times=30)


@pytest.fixture(scope="module")
def frame(spark, reports):
    return _frame(spark, reports).cache()


@pytest.mark.parametrize("limit", LIMITS)
def test_state_equals_one_by_one(frame, reports, limit):
    state = track_state(frame, max_features=limit)
    found = _entries(state)
    assert found == held_entries(replayed(reports, limit))
    assert len(found) == state.count()


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=25),
    st.sampled_from(LIMITS),
)
def test_largest_distinct_times_is_the_track(reports, limit):
    """The claim the table form rests on, against one-by-one adding."""
    track = TrackModel(limit)
    for arrival, (time, _) in enumerate(reports):
        track.add(time, arrival)
    first = {}
    for arrival, (time, _) in enumerate(reports):
        first.setdefault(time, arrival)
    newest = sorted(first)[-limit:] if limit else []
    assert track.held == {time: first[time] for time in newest}


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_state_with_hot_track_and_copies(spark, limit):
    hot = [("HOT", _hour(n % 700), n, 0.0) for n in range(3000)]
    copies = [("COPY", _hour(1), 10_000 + n, 0.0) for n in range(3000)]
    rows = hot + copies + random_reports(seed=9, keys=300, most=20, times=10)
    numbered = [(*row[:2], n, row[3]) for n, row in enumerate(rows)]
    found = _entries(track_state(_frame(spark, numbered, 16), max_features=limit))
    assert found == held_entries(replayed(numbered, limit))


def test_state_beyond_the_group_limit_of_the_optimizer(spark):
    rows = [("A", _hour(n), n, 0.0) for n in range(2500)]
    assert track_state(_frame(spark, rows), max_features=2000).count() == 2000


def test_state_with_several_arrival_columns(frame, reports):
    split = frame.withColumns(
        {"a": F.floor(F.col("arrival_seq") / 10), "b": F.col("arrival_seq") % 10}
    )
    state = track_state(split, arrival=["a", "b"], max_features=2)
    found = {(r.flight_id, r.time, r.a * 10 + r.b) for r in state.collect()}
    assert found == held_entries(replayed(reports, 2))


def test_report_without_time_stops_the_query(spark):
    df = spark.createDataFrame([("A", None, 1, 0.0)], SCHEMA)
    with pytest.raises(Exception, match="no time"):
        track_state(df).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert track_state(df).count() == 0
    assert track_table(df).count() == 0


def test_table_is_in_time_order(frame, reports):
    tracks = replayed(reports, 5)
    rows = track_table(frame, max_features=5, columns=["value"]).collect()
    assert {row.flight_id: [e.time for e in row.track] for row in rows} == {
        key: track.times() for key, track in tracks.items()
    }
    assert all(e.value == e.arrival_seq / 2 for row in rows for e in row.track)


def test_ends_and_size(frame, reports):
    tracks = replayed(reports, 3)
    track = F.col("track")
    rows = track_table(frame, max_features=3).select(
        "flight_id",
        track_array.latest(track)["time"].alias("latest"),
        track_array.oldest(track)["time"].alias("oldest"),
        track_array.size(track).alias("size"),
        track_array.is_empty(track).alias("empty"),
        track_array.is_empty(track_array.clear(track)).alias("cleared"),
        track_array.latest(track_array.clear(track)).alias("none"),
    )
    for row in rows.collect():
        times = tracks[row.flight_id].times()
        assert (row.latest, row.oldest, row.size) == (times[-1], times[0], len(times))
        assert not row.empty and row.cleared and row.none is None


@pytest.fixture(scope="module")
def probes(spark, reports):
    """Times held and not held, and one key without a track."""
    keys = sorted({row[0] for row in reports}) + ["NOBODY"]
    rows = [
        (key, START + dt.timedelta(minutes=30 * n)) for key in keys for n in range(-2, 64)
    ]
    return spark.createDataFrame(rows, "flight_id string, at timestamp_ntz").cache()


@pytest.mark.parametrize("n", [-1, 0, 1, 2, 5])
@pytest.mark.parametrize("descending", [False, True])
def test_previous_and_next(frame, reports, probes, n, descending):
    tracks = replayed(reports, 5)
    table = track_table(frame, max_features=5)
    empty = TrackModel(5)
    previous = track_previous(probes, table, "at", n, descending=descending)
    for row in previous.collect():
        expected = tracks.get(row.flight_id, empty).previous(row.at, n, descending)
        assert [e.time for e in row.previous] == expected
    following = track_next(probes, table, "at", n, descending=descending)
    for row in following.collect():
        expected = tracks.get(row.flight_id, empty).next(row.at, n, descending)
        assert [e.time for e in row.next] == expected


def test_strict_successor(frame, reports, probes):
    tracks = replayed(reports, 5)
    table = track_table(frame, max_features=5)
    found = track_next(probes, table, "at", 2, strict_successor=True)
    for row in found.where("flight_id <> 'NOBODY'").collect():
        later = [t for t in tracks[row.flight_id].times() if t > row.at]
        assert [e.time for e in row.next] == (later[:2] if len(later) >= 2 else [])


def test_contains_range_remove(frame, reports, probes):
    tracks = replayed(reports, 5)
    table = track_table(frame, max_features=5)
    for row in track_contains(probes, table, "at").collect():
        held = tracks[row.flight_id].times() if row.flight_id in tracks else []
        assert row.contained == (row.at in held)
    start, end = _hour(10), _hour(27)
    cut = track_entries(track_range(table, F.lit(start), F.lit(end)))
    assert _entries(cut) == {
        entry for entry in held_entries(tracks) if start <= entry[1] < end
    }
    gone = probes.where("minute(at) = 0 and hour(at) % 2 = 0")
    left = track_remove(table, gone.union(gone), "at")
    removed = {(row.flight_id, row.at) for row in gone.collect()}
    assert _entries(track_entries(left)) == {
        entry for entry in held_entries(tracks) if entry[:2] not in removed
    }
    everything = track_remove(table, track_entries(table), "time")
    assert {(row.flight_id, len(row.track)) for row in everything.collect()} == {
        (key, 0) for key in tracks
    }
    by_array = table.select(
        "flight_id", track_array.remove(F.col("track"), F.lit(_hour(12))).alias("track")
    )
    assert _entries(track_entries(by_array)) == {
        entry for entry in held_entries(tracks) if entry[1] != _hour(12)
    }


@pytest.mark.parametrize("limit", LIMITS)
def test_add_to_an_array(spark, limit):
    """Ten adds in one expression chain, against one-by-one adding."""
    cases = [
        [4, 2, 9, 4, 1, 7, 2, 8, 3, 9],
        [1, 2, 3, 4, 5, 6, 7, 8, 9, 10],
        [5, 5, 5, 4, 4, 3, 2, 1, 0, 0],
    ]
    df = spark.createDataFrame([(case,) for case in cases], "times array<bigint>")
    entry = lambda n: F.struct(F.col("times")[n].alias("time"), F.lit(n).alias("at"))
    track = F.array().cast("array<struct<time: bigint, at: int>>")
    for n in range(10):
        df = df.withColumn("track", track if n == 0 else F.col("track"))
        df = df.withColumn("track", track_array.add(F.col("track"), entry(n), limit))
    for row in df.collect():
        model = TrackModel(limit)
        for n, time in enumerate(row.times):
            model.add(time, n)
        assert [(e.time, e.at) for e in row.track] == sorted(model.held.items())


def test_positions(frame, reports):
    last = {}
    best = {}
    for key, time, arrival, value in reports:
        last[key] = max(last.get(key, (-1, None)), (arrival, value))
        report = (time, -arrival, value)
        best[key] = max(best.get(key, report), report)
    rows = last_known_position(frame, columns=["value"]).collect()
    assert {r.flight_id: r.value for r in rows} == {k: v[1] for k, v in last.items()}
    rows = latest_report(frame, "flight_id", "time", "arrival_seq", ["value"]).collect()
    assert {r.flight_id: (r.time, r.value) for r in rows} == {
        k: (v[0], v[2]) for k, v in best.items()
    }


def test_last_arrival_with_several_columns(spark):
    rows = [("A", 1, 5, 1.0), ("A", 2, 0, 2.0), ("A", 1, 9, 3.0)]
    df = spark.createDataFrame(rows, "flight_id string, p int, o int, value double")
    found = last_known_position(df, arrival=["p", "o"], columns=["value"])
    assert found.first().value == 2.0


def test_samples(spark):
    typed = with_track_id(
        apply_feature_schema(samples.features(spark), FLIGHT_SCHEMA, ("arrival",))
    )
    counts = {r.trackId: r.n for r in running_count(typed, "trackId").collect()}
    assert counts.pop("SWA2706") == 2 and set(counts.values()) == {1} and len(counts) == 8
    table = track_table(typed, "trackId", "time", "arrival", 2, ["Geometry"])
    assert table.count() == 9
    two = table.where("trackId = 'SWA2706'")
    at = lambda ms: F.lit(samples.EPOCH + dt.timedelta(milliseconds=ms)).cast("timestamp")
    arrivals = lambda found: [e.arrival for e in two.select(found).first()[0]]
    track = F.col("track")
    assert arrivals(track) == [1, 10]
    assert arrivals(track_array.previous(track, at(10))) == [1]
    assert arrivals(track_array.previous(track, at(1))) == []
    assert arrivals(track_array.next_entries(track, at(1))) == [10]
    assert arrivals(track_array.next_entries(track, at(10))) == []
