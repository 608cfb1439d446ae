from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackwake.operators import history as h

START = datetime(2024, 1, 1)


def reports(seed: int, n: int = 400) -> list[tuple]:
    draw = random.Random(seed)
    return [
        (draw.choice(["hot"] * 6 + ["a", "b", None]), START + timedelta(hours=draw.randrange(120)), i, float(i))
        for i in range(n)
    ]


def held(rows) -> dict:
    first: dict = {}
    for key, time, seq, value in sorted(rows, key=lambda r: r[2]):
        if key is not None:
            first.setdefault(key, {}).setdefault(time, (time, value))
    return first


@pytest.fixture(params=[4, 40])
def frames(spark, request):
    """With 40 shuffle partitions the hot key is cut into many ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    rows = reports(request.param)
    draw = random.Random(8)
    probes = [
        (i, draw.choice(["hot"] * 5 + ["a", "b", "none", None]), START + timedelta(minutes=30 * draw.randrange(-20, 280)))
        for i in range(250)
    ] + [(900, "hot", None), (901, None, None), (902, "a", START - timedelta(days=9))]
    schema = "flight_id string, time timestamp_ntz, arrival_seq long, value double"
    table = spark.createDataFrame(rows, schema).repartition(3)
    asked = spark.createDataFrame(probes, "id long, flight_id string, probe_time timestamp_ntz")
    yield rows, probes, h.track_history(table, columns=["value"]), asked.repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def entries(rows) -> dict:
    return {r.id: [(e.time, e.value) for e in r.found] for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
@pytest.mark.parametrize("descending", [False, True])
def test_previous(frames, n, descending):
    rows, probes, history, asked = frames
    got = h.history_previous(
        asked, history, "probe_time", n, columns=["value"], descending=descending, out="found"
    )
    expected = {}
    for id, key, time in probes:
        before = sorted(e for t, e in held(rows).get(key, {}).items() if time and t < time)
        near = before[-n:] if 0 < n <= len(before) else []
        expected[id] = near[::-1] if descending else near
    assert entries(got.collect()) == expected


@pytest.mark.parametrize("n", [0, 1, 3])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_next(frames, n, strict, descending):
    rows, probes, history, asked = frames
    got = h.history_next(
        asked, history, "probe_time", n, columns=["value"], descending=descending,
        strict_successor=strict, out="found",
    )
    expected = {}
    for id, key, time in probes:
        after = sorted(
            e for t, e in held(rows).get(key, {}).items() if time and (t > time or not strict and t == time)
        )
        after = after if strict else after[1:]
        near = after[:n] if n <= len(after) else []
        expected[id] = near[::-1] if descending else near
    assert entries(got.collect()) == expected


def test_contains_and_remove(frames):
    rows, probes, history, asked = frames
    got = {r.id: r.contained for r in h.history_contains(asked, history, "probe_time").collect()}
    assert got == {id: time in held(rows).get(key, {}) for id, key, time in probes}
    listed = {(key, time) for _, key, time in probes}
    marked = h.history_remove(history, asked.union(asked), "probe_time").collect()
    assert {(r.flight_id, r.time): r.removed for r in marked if r.flight_id} == {
        (k, t): (k, t) in listed for k, times in held(rows).items() for t in times
    }


def test_range_and_ends(frames):
    rows, _, history, _ = frames
    low, high = START + timedelta(hours=10), START + timedelta(hours=50)
    cut = h.history_range(history, F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
    assert {(r.flight_id, r.time) for r in cut.collect() if r.flight_id} == {
        (k, t) for k, times in held(rows).items() for t in times if low <= t < high
    }
    ends = {r.flight_id: (r.latest_time, r.oldest_value, r.entries) for r in h.history_ends(history, columns=["value"]).collect()}
    for key, times in held(rows).items():
        assert ends[key] == (max(times), times[min(times)][1], len(times))


def test_a_report_without_time_stops(spark):
    frame = spark.createDataFrame([("a", None, 1)], "flight_id string, time timestamp_ntz, arrival_seq long")
    with pytest.raises(Exception, match="no time"):
        h.track_history(frame).collect()


def test_no_sort_in_the_first_arrivals(frames):
    _, _, history, _ = frames
    assert "SortAggregate" not in history._jdf.queryExecution().toString()


@pytest.fixture
def warehouse(spark):
    yield "saved_reports"
    for name in ("saved_reports", "saved_reports_cuts"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.mark.parametrize("n", [2])
def test_saved_history_gives_the_same(spark, frames, warehouse, tmp_path, n):
    _, _, history, asked = frames
    h.save_history(history, warehouse, str(tmp_path), buckets=6)
    saved = h.saved_history(spark, warehouse)
    assert saved.buckets == 6
    for lookup in (h.history_previous, h.history_next):
        got = lookup(asked, saved, "probe_time", n, columns=["value"], out="found")
        expected = lookup(asked, history, "probe_time", n, columns=["value"], out="found")
        assert entries(got.collect()) == entries(expected.collect())


def test_saved_history_is_not_shuffled(spark, frames, warehouse, tmp_path):
    _, _, history, asked = frames
    h.save_history(history, warehouse, str(tmp_path), buckets=6)
    saved = h.saved_history(spark, warehouse)
    found = h.history_previous(asked, saved, "probe_time", 2, columns=["value"], out="found")
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [k for k, line in enumerate(plan) if "saved_reports[" in line and "Bucketed: true" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))

    def above(k):
        """The operators from a scan to the top of the plan."""
        at = depth(plan[k])
        for line in reversed(plan[:k]):
            if depth(line) < at:
                at = depth(line)
                yield line.strip(" :+-")

    # The entries stay in their buckets up to the result; what ranges hand on is small.
    paths = [[line.split()[0].split("(")[0] for line in above(k)] for k in scans]
    assert [p for p in paths if "Exchange" not in p and p.count("Window") == 2]
    for names in paths:
        assert "Exchange" not in names or names.index("SortAggregate") < names.index("Exchange")
