"""Tables replayed with a bound on the rows of a trigger."""

import time as clock

import pytest
from pyspark.sql import functions as F

from trackwake.plans.event_flights import events_path
from trackwake.sources.replay import replay_rows, stage_rows
from trackwake.streaming.sinks import run_available, table_sink

MANY = events_path("/root/testdata/sf0.1")


def test_one_file_in_several_triggers(spark, tmp_path):
    staged, rows = str(tmp_path / "staged"), str(tmp_path / "rows")
    table = spark.read.parquet(MANY)
    assert len(table.inputFiles()) == 1 and table.count() == 100_000
    stage_rows(table, staged, 30_000)
    sink = table_sink(replay_rows(spark, staged), "r", str(tmp_path / "c"), rows, mode="append", once=True)
    run_available(spark, sink)
    found = spark.read.parquet(rows)
    sizes = [r["count"] for r in found.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sorted(sizes) == [10_000, 30_000, 30_000, 30_000]
    assert found.select("event_id").distinct().count() == found.count() == 100_000


def test_each_row_once_over_a_restart(spark, tmp_path):
    staged, rows, state = (str(tmp_path / n) for n in ("staged", "rows", "state"))
    stage_rows(spark.read.parquet(MANY), staged, 9_000)

    def sink(once):
        stream = replay_rows(spark, staged)
        return table_sink(stream, "again", state, rows, mode="append", interval=None, once=once)

    query = sink(False).start()
    try:
        deadline = clock.time() + 120
        while len(query.recentProgress) < 3:
            assert clock.time() < deadline and query.exception() is None
            clock.sleep(0.05)
    finally:
        query.stop()
    assert run_available(spark, sink(True)).exception() is None
    run_available(spark, sink(True))
    found = spark.read.parquet(rows)
    assert found.select("event_id").distinct().count() == found.count() == 100_000
    most = found.groupBy("batch_id").count().agg(F.max("count")).first()[0]
    assert most <= 9_000


def test_odd_stages(spark, tmp_path):
    table = spark.read.parquet(MANY).limit(5)
    with pytest.raises(ValueError):
        stage_rows(table, str(tmp_path / "none"), 0)
    stage_rows(table, str(tmp_path / "once"), 2)
    with pytest.raises(Exception, match="already exists"):
        stage_rows(table, str(tmp_path / "once"), 2)
    stage_rows(table.limit(0), str(tmp_path / "empty"), 2)
    rows = str(tmp_path / "rows")
    stream = replay_rows(spark, str(tmp_path / "empty"))
    run_available(spark, table_sink(stream, "e", str(tmp_path / "c"), rows, mode="append", once=True))
