"""Started jobs over replayed tables: all of them but the topic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import FLIGHT_SCHEMA, _features
from trackwake.operators.ingest import flight_lines
from trackwake.plans import programs
from trackwake.plans.event_flights import flights
from trackwake.sources.replay import replay_table, text_stream
from trackwake.streaming.sinks import run_available, table_sink
from trackwake.streaming.state import start

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def lines(spark, tmp_path):
    source = flights(spark, FOLDER).limit(200)
    flight_lines(source, keep=("arrival_seq",)).write.parquet(str(tmp_path / "lines"))
    return replay_table(spark, str(tmp_path / "lines"))


@pytest.fixture
def features(spark, tmp_path):
    _features(flights(spark, FOLDER).limit(200)).write.parquet(str(tmp_path / "features"))
    return replay_table(spark, str(tmp_path / "features"))


def finish(query):
    query.processAllAvailable()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert progress
    metrics = progress[-1]["stateOperators"][0]["customMetrics"]
    assert any(name.lower().startswith("rocksdb") for name in metrics)


def sink_to(path):
    return lambda rows, name, checkpoint: table_sink(rows, name, checkpoint, path, interval=None)


def test_flight_counter(spark, lines, tmp_path):
    rows = str(tmp_path / "rows")
    finish(programs.start_flight_counter(lines, "t", str(tmp_path / "c"), sink_to(rows)))
    found = spark.read.parquet(rows)
    assert {r.topic for r in found.collect()} == {"t-counts"}


def test_feature_counter_and_publisher(spark, features, tmp_path):
    rows = str(tmp_path / "counts")
    finish(
        programs.start_feature_counter(features, FLIGHT_SCHEMA, "t", str(tmp_path / "a"), sink_to(rows))
    )
    assert spark.read.parquet(rows).count() > 0
    rows = str(tmp_path / "states")
    finish(
        programs.start_track_publisher(
            features, FLIGHT_SCHEMA, "t", str(tmp_path / "b"), sink_to(rows), "arrival_seq"
        )
    )
    assert spark.read.parquet(rows).where("value LIKE 'Point(%'").count() > 0


def test_position_keeper_restarts(spark, tmp_path):
    source = flights(spark, FOLDER)
    half = source.agg(F.expr("percentile(arrival_seq, 0.5)")).first()[0]
    folder, state = (str(tmp_path / n) for n in ("in", "state"))
    kept = flight_lines(source, keep=("arrival_seq",))
    for k, part in enumerate((kept.where(F.col("arrival_seq") < half), kept.where(F.col("arrival_seq") >= half))):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = replay_table(spark, folder)
        finish(programs.start_position_keeper(stream, state, "arrival_seq"))
        seen = source if k else source.where(F.col("arrival_seq") < half)
        expected = {
            r[0]: (r[1], r[2])
            for r in seen.groupBy("flight_id")
            .agg(F.max_by("longitude", "arrival_seq"), F.max_by("latitude", "arrival_seq"))
            .collect()
        }
        got = programs.kept_positions(spark, state).collect()
        assert {r.flight_id: (r.longitude, r.latitude) for r in got} == expected
        assert len(got) == len(expected)


def test_traces(lines, tmp_path):
    query = programs.start_position_traces(lines, str(tmp_path / "t"))
    query.processAllAvailable()
    shown = sum(p["sink"]["numOutputRows"] for p in query.recentProgress)
    query.stop()
    assert shown == 200


def test_start_uses_rocksdb_for_this_query_only(spark, lines, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    counts = programs.flight_count_messages(lines, "t")
    finish(start(spark, table_sink(counts, "one", str(tmp_path / "c"), str(tmp_path / "r"), interval=None)))
    assert spark.conf.get(name) == before


def test_text_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    stream = text_stream(spark, str(tmp_path))
    rows = str(tmp_path / "rows")
    run_available(spark, table_sink(stream, "t", str(tmp_path / "c"), rows, mode="append", once=True))
    assert {r.value for r in spark.read.parquet(rows).collect()} == {"one", "two"}
