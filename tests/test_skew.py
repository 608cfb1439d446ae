from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trackwake.operators.records import record_updates
from trackwake.operators.skew import (
    frequent_keys,
    join_per_key,
    numbered_range,
    range_cuts,
)
from trackwake.operators.tracks import track_state


@pytest.fixture
def width(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield 8
    spark.conf.set("spark.sql.shuffle.partitions", before)


def skewed(spark):
    """One key with half of 4,000 rows, 200 others, some rows without a key."""
    return spark.range(4000, numPartitions=6).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot"))
        .when(F.col("id") % 9 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 200))
        .alias("flight_id"),
        F.col("id").alias("n"),
    )


def test_frequent_keys(spark, width):
    assert frequent_keys(skewed(spark), "flight_id") == {"hot": 4}
    even = spark.range(1000).select((F.col("id") % 100).alias("flight_id"))
    assert frequent_keys(even, "flight_id") == {}
    assert frequent_keys(even.limit(0), "flight_id") == {}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_meets_each_row_once(spark, width, how):
    many = skewed(spark)
    one = many.where("flight_id <> 'k7'").groupBy("flight_id").agg(F.max("n").alias("most"))
    plain = many.join(one, "flight_id", how)
    found = join_per_key(many, one, "flight_id", how)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.select(found.columns).collect()))


def test_input_hashed_by_the_key_is_still_split(spark, width):
    many = skewed(spark).repartition(8, "flight_id")
    one = many.groupBy("flight_id").agg(F.max("n").alias("most"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_per_key(many, one, "flight_id")
        places = joined.where("flight_id = 'hot'").select(F.spark_partition_id()).distinct()
        assert places.count() >= 3
        assert "TakeOrdered" not in joined._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranges_are_even(spark, width):
    rows = skewed(spark)
    cuts = range_cuts(rows, "flight_id", "n")
    sizes = (
        numbered_range(rows, cuts, "flight_id", "n", "range")
        .where("flight_id = 'hot'")
        .groupBy("range")
        .count()
        .collect()
    )
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 700


@pytest.mark.parametrize("arrival", ["seq", ["day", "part", "seq"]])
def test_record_updates_with_hot_and_missing_keys(spark, width, arrival):
    draw = random.Random(2)
    rows = [
        (draw.choice(["hot"] * 5 + [None] * 3 + ["a", "b"]), draw.randrange(40), i // 40, i % 3, 1_700_000_000_000_000 + i * 37_000_003)
        for i in range(900)
    ]
    frame = spark.createDataFrame(rows, "flight_id string, time int, day int, part int, seq long").withColumn(
        "day", F.timestamp_seconds(F.col("day") * 60)
    )
    found = record_updates(frame.repartition(5), time="time", arrival=arrival, columns=["part"])
    order = (lambda r: r[4]) if arrival == "seq" else (lambda r: (r[2], r[3], r[4]))
    expected, counts, latest = {}, {}, {}
    for key, time, day, part, seq in sorted(rows, key=order):
        counts[key] = counts.get(key, 0) + 1
        if key not in latest or time > latest[key][0]:
            latest[key] = (time, part)
        expected[seq] = (key, counts[key], *latest[key])
    got = {r.seq: (r.flight_id, r.n, r.latest_time, r.latest_part) for r in found.collect()}
    assert got == expected
    assert "TakeOrdered" not in found._jdf.queryExecution().toString()


def test_key_filter_above_track_state(spark, tmp_path):
    path = str(tmp_path / "reports")
    spark.range(100).selectExpr(
        "concat('F', id % 10) AS flight_id", "id AS time", "id AS arrival_seq"
    ).write.parquet(path)
    state = track_state(spark.read.parquet(path), where=F.col("flight_id") == "F3")
    plan = state._jdf.queryExecution().toString()
    assert "EqualTo(flight_id,F3)" in plan
    assert {r.flight_id for r in state.collect()} == {"F3"}
