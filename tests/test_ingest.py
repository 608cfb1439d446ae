import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests import samples
from trackwake.operators.ingest import (
    binary_payload,
    flight_lines,
    flight_rejects,
    parse_flight_time,
    parse_flights,
    text_payload,
)
from trackwake.plans.programs import flight_traces

GOOD = "SWA1,3/16/2012 02:25:30 PM,-79.5,34.2,IAD,TPA,B733,37000"

GOOD_LINES = {
    GOOD: ("SWA1", "3/16/2012 02:25:30 PM", -79.5, 34.2, "IAD", "TPA", "B733", 37000),
    " SWA1 ,\t3/16/2012 02:25:30 PM,-79.5 , 34.2,\x00IAD\x1f,TPA,  B733,37000\r\n": (
        "SWA1", "3/16/2012 02:25:30 PM", -79.5, 34.2, "IAD", "TPA", "B733", 37000,
    ),
    GOOD + ",ninth,,": ("SWA1", "3/16/2012 02:25:30 PM", -79.5, 34.2, "IAD", "TPA", "B733", 37000),
    ",,1e3,1.5f,,,,+7": ("", "", 1000.0, 1.5, "", "", "", 7),
    "a,b,Infinity,-Infinity,c,d,e,-1": ("a", "b", float("inf"), float("-inf"), "c", "d", "e", -1),
    'q,"x,1.5,2.5,y",z,w,8': ("q", '"x', 1.5, 2.5, 'y"', "z", "w", 8),
}

BAD_LINES = {
    "SWA1,t,-79.5,34.2,IAD,TPA,B733": "missing field",
    "SWA1,t,-79.5,34.2,IAD,TPA,B733,": "missing field",
    "SWA1,t,-79.5,34.2,IAD,TPA,B733, \t": "missing field",
    "SWA1,t,west,34.2,IAD,TPA,B733,1": "bad longitude",
    "SWA1,t,,34.2,IAD,TPA,B733,1": "bad longitude",
    "SWA1,t,nan,34.2,IAD,TPA,B733,1": "bad longitude",
    "SWA1,t,1,inf,IAD,TPA,B733,1": "bad latitude",
    "SWA1,t,1,2,IAD,TPA,B733,12.5": "bad altitude",
    "SWA1,t,1,2,IAD,TPA,B733,high": "bad altitude",
    "SWA1,t,1,2,IAD,TPA,B733,9223372036854775808": "bad altitude",
    "": "missing field",
    None: "missing field",
}


def _lines(spark, values):
    return spark.createDataFrame([(value,) for value in values], "value string")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_good_lines(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for line, expected in GOOD_LINES.items():
            rows = parse_flights(_lines(spark, [line])).collect()
            assert [tuple(row) for row in rows] == [expected], line
        rows = parse_flights(_lines(spark, list(BAD_LINES) + [GOOD]), "reject").collect()
        assert [tuple(row) for row in rows] == [GOOD_LINES[GOOD]]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_nan_is_a_number(spark):
    row = parse_flights(_lines(spark, ["a,b,NaN,1,c,d,e,1"])).first()
    assert row.longitude != row.longitude


def test_rejects_tell_why(spark):
    lines = _lines(spark, list(BAD_LINES) + list(GOOD_LINES))
    found = {row.value: row.reason for row in flight_rejects(lines).collect()}
    assert found == BAD_LINES


@pytest.mark.parametrize("line", BAD_LINES)
def test_bad_line_stops_the_query(spark, line):
    parsed = parse_flights(_lines(spark, [GOOD, line]))
    with pytest.raises(Exception, match="malformed flight line"):
        parsed.collect()


def test_bad_line_stops_a_query_over_other_fields(spark):
    parsed = parse_flights(_lines(spark, [GOOD, "a,b,1,2,c,d,e,high"]))
    with pytest.raises(Exception, match="bad altitude"):
        parsed.groupBy("flight_id").count().collect()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        parse_flights(_lines(spark, [GOOD]), "guess")


def test_lines_and_payloads_round_trip(spark):
    lines = spark.createDataFrame(samples.lines(), "value string")
    flights = parse_flights(text_payload(binary_payload(lines)))
    again = flight_lines(flights)
    assert parse_flights(again).collect() == flights.collect()
    assert flights.count() == 10


def test_flight_time(spark):
    text = spark.createDataFrame([("3/16/2012 02:25:30 PM",)], "t string")
    assert text.select(parse_flight_time(F.col("t"))).first()[0] == dt.datetime(
        2012, 3, 16, 14, 25, 30
    )


def test_trace_lines(spark):
    lines = spark.createDataFrame(samples.lines(), "value string")
    assert {row.trace for row in flight_traces(lines).collect()} == samples.TRACES


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_split_once(spark, tmp_path):
    _lines(spark, [GOOD]).withColumn("seq", F.lit(1)).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    for parsed in (
        parse_flights(lines, keep=("seq",)),
        parse_flights(lines, "reject"),
        flight_rejects(lines),
        parse_flights(lines).groupBy("flight_id").count(),
    ):
        assert _executed(parsed).count("split(") == 1
    # What is not asked for is not read, and a filter on what is kept reaches the scan.
    plan = _executed(parse_flights(lines, "reject", keep=("seq",)).where("seq = 1").select("altitude"))
    assert "PushedFilters: [IsNotNull(seq), EqualTo(seq,1)]" in plan
    assert "seq" not in _executed(parse_flights(lines, "reject")).split("ReadSchema")[1]
