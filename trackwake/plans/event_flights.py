"""Flight reports read from an ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackwake.functions.geometry import make_point


def events_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/events.parquet"


def flights_of(events: DataFrame) -> DataFrame:
    """Events, as a table or a stream, seen as flight reports.

    ``event_id`` gives in-order arrival and ``arrival_seq`` arrival out of
    order (a bijection, unique at any size); ``track_day`` is a track time with
    many ties.
    """
    # The day goes by way of a date, which no session time zone can shift.
    return events.selectExpr(
        "concat('F', cast(user_id as string)) as flight_id",
        "ts as flight_time",
        "cast(event_id * 37 % 36000 as double) / 100e0 - 180e0 as longitude",
        "cast(event_id * 17 % 17000 as double) / 100e0 - 85e0 as latitude",
        "upper(substr(event_type, 1, 3)) as origin",
        "concat('D', cast(user_id % 7 as string)) as destination",
        "concat('A', cast(event_id % 5 as string)) as aircraft",
        "cast(floor(value * 100e0) as bigint) as altitude",
        "cast(cast(ts as date) as timestamp_ntz) as track_day",
        "event_id ^ 5461L as arrival_seq",
        "event_id",
    )


def flights(spark: SparkSession, folder: str) -> DataFrame:
    return flights_of(spark.read.parquet(events_path(folder)))


def with_geometry(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "geometry", make_point(F.col("longitude"), F.col("latitude"))
    )
