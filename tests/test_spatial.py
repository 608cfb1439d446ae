import math
import struct

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests import samples
from trackwake.functions.text import point_message, position_text, time_text
from trackwake.operators.spatial import (
    null_geometry,
    points_to_wkb,
    project_points,
    transform_records,
    wkb_to_points,
)

POINTS = "id int, geometry struct<x: double, y: double>"


def _points(spark, *points):
    return spark.createDataFrame(list(enumerate(points)), POINTS)


def test_projection(spark):
    df = _points(spark, (0.0, 0.0), (180.0, 0.0), (-79.585739043999979, 34.265521039000078), (10.0, 85.0), (10.0, -85.0), None)
    moved = [row.geometry for row in project_points(df).orderBy("id").collect()]
    assert moved[0].x == pytest.approx(0) and moved[0].y == pytest.approx(0, abs=1e-8)
    assert moved[1].x == pytest.approx(math.pi * 6378137.0)
    assert (round(moved[2].x, 2), round(moved[2].y, 2)) == (-8859443.94, 4064510.98)
    assert moved[3].y == pytest.approx(-moved[4].y)
    assert moved[5] is None


def test_poles_have_no_projection(spark):
    df = _points(spark, (0.0, 90.0), (0.0, -90.0), (0.0, 91.0))
    moved = project_points(df, poles="null")
    assert [row.geometry for row in moved.collect()] == [None] * 3
    for at in ((0.0, 90.0), (0.0, -91.0)):
        with pytest.raises(Exception, match="no Web Mercator image"):
            project_points(_points(spark, at)).collect()
    with pytest.raises(ValueError):
        project_points(df, poles="clip")


def test_projection_metadata(spark):
    df = _points(spark, (1.0, 2.0))
    tagged = df.withColumn("geometry", F.col("geometry").alias("g", metadata={"wkid": 4326, "geometryType": "Point"}))
    moved = project_points(tagged)
    assert moved.schema["geometry"].metadata == {"wkid": 3857, "geometryType": "Point"}
    assert project_points(moved) is moved
    with pytest.raises(ValueError):
        project_points(df, out_wkid=2154)
    with pytest.raises(ValueError):
        project_points(moved, out_wkid=4326)


def test_null_geometry(spark):
    df = samples.features(spark)
    bare = df.transform(null_geometry, "Geometry")
    assert bare.columns == df.columns
    assert bare.schema["Geometry"].dataType == df.schema["Geometry"].dataType
    assert {row.Geometry for row in bare.collect()} == {None}
    assert bare.count() == 10


def test_record_transform(spark):
    def lift(batch, schema):
        at = schema.names.index("altitude")
        return batch.set_column(at, schema.names[at], pc.add(batch[at], pa.scalar(1, pa.int32())))

    df = samples.features(spark).select("flightId", "altitude")
    lifted = df.transform(transform_records, lift, df.schema)
    assert sorted(row.altitude for row in lifted.collect()) == sorted(
        report[7] + 1 for report in samples.REPORTS
    )


def test_wkb_round_trip(spark):
    df = _points(spark, (1.5, -2.25), None, (-179.99, 84.0), (float("inf"), 0.0))
    wkb = points_to_wkb(df, out="wkb")
    assert bytes(wkb.where("id = 0").first().wkb) == struct.pack("<BIdd", 1, 1, 1.5, -2.25)
    assert wkb.where("id = 1").first().wkb is None
    back = wkb_to_points(wkb, "wkb", "again")
    assert back.where("again is distinct from geometry").count() == 0


def test_wkb_big_endian_and_nulls(spark):
    rows = [
        (0, struct.pack(">BIdd", 0, 1, 7.0, 8.0)),
        (1, None),
        (2, struct.pack("<BIdd", 1, 1, 9.0, 10.0)),
    ]
    df = spark.createDataFrame(rows, "id int, geometry binary").coalesce(1)
    found = [row.geometry for row in wkb_to_points(df).orderBy("id").collect()]
    assert found[0] == (7.0, 8.0) and found[1] is None and found[2] == (9.0, 10.0)
    none = df.where("id = 1")
    assert wkb_to_points(none).first().geometry is None


@pytest.mark.parametrize(
    "bad", [b"", b"\x01\x01", struct.pack("<BIdd", 1, 2, 0.0, 0.0)]
)
def test_wkb_of_something_else(spark, bad):
    df = spark.createDataFrame([(bytearray(bad),)], "geometry binary")
    with pytest.raises(Exception):
        wkb_to_points(df).collect()


def test_position_texts(spark):
    df = _points(spark, (1.0, -2.5), (1e7, 0.25), None).orderBy("id")
    point = F.col("geometry")
    assert [tuple(row) for row in df.select(position_text(point), point_message(point)).collect()] == [
        ("(1.0, -2.5, 0.0)", "Point(1.0, -2.5, 0.0)"),
        ("(1.0E7, 0.25, 0.0)", "Point(1.0E7, 0.25, 0.0)"),
        ("unknown", "null"),
    ]
    assert df.select(time_text(F.lit(None).cast("timestamp"))).first()[0] == "unknown"
