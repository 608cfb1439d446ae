import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from __spark_entry__ import FLIGHT_SCHEMA
from tests import samples
from trackwake.operators.schema import (
    apply_feature_schema,
    feature_rows,
    geometry_column,
    projected_schema,
    read_feature_schema,
    role_column,
    track_updates,
    with_track_id,
)


def test_flight_schema():
    schema = read_feature_schema(FLIGHT_SCHEMA)
    assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [
        ("flightId", "string"),
        ("flightTime", "timestamp"),
        ("longitude", "double"),
        ("latitude", "double"),
        ("origin", "string"),
        ("destination", "string"),
        ("aircraft", "string"),
        ("altitude", "int"),
        ("Geometry", "struct<x:double,y:double>"),
        ("time", "timestamp"),
    ]
    assert role_column(schema, "TRACK_ID") == "flightId"
    assert role_column(schema, "START_TIME") == "flightTime"
    assert schema["Geometry"].metadata == {"geometryType": "Point", "wkid": 4326}
    assert schema["time"].metadata == {"timeType": "Instant"}
    assert not schema["flightId"].nullable
    with pytest.raises(ValueError):
        role_column(schema, "END_TIME")


def test_every_attribute_type():
    kinds = {
        "String": "string", "Int8": "tinyint", "Int16": "smallint", "Int32": "int",
        "Int64": "bigint", "Float32": "float", "Float64": "double",
        "Binary": "binary", "Boolean": "boolean", "Date": "timestamp",
        "Geometry": "binary",
    }
    document = json.dumps(
        {"attributes": [{"name": kind, "dataType": kind} for kind in kinds]}
    )
    schema = read_feature_schema(document)
    assert {f.name: f.dataType.simpleString() for f in schema.fields} == kinds
    with pytest.raises(ValueError, match="Decimal"):
        read_feature_schema('{"attributes": [{"name": "a", "dataType": "Decimal"}]}')


def test_vendor_prefix_and_other_shapes():
    document = json.loads(FLIGHT_SCHEMA)
    document["geometry"]["geometryType"] = "acmeGeometryPoint"
    assert geometry_column(read_feature_schema(json.dumps(document))) == "Geometry"
    document["geometry"]["geometryType"] = "acmeGeometryMultipoint"
    with pytest.raises(ValueError):
        read_feature_schema(json.dumps(document))


def test_apply_and_rename(spark):
    typed = apply_feature_schema(samples.features(spark), FLIGHT_SCHEMA, ("arrival",))
    first = typed.where("arrival = 1").first()
    assert first.flightTime == dt.datetime(2012, 3, 16, 14, 25, 30)
    assert first.altitude == 37000
    assert with_track_id(typed).where("arrival = 8").first().trackId == "ASA3"
    assert "SHAPE" in feature_rows(typed).columns
    updates = track_updates(typed)
    assert updates.columns == ["trackId", "timestamp", "geometry"]
    assert updates.count() == 10


def test_timestamps_pass_as_they_are(spark):
    ready = samples.features(spark).withColumn(
        "flightTime", F.lit("2020-05-06 07:08:09.123456").cast("timestamp")
    )
    typed = apply_feature_schema(ready, FLIGHT_SCHEMA)
    assert typed.first().flightTime == dt.datetime(2020, 5, 6, 7, 8, 9, 123456)


def test_null_in_required_column_stops_the_query(spark):
    broken = samples.features(spark).withColumn("origin", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null in required column: origin"):
        apply_feature_schema(broken, FLIGHT_SCHEMA).select("flightId").collect()


def test_null_geometry_and_time_are_allowed(spark):
    kind = T.StructType.fromDDL("x double, y double")
    bare = samples.features(spark).withColumns(
        {"Geometry": F.lit(None).cast(kind), "time": F.lit(None).cast("timestamp")}
    )
    assert apply_feature_schema(bare, FLIGHT_SCHEMA).count() == 10


def test_missing_column(spark):
    with pytest.raises(ValueError, match="origin"):
        apply_feature_schema(samples.features(spark).drop("origin"), FLIGHT_SCHEMA)


def test_projected_schema():
    schema = projected_schema(read_feature_schema(FLIGHT_SCHEMA), 3857)
    assert schema["Geometry"].metadata["wkid"] == 3857
    assert schema["flightId"].metadata == {"tags": ["TRACK_ID"]}
