"""JSON feature schemas: column types, role tags and the geometry reference."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackwake.functions.geometry import POINT

# Attribute type names. Date holds a date with a time of day.
ATTRIBUTE_TYPES: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Binary": T.BinaryType(),
    "Boolean": T.BooleanType(),
    "Date": T.TimestampType(),
    "Geometry": T.BinaryType(),
}

TRACK_ID = "TRACK_ID"
START_TIME = "START_TIME"


def read_feature_schema(document: str) -> T.StructType:
    """A JSON schema document as a StructType.

    Role tags sit in the field metadata under ``tags``; the geometry field
    carries ``geometryType`` and ``wkid``, a time field its ``timeType``.
    """
    parsed = json.loads(document)
    fields = []
    for attribute in parsed["attributes"]:
        kind = ATTRIBUTE_TYPES.get(attribute["dataType"])
        if kind is None:
            raise ValueError(
                f"attribute {attribute['name']}: unknown type {attribute['dataType']}"
            )
        tags = [tag["name"] for tag in attribute.get("tags", [])]
        fields.append(
            T.StructField(
                attribute["name"],
                kind,
                attribute.get("nullable", True),
                {"tags": tags} if tags else None,
            )
        )
    geometry = parsed.get("geometry")
    if geometry:
        # Type names carry a vendor prefix; the part after "Geometry" counts.
        shape = re.split("Geometry", geometry["geometryType"])[-1]
        if shape != "Point":
            raise ValueError(f"unsupported geometry type {geometry['geometryType']}")
        fields.append(
            T.StructField(
                geometry["fieldName"],
                POINT,
                True,
                {
                    "geometryType": shape,
                    "wkid": geometry["spatialReference"]["wkid"],
                },
            )
        )
    if parsed.get("time"):
        fields.append(
            T.StructField(
                "time",
                T.TimestampType(),
                True,
                {"timeType": parsed["time"]["timeType"]},
            )
        )
    return T.StructType(fields)


def role_column(schema: T.StructType, role: str) -> str:
    """The one column tagged with a role."""
    tagged = [f.name for f in schema.fields if role in f.metadata.get("tags", [])]
    if len(tagged) != 1:
        raise ValueError(f"role {role}: expected one column, found {tagged}")
    return tagged[0]


def geometry_column(schema: T.StructType) -> str:
    """The one geometry column."""
    found = [f.name for f in schema.fields if "wkid" in f.metadata]
    if len(found) != 1:
        raise ValueError(f"expected one geometry column, found {found}")
    return found[0]


def _converted(source: Column, have: T.DataType, field: T.StructField) -> Column:
    """The column in the field's type; a value that does not fit stops the query.

    Nothing depends on whether the session's casts are strict.
    """
    if isinstance(field.dataType, T.StructType):
        return source.cast(field.dataType)
    cast = source.try_cast(field.dataType)
    if isinstance(field.dataType, T.TimestampType) and isinstance(have, T.StringType):
        cast = F.coalesce(F.try_to_timestamp(source, F.lit("M/d/yyyy hh:mm:ss a")), cast)
    told = F.lit(f"value of {field.name} is no {field.dataType.simpleString()}")
    stop = F.raise_error(told).cast(field.dataType)
    return F.coalesce(cast, F.when(source.isNotNull(), stop))


def apply_feature_schema(
    df: DataFrame,
    schema: T.StructType | str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Cast and name columns by a feature schema; works on tables and streams.

    Columns are matched by name, and each must be there, geometry and time
    included. A null in a column declared not nullable stops the query, and so
    does a value that does not fit its type, with strict casts or without. Roles
    and the spatial reference travel in the column metadata.
    """
    if isinstance(schema, str):
        schema = read_feature_schema(schema)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the schema: {missing}")
    required = [f.name for f in schema.fields if not f.nullable]
    if required:
        complete = reduce(and_, [F.col(name).isNotNull() for name in required])
        broken = F.concat_ws(
            ", ", *[F.when(F.col(name).isNull(), F.lit(name)) for name in required]
        )
        stop = F.raise_error(F.concat(F.lit("null in required column: "), broken))
        df = df.where(F.when(complete, F.lit(True)).otherwise(stop.cast("boolean")))
    return df.select(
        *[
            _converted(F.col(f.name), df.schema[f.name].dataType, f).alias(
                f.name, metadata=f.metadata or {}
            )
            for f in schema.fields
        ],
        *keep,
    )


def with_track_id(df: DataFrame, name: str = "trackId") -> DataFrame:
    """Add the track key, read from the column tagged ``TRACK_ID``."""
    return df.withColumn(name, F.col(role_column(df.schema, TRACK_ID)).cast("string"))


def feature_rows(df: DataFrame) -> DataFrame:
    """Feature columns as relational rows with the geometry named ``SHAPE``."""
    return df.withColumnRenamed(geometry_column(df.schema), "SHAPE")


def track_updates(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename and prune to ``trackId, timestamp, geometry``."""
    key = role_column(df.schema, TRACK_ID)
    time = role_column(df.schema, START_TIME)
    shape = geometry_column(df.schema)
    return df.select(
        F.col(key).cast("string").alias("trackId"),
        F.col(time).alias("timestamp"),
        F.col(shape).alias("geometry"),
        *keep,
    )


def projected_schema(schema: T.StructType, wkid: int) -> T.StructType:
    """The schema with its geometry moved to another spatial reference."""
    shape = geometry_column(schema)
    return T.StructType(
        [
            T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "wkid": wkid})
            if f.name == shape
            else f
            for f in schema.fields
        ]
    )
