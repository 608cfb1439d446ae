"""Point geometry as ``STRUCT<x DOUBLE, y DOUBLE>`` columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

POINT = T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
)

# Spatial reference ids and the sphere radius of Web Mercator.
WGS84 = 4326
WEB_MERCATOR = 3857
EARTH_RADIUS = 6378137.0

# One standard WKB point: byte order, geometry type 1, then x and y.
_WKB_LITTLE = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])
_WKB_BIG = np.dtype([("order", "u1"), ("kind", ">u4"), ("x", ">f8"), ("y", ">f8")])
_WKB_POINT_SIZE = _WKB_LITTLE.itemsize


def make_point(x: Column, y: Column) -> Column:
    """A point, null when either coordinate is null."""
    return F.when(
        x.isNotNull() & y.isNotNull(),
        F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")),
    )


def to_web_mercator(point: Column, poles: str = "fail") -> Column:
    """WGS84 degrees to Web Mercator metres.

    The poles have no Web Mercator image, nor has anything beyond them: a
    latitude of 90 degrees or more in either direction stops the query, or with
    ``poles="null"`` gives a null point.
    """
    if poles not in {"fail", "null"}:
        raise ValueError(f"unknown way with poles {poles!r}")
    x = F.lit(EARTH_RADIUS) * F.radians(point["x"])
    y = F.lit(EARTH_RADIUS) * F.ln(
        F.tan(F.lit(math.pi / 4) + F.radians(point["y"]) / F.lit(2.0))
    )
    moved = F.when(
        point.isNotNull() & (F.abs(point["y"]) < 90),
        F.struct(x.alias("x"), y.alias("y")),
    )
    if poles == "null":
        return moved
    told = F.concat(F.lit("no Web Mercator image of latitude "), point["y"].cast("string"))
    stop = F.raise_error(told).cast(POINT)
    return F.coalesce(moved, F.when(point["y"].isNotNull(), stop))


@F.arrow_udf(T.BinaryType())
def wkb_encode(x: pa.Array, y: pa.Array) -> pa.Array:
    """Little-endian WKB points; null where a coordinate is null."""
    rows = len(x)
    records = np.zeros(rows, dtype=_WKB_LITTLE)
    records["order"] = 1
    records["kind"] = 1
    records["x"] = x.to_numpy(zero_copy_only=False)
    records["y"] = y.to_numpy(zero_copy_only=False)
    offsets = np.arange(rows + 1, dtype=np.int32) * _WKB_POINT_SIZE
    packed = pa.Array.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(records)]
    )
    known = pc.and_(x.is_valid(), y.is_valid())
    return pc.if_else(known, packed, pa.scalar(None, pa.binary()))


@F.arrow_udf(POINT)
def wkb_decode(wkb: pa.Array) -> pa.Array:
    """WKB points of either byte order to coordinates; null stays null.

    Anything but a two-dimensional point fails the query.
    """
    rows = len(wkb)
    known = wkb.is_valid().to_numpy(zero_copy_only=False)
    points = wkb.drop_null().cast(pa.binary(_WKB_POINT_SIZE))
    packed = np.frombuffer(
        points.buffers()[1] or b"",
        dtype=_WKB_LITTLE,
        count=len(points),
        offset=points.offset * _WKB_POINT_SIZE,
    )
    swapped = packed.view(_WKB_BIG)
    little = packed["order"] == 1
    if np.any(np.where(little, packed["kind"], swapped["kind"]) != 1):
        raise ValueError("not a WKB point: wrong geometry type")
    x = np.zeros(rows)
    y = np.zeros(rows)
    x[known] = np.where(little, packed["x"], swapped["x"])
    y[known] = np.where(little, packed["y"], swapped["y"])
    return pa.StructArray.from_arrays(
        [pa.array(x), pa.array(y)], names=["x", "y"], mask=pa.array(~known)
    )
