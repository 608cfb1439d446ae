"""Projection, record transforms and the binary form of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trackwake.functions.geometry import (
    WEB_MERCATOR,
    WGS84,
    to_web_mercator,
    wkb_decode,
    wkb_encode,
)


def project_points(
    df: DataFrame,
    geometry: str = "geometry",
    out_wkid: int = WEB_MERCATOR,
    poles: str = "fail",
) -> DataFrame:
    """Move a point column from WGS84 to Web Mercator.

    All other columns pass through, and the column's ``wkid`` metadata follows.
    A column without metadata is read as WGS84; other references are refused.
    """
    metadata = df.schema[geometry].metadata
    source = metadata.get("wkid", WGS84)
    if source == out_wkid:
        return df
    if (source, out_wkid) != (WGS84, WEB_MERCATOR):
        raise ValueError(f"no projection from {source} to {out_wkid}")
    moved = to_web_mercator(F.col(geometry), poles)
    return df.withColumn(
        geometry, moved.alias(geometry, metadata={**metadata, "wkid": out_wkid})
    )


def null_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The same records without geometry."""
    kind = df.schema[geometry].dataType
    return df.withColumn(
        geometry,
        F.lit(None).cast(kind).alias(geometry, metadata=df.schema[geometry].metadata),
    )


def transform_records(
    df: DataFrame,
    function: Callable[[pa.RecordBatch, T.StructType], pa.RecordBatch],
    schema: T.StructType,
) -> DataFrame:
    """Run a user function, given records and their schema, over Arrow batches.

    For transforms that column expressions cannot state; anything else is
    better written as ``df.transform(function_on_dataframes)``.
    """
    source = df.schema

    def batches(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record_batch in records:
            yield function(record_batch, source)

    return df.mapInArrow(batches, schema)


def points_to_wkb(
    df: DataFrame, geometry: str = "geometry", out: str | None = None
) -> DataFrame:
    """Point column to standard WKB bytes."""
    return df.withColumn(
        out or geometry, wkb_encode(F.col(geometry)["x"], F.col(geometry)["y"])
    )


def wkb_to_points(
    df: DataFrame, wkb: str = "geometry", out: str | None = None
) -> DataFrame:
    """Standard WKB bytes to a point column."""
    return df.withColumn(out or wkb, wkb_decode(F.col(wkb)))
