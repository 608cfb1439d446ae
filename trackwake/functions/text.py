"""Text shapes of positions, trace lines and snapshot cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character up to and including the space is a blank.
_CONTROL = r"[\x00-\x1f]"
_BLANKS = r"[\x00-\x20]+"
_OUTER_BLANKS = rf"^{_BLANKS}|{_BLANKS}\z|(?<=,){_BLANKS}|{_BLANKS}(?=,)"


def split_fields(line: Column) -> Column:
    """The comma-separated fields of a line, with no blanks but spaces around them.

    Lines without control characters, as nearly all are, need no more than the
    split; what is left for the reader of a field is a plain trim.
    """
    clean = F.when(
        line.rlike(_CONTROL), F.regexp_replace(line, _OUTER_BLANKS, "")
    ).otherwise(line)
    return F.split(clean, ",", -1)


def _triple(point: Column) -> Column:
    # A two-dimensional point prints a zero height.
    return F.concat(
        F.lit("("),
        F.concat_ws(
            ", ",
            point["x"].cast("string"),
            point["y"].cast("string"),
            F.lit("0.0"),
        ),
        F.lit(")"),
    )


def position_text(point: Column) -> Column:
    """``(x, y, z)``, or ``unknown`` where there is no point."""
    return F.when(point.isNull(), F.lit("unknown")).otherwise(_triple(point))


def point_message(point: Column) -> Column:
    """``Point(x, y, z)``, or ``null`` (the text) where there is no point."""
    return F.when(point.isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("Point"), _triple(point))
    )


def time_text(time: Column) -> Column:
    """The time as text, or ``unknown``."""
    return F.coalesce(time.cast("string"), F.lit("unknown"))


def update_trace(track_id: Column, longitude: Column, latitude: Column) -> Column:
    """One trace line per received report."""
    return F.format_string(
        "Update received for flightId=%s, longitude=%s, latitude=%s!",
        track_id,
        longitude.cast("string"),
        latitude.cast("string"),
    )


def long_bytes(number: Column) -> Column:
    """A bigint as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("bigint")), 16, "0"))
