"""Delimited text lines to typed flight rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from trackwake.functions.text import split_fields

# The eight positional fields of a flight line.
FLIGHT_LAYOUT = (
    ("flight_id", "string"),
    ("flight_time", "string"),
    ("longitude", "double"),
    ("latitude", "double"),
    ("origin", "string"),
    ("destination", "string"),
    ("aircraft", "string"),
    ("altitude", "bigint"),
)


def text_payload(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message bytes as text."""
    return messages.withColumn(value, F.col(value).cast("string"))


def binary_payload(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message payload as bytes."""
    return messages.withColumn(value, F.col(value).cast("binary"))


_KINDS = ", ".join(f"{name}: {kind}" for name, kind in FLIGHT_LAYOUT)
_FIELDS = "__fields"
_RECORD = "__record"


def _number(text: Column, kind: str) -> Column:
    number = text.try_cast(kind)
    if kind != "double":
        return number
    # Spark also reads 'nan' and 'inf' in any case; only these spellings count.
    special = F.isnan(number) | (F.abs(number) == float("inf"))
    spelled = text.rlike(r"^[+-]?(NaN|Infinity|[0-9.].*)$")
    return F.when(~special | spelled, number)


def _typed() -> list[Column]:
    """The fields as typed columns, from the array of texts that a line was split into."""
    texts = [F.trim(F.get(_FIELDS, F.lit(at))) for at in range(len(FLIGHT_LAYOUT))]
    return [
        (text if kind == "string" else _number(text, kind)).alias(name)
        for text, (name, kind) in zip(texts, FLIGHT_LAYOUT)
    ]


def _problem() -> Column:
    """What is wrong with a line, null for a good one."""
    last = F.trim(F.get(_FIELDS, F.lit(len(FLIGHT_LAYOUT) - 1)))
    checks = F.when(F.coalesce(last, F.lit("")) == "", F.lit("missing field"))
    for column, (name, kind) in zip(_typed(), FLIGHT_LAYOUT):
        if kind != "string":
            checks = checks.when(column.isNull(), F.lit(f"bad {name}"))
    return checks


def _record() -> Column:
    """The typed fields of a good line as one struct, null for a bad line."""
    typed = _typed()
    numbers = [
        column.cast("double")
        for column, (_, kind) in zip(typed, FLIGHT_LAYOUT)
        if kind != "string"
    ]
    # A sum is null if any part is. Unlike a chain of conditions it always
    # evaluates every part, so that they are shared with the struct's fields.
    return F.when(reduce(add, numbers).isNotNull(), F.struct(*typed))


def _parsed(lines: DataFrame, value: str, carried: Sequence[str]) -> DataFrame:
    """``carried`` columns, the line's fields and its record, each worked out once.

    A line is split in one projection, and typed in the next. What follows only
    refers to the two columns, so neither a generator nor a condition repeats the
    work.
    """
    split = lines.select(*carried, split_fields(F.col(value)).alias(_FIELDS))
    return split.select(*carried, _FIELDS, _record().alias(_RECORD))


def parse_flights(
    lines: DataFrame,
    mode: str = "fail",
    value: str = "value",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed rows of flight lines; works on tables and on streams.

    ``mode="fail"`` stops the query at the first malformed line, whatever the
    query uses of it, a bare row count included. ``mode="reject"`` leaves
    malformed lines out; ``flight_rejects`` over the same lines returns exactly
    those. ``keep`` names further input columns to carry along, such as arrival;
    filters on them reach the source.
    """
    if mode == "reject":
        parsed = _parsed(lines, value, keep)
        return parsed.select(*keep, F.inline(F.array_compact(F.array(_RECORD))))
    if mode != "fail":
        raise ValueError(f"unknown mode {mode!r}")
    parsed = _parsed(lines, value, [value, *[name for name in keep if name != value]])
    told = F.concat_ws(": ", F.lit("malformed flight line"), _problem(), F.col(value))
    stop = F.raise_error(told).cast(f"struct<{_KINDS}>")
    # A generator is never pruned away.
    return parsed.select(*keep, F.inline(F.array(F.coalesce(_RECORD, stop))))


def judge_flights(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every line with its ``record`` or, if malformed, its ``reason``: one parse.

    Write or stream this out once to get both accepted and rejected lines from
    a single pass over the input.
    """
    parsed = _parsed(lines, value, lines.columns)
    reason = F.when(F.col(_RECORD).isNull(), _problem())
    judged = F.struct(F.col(_RECORD).alias("record"), reason.alias("reason"))
    # Filters on what a generator returns stay above it, and so above the parse.
    return parsed.select(*lines.columns, judged.alias("__judged")).select(
        *lines.columns, F.inline(F.array("__judged"))
    )


def flight_rejects(lines: DataFrame, value: str = "value") -> DataFrame:
    """The malformed lines, with all input columns and a ``reason``."""
    return judge_flights(lines, value).where(F.col("reason").isNotNull()).drop("record")


def flight_lines(flights: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flight rows written as text lines, the inverse of ``parse_flights``."""
    fields = ", ".join(f"cast({name} as string)" for name, _ in FLIGHT_LAYOUT)
    return flights.selectExpr(*keep, f"concat_ws(',', {fields}) as value")


def parse_flight_time(text: Column) -> Column:
    """Flight line times such as ``3/16/2012 02:25:30 PM``."""
    return F.to_timestamp(text, "M/d/yyyy hh:mm:ss a")
