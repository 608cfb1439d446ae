"""One output per input record: running totals and running latest reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trackwake.operators.ordering import Arrival, arrival_columns, arrival_rank
from trackwake.operators.skew import numbered_range, range_cuts, range_numbers

_RANGE = "__range"
_REPORT = "__report"


def record_updates(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    columns: Sequence[str] = (),
) -> DataFrame:
    """For each record, its track's count and latest report just after it.

    Returns ``key``, the arrival columns, ``n``, ``latest_time`` and
    ``latest_<column>`` for each of ``columns``. A track with more than its
    share of all rows, that of rows without a key included, is cut into ranges
    of the first arrival column with about equal numbers of rows; what happened
    before a range comes from one summary row per range.
    """
    order = arrival_columns(arrival)
    cuts = range_cuts(df, key, order[0])
    report = F.struct(
        F.col(time).alias("time"),
        *[arrival_rank(df, name).alias(f"__rank_{name}") for name in order],
        *[F.col(c).alias(c) for c in columns],
    )
    rows = numbered_range(df.select(key, *order, report.alias(_REPORT)), cuts, key, order[0], _RANGE)
    within = (
        Window.partitionBy(key, _RANGE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = rows.select(
        key,
        _RANGE,
        *order,
        F.count(F.lit(1)).over(within).alias("n"),
        F.max(_REPORT).over(within).alias(_REPORT),
    )
    if cuts is not None:
        latest = _with_earlier(rows, latest, key)
    return latest.select(
        key,
        *order,
        "n",
        F.col(f"{_REPORT}.time").alias("latest_time"),
        *[F.col(_REPORT)[c].alias(f"latest_{c}") for c in columns],
    )


def _with_earlier(rows: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Counts and reports that take in the ranges before a row's own.

    Range 0 has none before it, so only later ranges of cut keys are summed up.
    """
    before = (
        Window.partitionBy("__key")
        .orderBy("__number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = rows.groupBy(F.col(key).alias("__key"), F.col(_RANGE).alias("__number")).agg(
        F.count(F.lit(1)).alias("__n"), F.max(_REPORT).alias("__latest")
    )
    earlier = sums.select(
        "__key",
        "__number",
        F.sum("__n").over(before).alias("__n"),
        F.max("__latest").over(before).alias("__latest"),
    ).where("__number > 0")
    met = latest.join(
        earlier,
        F.col(key).eqNullSafe(F.col("__key")) & (F.col(_RANGE) == F.col("__number")),
        "left",
    )
    return met.withColumn("n", F.col("n") + F.coalesce("__n", F.lit(0))).withColumn(
        _REPORT, F.greatest(_REPORT, "__latest")
    )


_KIND = "__kind"  # 0 opens a range, 1 is a record
_TOPS = "__tops"
_N = "__n"


def record_tracks(
    df: DataFrame,
    key: str = "flight_id",
    time: str = "time",
    arrival: Arrival = "arrival_seq",
    max_features: int = 2,
    columns: Sequence[str] = (),
    before: DataFrame | None = None,
) -> DataFrame:
    """For each record, its track's count, whether the track took it in, and the newest entry then.

    Returns ``key``, the arrival columns, ``n``, ``added``, ``latest_<time>`` and
    ``latest_<column>``. A record is added unless its time is among the
    ``max_features`` largest distinct ones so far; one that is older than all of a full
    track is added and dropped at once.

    ``before`` says what the tracks held before these records: ``key``, ``n`` and
    ``track``, an array of entries with the time, the arrival and the columns, the
    oldest first. It has one row per key at most.

    The k-th largest time so far is a running maximum as well: of the times that
    lost to the (k-1)-th, by coming in below it or by being pushed down. So every
    place of a track is one window over the same sorted rows. Hot keys are cut
    into ranges, each opened by a row that sums up what comes before it.
    """
    order = arrival_columns(arrival)
    cuts = range_cuts(df, key, order[0])
    report = lambda of: F.struct(
        of(time).alias("time"),
        *[of(name).alias(f"__rank_{name}") for name in order],
        *[of(c).alias(c) for c in columns],
    )
    ranks = df.select("*", *[arrival_rank(df, name).alias(f"__r_{name}") for name in order])
    own = report(lambda name: F.col(f"__r_{name}") if name in order and name != time else F.col(name))
    placed = numbered_range(
        ranks.select(key, *order, F.col(time).alias("__time"), own.alias(_REPORT)), cuts, key, order[0], _RANGE
    )
    rows = placed.withColumn(_KIND, F.lit(1)).withColumn(_N, F.lit(1).cast("long"))
    kind = rows.schema[_REPORT].dataType
    tops = f"array<{rows.schema['__time'].dataType.simpleString()}>"
    pieces = []
    if before is not None:
        newest = F.try_element_at("track", F.lit(-1))
        held = F.when(newest.isNotNull(), report(lambda name: _rank_of(df, newest, name) if name in order and name != time else newest[name]))
        pieces.append(
            before.select(
                key,
                F.lit(-1).alias(_RANGE),
                F.col("n").alias(_N),
                F.reverse(F.transform("track", lambda e: e[time])).cast(tops).alias(_TOPS),
                held.cast(kind).alias(_REPORT),
            )
        )
    openings = _openings(rows, cuts, pieces, key, max_features)
    if openings is not None:
        rows = rows.withColumn(_TOPS, F.lit(None).cast(tops)).unionByName(
            openings.withColumn(_KIND, F.lit(0)), allowMissingColumns=True
        )
    sorted_rows = Window.partitionBy(key, _RANGE).orderBy(_KIND, *order)
    with_own = sorted_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = sorted_rows.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col(_KIND) == 0
    top = lambda k: F.when(opens, F.get(_TOPS, F.lit(k))) if openings is not None else F.when(opens, F.lit(None))
    found = rows.withColumn("n", F.sum(_N).over(with_own)).withColumn("__latest", F.max(_REPORT).over(with_own))
    found = found.withColumn("__c", top(0).otherwise(F.col("__time")))
    added = F.lit(True)
    for k in range(max_features):
        place, lost = f"__m{k}", F.col("__c")
        found = found.withColumn(place, F.max("__c").over(earlier))
        beaten = F.when(lost != F.col(place), F.least(lost, place))
        found = found.withColumn("__c", top(k + 1).otherwise(beaten))
        added &= ~F.col("__time").eqNullSafe(F.col(place))
    shown = (lambda name: F.col("__latest")[name]) if max_features > 0 else (lambda name: F.lit(None).cast(kind[name].dataType))
    return found.where(F.col(_KIND) == 1).select(
        key,
        *order,
        "n",
        added.alias("added"),
        shown("time").alias(f"latest_{time}"),
        *[shown(c).alias(f"latest_{c}") for c in columns],
    )


def _rank_of(df: DataFrame, entry: Column, name: str) -> Column:
    """The rank of an entry's arrival, by the type that the column has in ``df``."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return -F.unix_micros(entry[name])
    return -entry[name]


def _openings(
    rows: DataFrame, cuts: DataFrame | None, pieces: list[DataFrame], key: str, limit: int
) -> DataFrame | None:
    """What came before each range: count, newest report, largest distinct times."""
    marks = [p.select(key, F.lit(0).alias(_RANGE)) for p in pieces]
    if cuts is not None:
        cut = range_numbers(cuts, key, _RANGE)
        marks.append(cut)
        named = cut.select(F.col(key).alias("__key"), F.col(_RANGE).alias("__number"))
        of_cut = rows.join(
            F.broadcast(named), F.col(key).eqNullSafe(F.col("__key")) & (F.col(_RANGE) == F.col("__number"))
        ).drop("__key", "__number")
        newest = Window.partitionBy(key, _RANGE).orderBy(F.desc("__time"))
        times = (
            of_cut.select(key, _RANGE, "__time")
            .distinct()
            .withColumn("__age", F.row_number().over(newest))
            .where(F.col("__age") <= limit)
            .groupBy(F.col(key).alias("__key"), F.col(_RANGE).alias("__number"))
            .agg(F.collect_list("__time").alias(_TOPS))
        )
        sums = of_cut.groupBy(key, _RANGE).agg(F.sum(_N).alias(_N), F.max(_REPORT).alias(_REPORT))
        met = sums.join(
            times, F.col(key).eqNullSafe(F.col("__key")) & (F.col(_RANGE) == F.col("__number")), "left"
        )
        pieces = [*pieces, met.select(key, _RANGE, _N, _TOPS, _REPORT)]
    if not pieces:
        return None
    both = pieces[0]
    for piece in pieces[1:]:
        both = both.union(piece)
    asked = marks[0]
    for mark in marks[1:]:
        asked = asked.union(mark)
    both = both.withColumn("__asked", F.lit(False)).unionByName(
        asked.distinct().withColumn("__asked", F.lit(True)), allowMissingColumns=True
    )
    # At the same number, a range is asked about before its own sums are seen.
    so_far = (
        Window.partitionBy(key)
        .orderBy(_RANGE, F.desc("__asked"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    largest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(_TOPS).over(so_far))), False), 1, max(limit, 1))
    summed = both.select(
        key,
        _RANGE,
        "__asked",
        F.coalesce(F.sum(_N).over(so_far), F.lit(0).cast("long")).alias(_N),
        largest.alias(_TOPS),
        F.max(_REPORT).over(so_far).alias(_REPORT),
    )
    return summed.where("__asked").drop("__asked")
