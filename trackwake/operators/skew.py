"""Keys that hold more than their share of rows, and how to split them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

_ROWS = "__rows"
_SPLITS = "__splits"
_SPLIT = "__split"
_HOT = "__hot_key"
_CUTS = "__cuts"


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(df: DataFrame, key: str) -> dict:
    """Into how many pieces each key with over ``1/width`` of all rows should go.

    ``width`` is the number of shuffle partitions, so there are fewer than
    ``width`` such keys. One job over the key column counts keys and rows, and the
    driver reads the ``width`` most frequent keys. A null key is one of them.
    """
    width, seen = shuffle_width(df), Observation()
    counts = (
        df.select(key)
        .observe(seen, F.count(F.lit(1)).alias(_ROWS))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(_ROWS))
    )
    most = counts.orderBy(F.desc(_ROWS)).limit(width).collect()
    total = seen.get[_ROWS] if most else 0
    return {row[0]: -(-row[1] * width // total) for row in most if row[1] * width > total}


def _listed(df: DataFrame, key: str, rows: list, more: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"`{_HOT}` {kind}, {more}")


def join_per_key(
    many: DataFrame, one: DataFrame, key: str, how: str = "inner"
) -> DataFrame:
    """Join ``many`` (hot keys allowed) to ``one`` (a single row per key).

    Rows of a hot key are dealt over several pieces by a hash of what they hold,
    and the single row of that key is repeated once per piece. Every row of
    ``many`` meets its partner exactly once, whichever piece it is in.
    """
    width = shuffle_width(many)
    splits = _listed(many, key, list(frequent_keys(many, key).items()), f"{_SPLITS} int")
    found = F.coalesce(_SPLITS, F.lit(1))
    # Rows without a key have no partner and may go anywhere.
    pieces = F.when(F.col(key).isNull(), F.lit(width)).otherwise(found)
    own = F.col(key) == F.col(_HOT)
    dealt = (
        many.withColumn("__deal", F.xxhash64(*many.columns))
        .join(F.broadcast(splits), own, "left")
        .withColumn(_SPLIT, F.pmod("__deal", pieces).cast("int"))
        .drop(_SPLITS, _HOT, "__deal")
    )
    repeated = (
        one.join(F.broadcast(splits), own, "left")
        .withColumn(_SPLIT, F.explode(F.sequence(F.lit(0), found - 1)))
        .drop(_SPLITS, _HOT)
    )
    return dealt.join(repeated, [key, _SPLIT], how).drop(_SPLIT)


def range_cuts(df: DataFrame, key: str, by: str) -> DataFrame | None:
    """Where to cut the frequent keys into ranges of ``by`` with few rows each.

    One row per frequent key, in ``__hot_key``, with rising ``__cuts``: about
    as many as the key has shares, at equal row counts. None without such keys.
    Computed once, so every use of it sees the same cuts.
    """
    shares = frequent_keys(df, key)
    if not shares:
        return None
    width = shuffle_width(df)
    listed = _listed(df, key, list(shares.items()), f"{_SPLITS} int")
    times = (
        df.where(F.col(by).isNotNull())
        .join(F.broadcast(listed), F.col(key).eqNullSafe(F.col(_HOT)))
        .groupBy(_HOT)
        .agg(
            F.max(_SPLITS).alias(_SPLITS),
            F.percentile_approx(by, [k / width for k in range(1, width + 1)], 10_000).alias("at"),
        )
    )
    place = lambda i: F.get("at", F.ceil(i * width / F.col(_SPLITS)).cast("int") - 1)
    inner = F.when(
        F.col(_SPLITS) > 1, F.transform(F.sequence(F.lit(1), F.col(_SPLITS) - 1), place)
    )
    cuts = F.array_sort(F.array_distinct(F.coalesce(inner, F.slice("at", 1, 0))))
    rows = [(r[0], r[1]) for r in times.select(_HOT, cuts).collect()]
    kind = df.schema[by].dataType.simpleString()
    return _listed(df, key, rows, f"{_CUTS} array<{kind}>")


def no_cuts(df: DataFrame, key: str, by: str) -> DataFrame:
    """The form of ``range_cuts`` without a row."""
    return _listed(df, key, [], f"{_CUTS} array<{df.schema[by].dataType.simpleString()}>")


def numbered_range(
    df: DataFrame, cuts: DataFrame | None, key: str, by: str, out: str
) -> DataFrame:
    """Rows with the number of their range, 0 for keys that were not cut."""
    if cuts is None:
        return df.withColumn(out, F.lit(0))
    value: Column = F.col(by)
    number = F.size(F.filter(_CUTS, lambda cut: cut <= value))
    joined = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col(_HOT)), "left")
    return joined.withColumn(
        out, F.when(F.col(_CUTS).isNotNull(), number).otherwise(0)
    ).drop(_CUTS, _HOT)


def range_numbers(cuts: DataFrame, key: str, out: str) -> DataFrame:
    """One row for every range of every key that was cut."""
    numbers = F.explode(F.sequence(F.lit(0), F.size(_CUTS)))
    return cuts.select(F.col(_HOT).alias(key), numbers.alias(out))
