"""Joining and numbering that hold when one key carries a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
BUCKET_DIGITS = 3


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    spread: list[str],
    size: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join a table with one line per key onto ``rows``.

    ``size`` names the column of ``per_key`` with the number of rows that carry the key. Keys with
    more than ``hot_rows`` rows are joined by broadcast; there are at most count(rows) / hot_rows of
    them, so the broadcast is bounded whatever the data. Their rows, and rows with a null key, then
    spread over all partitions by the ``spread`` columns, so the shuffle of the remaining join has
    no large group.
    """
    values = [c for c in per_key.columns if c not in keys and c != size]
    is_hot = F.col("_size") > hot_rows
    packed = per_key.select(*keys, F.col(size).alias("_size"), F.struct(*values).alias("_cold"))
    hot = packed.where(is_hot).select(*keys, F.col("_cold").alias("_hot"))
    cold = packed.select(*keys, F.when(is_hot, -1).otherwise(0).alias("_lane"), "_cold")

    apart = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    lane = F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(1 << 30)).cast("int") + 1).otherwise(0)
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_lane", lane)
        .join(cold, [*keys, "_lane"], "left")
        .withColumn("_value", F.coalesce("_hot", "_cold"))
    )
    return joined.select(*rows.columns, *[F.col("_value")[v].alias(v) for v in values])


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has few enough lines to broadcast; reads no further than the limit."""
    return len(df.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS


def cut_to(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without lines that cannot match ``rows``, if those are few.

    A small run against a large table then shuffles only the lines it needs. With many rows the
    table is returned as it is.
    """
    if not is_small(rows):
        return table
    return table.join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")


def rank_snapshots(rows: DataFrame, names: list[str], rank: str) -> DataFrame:
    """Add the place of a row's snapshot in ``names``, from 0; null where it is not named.

    The names are an argument of the call, so the table of places is no larger than that.
    """
    spark = rows.sparkSession
    places = spark.createDataFrame(
        [(name, place) for place, name in enumerate(names)], f"snapshot string, {rank} int"
    )
    return rows.join(F.broadcast(places), "snapshot", "left").select(*rows.columns, rank)


def bucket(*columns: str) -> Column:
    """One of 16 ** BUCKET_DIGITS parts of a group, from the row's own text."""
    return F.substring(F.md5(F.concat_ws("/", *columns)), 1, BUCKET_DIGITS)


def count_rows(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def running_before(value: str, keys: list[str], order: list) -> Column:
    """Sum of ``value`` over the earlier lines of a key; for tables reduced to few lines per key."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(frame), F.lit(0))


def running_total(
    rows: DataFrame, keys: list[str], major: list[str], minor: str, value: str, name: str
) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the key, in descending order throughout.

    The order is ``major``, bucket of ``minor``, ``minor``. Sums are taken inside (key, major,
    bucket) and shifted by the totals of the earlier buckets of the same major, then by those of
    the earlier majors, so no key is gathered in one task.
    """
    place = [*keys, *major, "_bucket"]
    down = lambda columns: [F.col(c).desc() for c in columns]
    rows = rows.withColumn("_bucket", bucket(minor))
    sums = rows.groupBy(*place).agg(F.sum(value).alias("_sum"))
    majors = (
        sums.groupBy(*keys, *major)
        .agg(F.sum("_sum").alias("_total"))
        .withColumn("_earlier", running_before("_total", keys, down(major)))
        .drop("_total")
    )
    shift = (
        sums.withColumn("_inside", running_before("_sum", [*keys, *major], down(["_bucket"])))
        .join(majors, [*keys, *major])
        .withColumn("_before", F.col("_earlier") + F.col("_inside"))
        .drop("_sum", "_earlier", "_inside")
    )
    local = rows.withColumn("_local", running_before(value, place, [F.col(minor).desc()]))
    joined = local.join(shift, place).withColumn(name, F.col("_before") + F.col("_local"))
    return joined.drop("_bucket", "_before", "_local")
