"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_ROWS = 1000

# The characters that part words, and a word as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the rows of an Arrow batch: texts fill a batch of the usual size too far.

    The setting is the session's and is only ever lowered.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(column, F.lit("")), F.lit(WORD)).cast("long")


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` carries it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few_lines(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most that many lines; reads no further than that."""
    return len(df.select(F.lit(1)).take(most + 1)) <= most


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of the whole row, but for maps, which have no order."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under these names."""
    lowered = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered])


def running_sums(
    df: DataFrame, order: str, values: list[str], descending: bool = False, block: int = 4096
) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over the rows before a row in the order of ``order``.

    ``order`` is a whole number that no two rows share. Sums are taken inside blocks of the number
    range and shifted by the sums of the earlier blocks, so a task holds one block, or one line per
    block.
    """
    place = spare(df, "block")
    rows = df.withColumn(place, F.expr(f"`{order}` div {block}"))
    way = lambda c: F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc()
    earlier = lambda w, c: F.coalesce(
        F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sums = rows.groupBy(place).agg(*[F.sum(f"`{v}`").alias(f"_sum_{v}") for v in values])
    across = Window.orderBy(way(place))
    shifts = sums.select(place, *[earlier(across, f"_sum_{v}").alias(f"_shift_{v}") for v in values])
    inside = Window.partitionBy(place).orderBy(way(order))
    local = rows.select("*", *[earlier(inside, f"`{v}`").alias(f"_local_{v}") for v in values])
    joined = local.join(shifts, place)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_shift_{v}") + F.col(f"_local_{v}")).alias(f"before_{v}") for v in values],
    )
