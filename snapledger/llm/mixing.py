"""Mixing sources to target weights by weighted fair queueing.

Inside a source the documents are shuffled by a seeded hash. Repeats follow in the same order, so
copies of a document lie as far apart as they can. A copy's virtual finish time is the number of
tokens its source has given up to and with it, divided by the source's weight. Merging the sources
by finish time gives every source its weight's part at any point of the mix; the mix ends at the
virtual time at which the budget is used up. A source stops after ``max_repeats`` passes, and the
others go on at their weights, which is the same as sharing the excess among them by weight.

The end of the mix follows from one line per source, so no task sees all documents. A document at
the end is taken if at least half of it lies before the end.

No source is gathered: running totals are taken inside ``PARTS`` hash ranges of a source and
shifted by the totals of the ranges before. Equal seeds and rows give equal mixes.

Defined results: a null source is a source of its own, placed last; a null or negative size counts
as 0; a document of size 0 is taken with its neighbours in the order, and adds nothing; repeated
rows are documents of their own; an empty table, or one in which all sizes are 0, has targets of 0.
Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import row_hash, without

PARTS_DIGITS = 12
PARTS = 1 << PARTS_DIGITS
RESULTS = ("size", "source_size", "weight", "target", "copies", "finish", "epoch")
INNER = ("_source", "_size", "_order", "_part", "_tie")


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code-point order; ``budget`` is a part of all tokens."""

    weights: tuple[float, ...] = (5, 2, 1)
    max_repeats: int = 3
    budget: float = 1.0
    seed: int = 7


def find_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Add weight, target and end of the mix to a table with one line per source.

    ``sizes`` has ``_source`` and ``source_size``. Sources that reach their cap first come first;
    the end is set by the first source that, with all after it, can use up what the earlier leave.
    """
    cap = F.col("source_size") * mix.max_repeats
    place = F.row_number().over(Window.orderBy("_source")) - 1
    choices = F.array(*[F.lit(float(w)) for w in mix.weights])
    weighted = sizes.withColumn("weight", F.get(choices, place % len(mix.weights)))
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("_source"))
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * F.lit(mix.budget)
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    levelled = (
        weighted.withColumn("_level", level)
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_fits", F.col("_level") <= cap / F.col("weight"))
    )
    # Without a source that fits, all caps together stay below the budget.
    end = F.min(F.when(F.col("_fits"), F.struct("_place", "_level"))).over(whole)["_level"]
    target = F.least(cap.cast("double"), F.coalesce(end * F.col("weight"), cap.cast("double")))
    return levelled.withColumn("target", target).drop("_level", "_place", "_fits")


def schedule(df: DataFrame, mix: Mix, key: str, source: str, size: Column) -> DataFrame:
    """Add source_size, weight, target, copies and the finish times of the copies to every row."""
    name = F.col(f"`{source}`")
    # The first character keeps a null source apart from all names, and last.
    marked = F.when(name.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), name.cast("string")))
    kept = [c for c in df.columns if c.lower() not in RESULTS]
    rows = (
        df.withColumn("_size", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long"))
        .withColumn("_source", marked)
        .withColumn("_order", F.xxhash64(F.lit(mix.seed), F.col(f"`{key}`")))
        .withColumn("_part", F.shiftrightunsigned("_order", 64 - PARTS_DIGITS))
        .withColumn("_tie", row_hash(df))
    )
    rows = without(rows, *RESULTS)
    # A line per source and part, staged so that sizes are computed for it once.
    parts = stage(rows.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum")), "parts")
    sizes = parts.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    targets = find_targets(sizes, mix)
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
        .join(targets, "_source")
    )
    inside = (
        Window.partitionBy("_source", "_part")
        .orderBy("_order", f"`{key}`", "_size", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    passes = F.array(*[F.lit(e) for e in range(mix.max_repeats)])
    reached = lambda e: e * F.col("source_size") + F.col("_reached")
    taken = F.filter(passes, lambda e: reached(e) - F.col("_size") / 2 <= F.col("target"))
    return (
        rows.withColumn("_within", F.sum("_size").over(inside))
        .join(offsets, ["_source", "_part"])
        .withColumn("_reached", F.col("_before") + F.col("_within"))
        .withColumn("finish", F.transform(taken, lambda e: reached(e) / F.col("weight")))
        .select(
            *[F.col(f"`{c}`") for c in kept if c not in INNER],
            F.col("_size").alias("size"),
            "source_size",
            "weight",
            "target",
            F.size("finish").alias("copies"),
            "finish",
        )
    )


def mix_rows(df: DataFrame, mix: Mix, key: str, source: str, size: Column) -> DataFrame:
    """The mix itself: a row per copy, sorted by finish time over all partitions."""
    planned = schedule(df, mix, key, source, size)
    copies = planned.select(
        *[F.col(f"`{c}`") for c in planned.columns if c != "finish"],
        F.posexplode("finish").alias("epoch", "finish"),
    )
    return copies.orderBy("finish", f"`{key}`", "epoch", row_hash(df))
