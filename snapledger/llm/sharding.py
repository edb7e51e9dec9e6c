"""Two-pass external shuffle into shards.

The first pass scatters whole records into buckets by a seeded hash of their key; there are as many
buckets as keep one at ``bucket_bytes`` of text on average, so a bucket fits in memory. Keys whose
texts alone are more than that, of which there are fewer than buckets, are scattered by a hash of the
whole record. The second pass puts each bucket into the order of the keys, then of texts and whole records, shuffles it by Fisher-Yates with a generator
seeded by the bucket, and writes it. Buckets follow each other, which places every record in one
random order of all records; equal cuts of that order are the shards, so their row counts differ by
one at most, and a record's slot is its place in its shard.

Counting the buckets reads only the key column; records move once. A lost executor repeats its
buckets with the same outcome, as the order and the seed don't depend on how rows arrive.

Defined results: null keys hash like any value and share a bucket with their texts' hashes apart;
a null text weighs nothing; repeated rows are kept, each with a place of its own (records equal in all
share a bucket, as there is nothing to tell them apart by); an empty table
gives no shards; columns of the input named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import row_hash, running_sums, spare, without


@dataclass(frozen=True)
class Shuffle:
    shards: int = 16
    bucket_bytes: int = 8 << 20
    seed: int = 11


def bucket_shuffle(
    bucket: str, offset: str, tie: str, key: str, text: str, total: int, shuffle: Shuffle
) -> Callable[[pa.Table], pa.Table]:
    """The second pass over one bucket: canonical order, Fisher-Yates, places."""

    def run(rows: pa.Table) -> pa.Table:
        number, first = rows[bucket][0].as_py(), rows[offset][0].as_py()
        rows = rows.drop_columns([bucket, offset])
        rows = rows.take(rows_in_order(rows, key, text, tie)).drop_columns([tie])
        rng = np.random.default_rng([shuffle.seed, number])
        order = np.arange(rows.num_rows)
        rng.shuffle(order)  # Fisher-Yates
        place = first + np.arange(rows.num_rows, dtype=np.int64)
        shard = (place * shuffle.shards + shuffle.shards - 1) // total
        slot = place - shard * total // shuffle.shards
        return (
            rows.take(pa.array(order))
            .append_column("shard", pa.array(shard.astype(np.int32)))
            .append_column("slot", pa.array(slot))
        )

    return run


def rows_in_order(rows: pa.Table, key: str, text: str, tie: str) -> pa.Array:
    import pyarrow.compute as pc

    return pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in (key, text, tie)])


def large_keys(df: DataFrame, key: str, text: str, bucket_bytes: int) -> DataFrame:
    """(key) of those keys whose texts don't fit in a bucket; fewer lines than there are buckets."""
    size = F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long") + 1
    per_key = df.groupBy(F.col(f"`{key}`").alias("_large")).agg(F.sum(size).alias("_bytes"))
    return per_key.where((F.col("_bytes") > bucket_bytes) & F.col("_large").isNotNull()).select("_large")


def scatter(key: str, text: str, buckets: int, seed: int) -> Column:
    """A bucket by key alone, or by text where a row has no key."""
    value = F.coalesce(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), F.lit(0))
    keyless = F.xxhash64(F.lit(seed), F.col(f"`{text}`"))
    return F.pmod(F.when(F.col(f"`{key}`").isNull(), keyless).otherwise(value), F.lit(buckets)).cast("long")


def shuffle_records(
    df: DataFrame, shuffle: Shuffle, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every record with its ``shard`` and ``slot``."""
    df = without(df, "shard", "slot")
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(f"`{text}`")), F.lit(0)).alias("bytes"),
    ).first()
    buckets = max(1, -(-stats["bytes"] // shuffle.bucket_bytes))
    bucket, offset = spare(df, "bucket"), spare(df, "offset")
    tie = spare(df, "tie")
    placed = df.withColumn(bucket, scatter(key, text, buckets, shuffle.seed)).withColumn(tie, row_hash(df, shuffle.seed))
    large = stage(large_keys(df, key, text, shuffle.bucket_bytes), "large")
    if not large.isEmpty():
        # Their texts are more than a bucket each, so there are fewer of them than buckets.
        known = placed.join(F.broadcast(large), F.col(f"`{key}`") == F.col("_large"), "left")
        spread = F.pmod(F.col(tie), F.lit(buckets)).cast("long")
        wide = F.col("_large").isNotNull()
        placed = known.withColumn(bucket, F.when(wide, spread).otherwise(F.col(bucket))).drop("_large")
    counts = placed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    offsets = running_sums(counts, bucket, ["n"]).select(bucket, F.col("before_n").alias(offset))
    schema = T.StructType(
        [*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    run = bucket_shuffle(bucket, offset, tie, key, text, max(1, stats["n"]), shuffle)
    return placed.join(offsets, bucket).groupBy(bucket).applyInArrow(run, schema)


def write_shards(df: DataFrame, path: str, shuffle: Shuffle, key: str = "doc_id") -> DataFrame:
    """Shuffle, write a folder per shard, and return what was written."""
    shuffled = shuffle_records(df, shuffle, key)
    shuffled.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(shuffled.schema).parquet(path)
