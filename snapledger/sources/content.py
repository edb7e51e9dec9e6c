"""SHA-256 of content, held in a table or in files on a mount shared by all executors."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sha256_hex
from ..operators.skew import cut_to
from ..schemas import UNSTABLE
from ..session import stage

CHUNK_BYTES = 1 << 20
TASK_BYTES = 1 << 30
PACK_BUCKETS = 4096
READ_TRIES = 3
READ_WAIT = 0.2
STEADY, UNREADABLE = "steady", "unreadable"


def hash_column(content: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, content_hash) computed where the content is scanned; only the hash goes further."""
    return content.select(key, sha256_hex(value).alias("content_hash"))


def table_hasher(hashes: DataFrame, key: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A hasher that takes ``content_hash`` from a table with one line per ``key``.

    If only few rows are wanted, the content table is cut down to them before anything is hashed;
    otherwise content is hashed where it is scanned and only keys and hashes are shuffled.
    """
    def hasher(rows: DataFrame) -> DataFrame:
        found = cut_to(hashes.select(*key, "content_hash"), rows, key)
        return rows.join(found, key, "left").select(*rows.columns, "content_hash")

    return hasher


def read_stable(path: str, tries: int = READ_TRIES, wait: float = READ_WAIT) -> tuple[str | None, int | None, int | None, str]:
    """(hash, size, mtime_ns, state) of a file that doesn't change while it is read.

    The file is looked at before its bytes and after them, both as it was opened and as it is found by
    its path, which may name another file by then. If anything differs it is read again, up to
    ``tries`` times with a growing pause. The state is ``steady``, ``unstable`` (no reading went
    undisturbed; without a hash, with the size and time last seen) or ``unreadable``.
    """
    seen = None
    for attempt in range(tries):
        if attempt:
            time.sleep(wait * attempt)
        try:
            digest, length = hashlib.sha256(), 0
            with open(path, "rb") as handle:
                before = _look(os.fstat(handle.fileno()))
                while chunk := handle.read(CHUNK_BYTES):
                    digest.update(chunk)
                    length += len(chunk)
                after = _look(os.fstat(handle.fileno()))
            seen = _look(os.stat(path))
        except OSError:
            return None, None, None, UNREADABLE
        if before == after == seen and length == seen[0]:
            return digest.hexdigest(), seen[0], seen[1], STEADY
    return None, seen[0], seen[1], UNSTABLE


def _look(state: os.stat_result) -> tuple[int, int, int, int]:
    return state.st_size, state.st_mtime_ns, state.st_dev, state.st_ino


def pack_by_bytes(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` with ``_part``, such that the files of a part have few more bytes than ``task_bytes``.

    Files of half a task or more get a part of their own. The others are put in an order by hash and
    cut where the sum of their sizes passes a multiple of ``task_bytes``, so a part has less than half
    a task more than that. Sums run inside ``PACK_BUCKETS`` buckets of hashes, shifted by the sums of
    the earlier buckets. Rows without a size weigh nothing.
    """
    size = F.coalesce(F.greatest(F.col("size").cast("long"), F.lit(0)), F.lit(0))
    whole = size >= (task_bytes + 1) // 2
    number = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumns(
        {
            "_hash": number,
            "_bucket": F.pmod(number, F.lit(PACK_BUCKETS)),
            "_whole": whole.cast("long"),
            "_bytes": F.when(whole, 0).otherwise(size),
        }
    )
    sums = dealt.groupBy("_bucket").agg(F.sum("_whole").alias("w"), F.sum("_bytes").alias("b"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    shifts = sums.select(
        "_bucket",
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("_w"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("_b"),
        F.sum("w").over(every).alias("_all_whole"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    placed = dealt.withColumn("_w0", running("_whole")).withColumn("_b0", running("_bytes"))
    # PACK_BUCKETS lines at most.
    placed = placed.join(F.broadcast(shifts), "_bucket")
    small = F.col("_all_whole") + F.floor((F.col("_b") + F.col("_b0")) / task_bytes)
    part = F.when(F.col("_whole") == 1, F.col("_w") + F.col("_w0")).otherwise(small)
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], part.cast("int").alias("_part"))


def spread_by_bytes(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` in as many tasks as their ``size`` needs, each with about ``task_bytes`` of files.

    A file larger than that is a task of its own.
    """
    packed = stage(pack_by_bytes(rows, task_bytes), "packed")
    last = packed.agg(F.max("_part")).first()[0]
    return packed.repartitionById((last or 0) + 1, F.col("_part")).drop("_part")


def file_hasher(
    path: Column, task_bytes: int = TASK_BYTES, tries: int = READ_TRIES, wait: float = READ_WAIT
) -> Callable[[DataFrame], DataFrame]:
    """A hasher that reads each file in chunks, spread over tasks by ``size`` where given.

    Adds ``content_hash`` (null if the file cannot be read, or not undisturbed), the size and time the
    content has, as ``now_size`` and ``now_mtime_ns``, and ``read_state`` (see ``read_stable``).
    """
    def hasher(rows: DataFrame) -> DataFrame:
        names = rows.columns
        schema = T.StructType(
            [
                *rows.schema.fields,
                T.StructField("content_hash", T.StringType()),
                T.StructField("now_size", T.LongType()),
                T.StructField("now_mtime_ns", T.LongType()),
                T.StructField("read_state", T.StringType()),
            ]
        )

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [read_stable(p, tries, wait) for p in batch.pop("_open")]
                batch["content_hash"] = [f[0] for f in found]
                batch["now_size"] = pd.array([f[1] for f in found], dtype="Int64")
                batch["now_mtime_ns"] = pd.array([f[2] for f in found], dtype="Int64")
                batch["read_state"] = [f[3] for f in found]
                yield batch

        # nullable integers must not pass through pandas floats, which cut nanosecond times
        texts = [
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.LongType) else F.col(f.name)
            for f in rows.schema.fields
        ]
        as_text = T.StructType(
            [
                T.StructField(f.name, T.StringType()) if isinstance(f.dataType, T.LongType) and f.name in names else f
                for f in schema.fields
            ]
        )
        named = rows.select(*texts, path.alias("_open"))
        if "size" in names:
            named = spread_by_bytes(named, task_bytes)
        hashed = named.mapInPandas(read, as_text)
        return hashed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    return hasher
