"""Checks of a repository: physical files, hashes and signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RECORD, SIGNATURE
from .filters import bad_rows
from .skew import HOT_ROWS, attach, rank_snapshots

Hasher = Callable[[DataFrame], DataFrame]


PHYSICAL = ["device", "inode"]


def placed(linked: DataFrame, snapshots: list[str] | None) -> DataFrame:
    """Readable rows with ``place``: that of the snapshot in the given list, or its name."""
    rows = linked.where("inode is not null")
    if snapshots is None:
        return rows.withColumn("place", F.col("snapshot"))
    return rank_snapshots(rows, snapshots, "place")


def first_record() -> Column:
    return F.min(F.struct("place", "file", "snapshot", "hash", *SIGNATURE))


def link_inventory(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest rows with the physical id of their stored file; null where it cannot be read.

    ``device`` joins the id when the inventory has it, as inode numbers repeat between devices.
    """
    device = F.col("device") if "device" in inventory.columns else F.lit(None)
    there = inventory.select("snapshot", "file", "inode", device.cast("long").alias("device"))
    linked = manifest.join(there, ["snapshot", "file"], "left")
    return linked.withColumn("device", F.coalesce("device", F.lit(0)))


def unreadable_index(linked: DataFrame) -> DataFrame:
    return linked.where("inode is null")


def representatives(linked: DataFrame, snapshots: list[str] | None = None) -> DataFrame:
    """The first row of each physical file, in snapshot order and then by file, and ``refs``."""
    return (
        placed(linked, snapshots)
        .groupBy(*PHYSICAL)
        .agg(first_record().alias("r"), F.count(F.lit(1)).alias("refs"))
        .select(*PHYSICAL, "refs", "r.snapshot", "r.file", "r.hash", *[f"r.{c}" for c in SIGNATURE])
    )


def reference_counts(linked: DataFrame, snapshots: list[str] | None = None) -> DataFrame:
    """One line per physical file: ``links``, a map of the snapshots that hold it to their rows, and ``first``.

    A file's map has as many entries as it has snapshots, whatever the number of all snapshots.
    """
    rows = placed(linked, snapshots)
    per_snapshot = rows.groupBy(*PHYSICAL, "snapshot").agg(F.count(F.lit(1)).alias("n"), first_record().alias("r"))
    # a list leaves out what is null, here rows without a snapshot
    entry = F.when(F.col("snapshot").isNotNull(), F.struct("snapshot", "n"))
    return per_snapshot.groupBy(*PHYSICAL).agg(
        F.map_from_entries(F.collect_list(entry)).alias("links"), F.min("r").alias("first")
    )


def file_table(
    linked: DataFrame, names: list[str], snapshots: list[str] | None = None
) -> DataFrame:
    """One line per physical file: links per snapshot in ``names``, and its first record.

    The columns are taken out of ``reference_counts`` at the end, for a report.
    """
    counts = reference_counts(linked, snapshots)
    table = counts.select(
        "inode", F.col("first").alias("r"), *[F.coalesce(F.try_element_at("links", F.lit(n)), F.lit(0)).alias(n) for n in names]
    )
    return table.select(
        F.col("inode").alias("file_index"),
        *[F.col(f"`{n}`") for n in names],
        "r.size",
        "r.mtime_ns",
        "r.hash",
        F.concat_ws("/", "r.snapshot", "r.file").alias("first_path"),
        F.col("r.source").alias("first_source"),
    )


def rehash(reps: DataFrame, hasher: Hasher) -> DataFrame:
    """Representatives with ``found_hash``: the hash of the content, ``ERROR`` if unreadable."""
    return hasher(reps).withColumn("found_hash", F.coalesce("content_hash", F.lit("ERROR"))).drop("content_hash")


def rehash_mismatch(rehashed: DataFrame) -> DataFrame:
    """Physical files whose content does not have the recorded hash."""
    return rehashed.where(F.col("found_hash") != F.col("hash"))


def hash_consistency(linked: DataFrame, reps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Later rows of a physical file whose hash differs from the file's, with ``first_hash``.

    ``reps`` are representatives, or rehashed ones: then rows are compared with the found hash.
    """
    expected = F.col("found_hash") if "found_hash" in reps.columns else F.col("hash")
    per_file = reps.select(
        "device",
        "inode",
        "refs",
        expected.alias("first_hash"),
        F.col("snapshot").alias("first_snapshot"),
        F.col("file").alias("first_file"),
    ).where("refs > 1")
    rows = linked.where("inode is not null")
    found = attach(rows, per_file, ["device", "inode"], ["snapshot", "file"], "refs", hot_rows)
    itself = (F.col("snapshot") == F.col("first_snapshot")) & (F.col("file") == F.col("first_file"))
    return found.where(~itself & (F.col("hash") != F.col("first_hash"))).drop("first_snapshot", "first_file")


def signature_uniqueness(reps: DataFrame) -> DataFrame:
    """Signatures that representatives carry with more than one hash."""
    return (
        reps.groupBy(*SIGNATURE)
        .agg(
            F.count_distinct("hash").alias("hashes"),
            F.min("hash").alias("min_hash"),
            F.max("hash").alias("max_hash"),
        )
        .where("hashes > 1")
    )


def signature_pairs(reps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One line for each further hash of a signature, set against the one with the smallest hash."""
    path = F.struct("snapshot", "file")
    per_hash = reps.groupBy(*SIGNATURE, "hash").agg(F.min(path).alias("at"))
    first = F.min(F.struct("hash", "at"))
    anchors = (
        per_hash.groupBy(*SIGNATURE)
        .agg(F.count(F.lit(1)).alias("hashes"), first.alias("anchor"))
        .where("hashes > 1")
    )
    found = attach(per_hash, anchors, SIGNATURE, ["hash"], "hashes", hot_rows)
    return found.where(F.col("hash") != F.col("anchor.hash")).select(
        *SIGNATURE,
        "hash",
        "at.snapshot",
        "at.file",
        F.col("anchor.hash").alias("other_hash"),
        F.concat_ws("/", "anchor.at.snapshot", "anchor.at.file").alias("other_path"),
    )


def manifest_integrity(manifest: DataFrame) -> DataFrame:
    """Problems (snapshot, file, problem): values not set, and records that repeat."""
    bad = bad_rows(manifest).select("snapshot", "file", "problem")
    key = ["snapshot", *RECORD]
    repeated = manifest.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return bad.unionByName(repeated.select("snapshot", "file", F.lit("repeated").alias("problem")))
