"""Finding earlier records by signature, by content, and by stored path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LINUX_MAX_LINKS, LINUX_MIN_BYTES, RECORD, SIGNATURE
from ..session import stage
from .skew import HOT_ROWS, attach, bucket, count_rows, cut_to, rank_snapshots

HEX = "0123456789abcdef"
BLOB_ORDER = ["newest", "oldest"]


def scan_manifest(
    manifest: DataFrame,
    snapshot: str | None = None,
    source: str | None = None,
    size: int | None = None,
    mtime_ns: int | None = None,
    hash: str | None = None,
    file: str | None = None,
) -> DataFrame:
    """Rows equal to every given value; an argument left out does not constrain."""
    wanted = {
        "snapshot": snapshot,
        "source": source,
        "size": size,
        "mtime_ns": mtime_ns,
        "hash": hash,
        "file": file,
    }
    for column, value in wanted.items():
        if value is not None:
            manifest = manifest.where(F.col(column) == F.lit(value))
    return manifest


def hash_is_set(hash: Column) -> Column:
    """Whether a value stands for content at all; null, empty and anything but a SHA-256 don't."""
    return F.coalesce(hash.rlike("^[0-9a-f]{64}$"), F.lit(False))


def mirrored(hash: Column) -> Column:
    """Hex digits swapped end for end, so that the largest mirrored hash is the smallest hash."""
    return F.translate(hash, HEX, HEX[::-1])


def blob_name(manifest: DataFrame) -> Column:
    """The blob of a row; a row without one is a blob of its own."""
    if "file" not in manifest.columns:
        return F.col("blob_id")
    own = F.concat_ws("/", F.col("snapshot"), F.col("file"))
    return F.coalesce("blob_id", own) if "blob_id" in manifest.columns else own


def newest_per_signature(manifest: DataFrame, with_blob: bool = False, by: list[str] | None = None) -> DataFrame:
    """One line per signature: the newest snapshot holding it and its smallest hash there.

    ``with_blob`` adds ``prior_blob``, the blob of that record, the last one by name if it has several;
    ``by`` gives a line per signature and these columns. A plain max() with map-side combining; no group
    is ever gathered in a window.
    """
    groups = [*SIGNATURE, *(by or [])]
    usable = hash_is_set(F.col("hash"))
    blob = [blob_name(manifest).alias("blob")] if with_blob else []
    top = F.max(F.struct("snapshot", mirrored(F.col("hash")).alias("m"), *blob)).alias("top")
    found = manifest.where(usable).groupBy(*groups).agg(top)
    return found.select(
        *groups,
        mirrored(F.col("top.m")).alias("prior_hash"),
        F.col("top.snapshot").alias("prior_snapshot"),
        *[F.col("top.blob").alias("prior_blob") for _ in blob],
    )


def signature_lookup(
    files: DataFrame,
    manifest: DataFrame,
    unique_files: bool = False,
    hot_rows: int = HOT_ROWS,
    with_blob: bool = False,
) -> DataFrame:
    """Add ``prior_hash`` and ``prior_snapshot`` of the newest record with the same signature.

    ``with_blob`` adds that record's ``prior_blob``. ``unique_files`` says that no signature repeats in ``files`` (true for a listing, where every
    path occurs once); the join then needs no care for repeated keys.
    """
    # Counted, cut to, and joined: computed once.
    files = stage(files, "files")
    manifest = cut_to(manifest, files, SIGNATURE)
    newest = newest_per_signature(manifest, with_blob)
    if unique_files:
        added = [c for c in newest.columns if c not in SIGNATURE]
        return files.join(newest, SIGNATURE, "left").select(*files.columns, *added)
    wanted = count_rows(files, SIGNATURE, "_n").join(newest, SIGNATURE)
    return attach(files, wanted, SIGNATURE, ["file"], "_n", hot_rows)


def incremental_skip(files: DataFrame, manifest: DataFrame, **lookup) -> DataFrame:
    """Rows whose signature is already stored."""
    found = signature_lookup(files, manifest, **lookup)
    return found.where(F.col("prior_hash").isNotNull()).select(*files.columns)


def signature_conflicts(files: DataFrame, manifest: DataFrame, **lookup) -> DataFrame:
    """Rows whose signature is stored with another hash."""
    found = signature_lookup(files, manifest, **lookup)
    return found.where(F.col("prior_hash") != F.col("hash"))


def blobs(
    manifest: DataFrame,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
) -> DataFrame:
    """One line per stored blob: hash, blob_id, newest and oldest snapshot, present, spare links.

    Rows without a ``blob_id`` count as blobs of their own. With ``stored`` (snapshot, file, nlink)
    links are taken from the file system, and a blob none of whose files is left is not present.
    Rows with ``n_links`` stand for that many rows of a snapshot and blob (see ``Repository.summary``).
    """
    counted = "n_links" in manifest.columns
    rows = manifest.where(hash_is_set(F.col("hash"))).select(
        "hash",
        blob_name(manifest).alias("blob_id"),
        "snapshot",
        "size",
        *[F.col(c) for c in ("file", "n_links") if c in manifest.columns],
    )
    here, links = F.lit(True), F.sum("n_links") if counted else F.count(F.lit(1))
    if stored is not None:
        found = stored.select("snapshot", "file", F.lit(True).alias("here"), "nlink")
        rows = rows.join(found, ["snapshot", "file"], "left")
        here = F.coalesce("here", F.lit(False))
        links = F.coalesce(F.max("nlink"), F.count_if(here))
    per_blob = rows.groupBy("hash", "blob_id").agg(
        F.max("snapshot").alias("newest"),
        F.min("snapshot").alias("oldest"),
        F.max("size").alias("blob_size"),
        F.max(here).alias("present"),
        links.alias("links"),
    )
    room = F.greatest(F.lit(max_links) - F.col("links"), F.lit(0))
    linkable = F.col("present") & (F.col("blob_size") >= min_bytes)
    return per_blob.withColumn("spare", F.when(linkable, room).otherwise(F.lit(0)).cast("long"))


def content_capacity(per_blob: DataFrame) -> DataFrame:
    """One line per hash: its spare links, the newest blob with room, and the oldest blob."""
    in_order = F.struct(*BLOB_ORDER, bucket("blob_id").alias("bucket"), "blob_id", "spare")
    return per_blob.groupBy("hash").agg(
        F.sum("spare").alias("spare"),
        F.max("present").alias("present"),
        F.max(F.when(F.col("spare") > 0, in_order)).alias("room"),
        F.count_if(F.col("spare") > 0).alias("n_room"),
        F.max(F.struct("newest", "blob_id")).alias("newest_blob"),
        F.min(F.struct("oldest", "blob_id")).alias("oldest_blob"),
    )


def content_lookup(
    files: DataFrame,
    manifest: DataFrame,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the blob with the same hash (newest that can be linked, else the oldest) and ``linkable``."""
    capacity = content_capacity(blobs(manifest, max_links, min_bytes, stored))
    wanted = count_rows(files, ["hash"], "_n").join(capacity, "hash")
    found = attach(files, wanted, ["hash"], ["file"], "_n", hot_rows)
    small = F.col("size") < min_bytes
    blob = (
        F.when(small, F.col("newest_blob.blob_id"))
        .when(F.col("room").isNotNull(), F.col("room.blob_id"))
        .otherwise(F.col("oldest_blob.blob_id"))
    )
    linkable = ~small & F.col("room").isNotNull()
    return found.select(
        *files.columns,
        blob.alias("found_blob"),
        F.when(blob.isNotNull(), linkable).alias("linkable"),
    )


def missing_files(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows whose stored file is gone."""
    there = inventory.select("snapshot", "file")
    return manifest.join(there, ["snapshot", "file"], "left_anti").select(*manifest.columns)


def delete_rows(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """``manifest`` without the given rows, matched on snapshot and all five record columns.

    A null in ``rows`` matches nothing, so an incomplete row can never widen a delete.
    """
    key = ["snapshot", *RECORD]
    return manifest.join(rows.select(*key), key, "left_anti").select(*manifest.columns)


def unstable_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size or time changed between listing and hashing, with the new values."""
    now = after.select(
        "path", F.col("size").alias("now_size"), F.col("mtime_ns").alias("now_mtime_ns")
    )
    changed = (F.col("size") != F.col("now_size")) | (F.col("mtime_ns") != F.col("now_mtime_ns"))
    return before.join(now, "path").where(changed).select(*before.columns, "now_size", "now_mtime_ns")


def target_standing(
    manifest: DataFrame, targets: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of the targets with ``stays``: whether the row is the last place of its content.

    Targets are taken in order and each leaves the search set when its turn comes, so a row goes
    exactly when its hash occurs in a later target or in a snapshot that is no target.
    """
    ranked = rank_snapshots(manifest, targets, "rank")
    in_target = F.col("rank").isNotNull()
    rank = F.coalesce("rank", F.lit(len(targets)))
    per_hash = (
        ranked.where(hash_is_set(F.col("hash")))
        .groupBy("hash")
        .agg(F.max(rank).alias("top_rank"), F.count_if(in_target).alias("_n"))
        .where("_n > 0")
    )
    found = attach(ranked.where(in_target), per_hash, ["hash"], ["snapshot", "file"], "_n", hot_rows)
    stays = F.coalesce(F.col("rank") >= F.col("top_rank"), F.lit(True))
    return found.select(*manifest.columns, stays.alias("stays"))


def shared_content(manifest: DataFrame, targets: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the targets whose content stays in another snapshot."""
    return target_standing(manifest, targets, hot_rows).where("not stays").drop("stays")
