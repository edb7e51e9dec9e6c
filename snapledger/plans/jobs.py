"""The five jobs as DataFrame functions: take a snapshot, verify, purge, distill, clone."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import full_path, is_overlong
from ..functions.text import snapshot_name
from ..operators.assign import assign_hashed
from ..operators.filters import exclude_kept, mark_excluded, route_by_type, target_path
from ..operators.lookup import (
    hash_is_set,
    newest_per_signature,
    signature_lookup,
    target_standing,
)
from ..operators.skew import HOT_ROWS, attach
from ..operators.verify import (
    Hasher,
    hash_consistency,
    link_inventory,
    manifest_integrity,
    rehash,
    rehash_mismatch,
    representatives,
    signature_pairs,
    unreadable_index,
)
from ..schemas import CONFLICT, FAILED, LINUX_MAX_LINKS, LINUX_MAX_PATH, LINUX_MIN_BYTES, MANIFEST, SIGNATURE, SKIP, STORED, UNSTABLE
from ..session import stage

INACCESSIBLE = "inaccessible"
ACTION_COLUMNS = [*MANIFEST.names, "action", "hashed"]


def walk(roots: DataFrame, inventory: DataFrame, excludes, snapshot: str) -> DataFrame:
    """Files to store (snapshot, source, size, mtime_ns, file, ...) from a listing."""
    files = route_by_type(exclude_kept(inventory, excludes)).where("route = 'file'")
    return target_path(roots, files).select(
        F.lit(snapshot).alias("snapshot"), F.col("path").alias("source"), "size", "mtime_ns", "file"
    )


def left_out(inventory: DataFrame, excludes) -> DataFrame:
    """Entries not stored (path, reason); an excluded subtree counts once."""
    marked = mark_excluded(inventory, excludes)
    hit = marked.where(F.col("excluded_by").isNotNull())
    by_suffix = hit.select("root", F.col("excluded_by").alias("path")).distinct()
    rest = route_by_type(marked.where(F.col("excluded_by").isNull()))
    by_type = rest.where(~F.col("route").isin("file", "directory"))
    return by_suffix.select("path", F.lit("suffix").alias("reason")).unionByName(
        by_type.select("path", F.col("route").alias("reason"))
    )


def take_snapshot(
    files: DataFrame,
    manifest: DataFrame,
    hasher: Hasher,
    run: str,
    incremental: bool = False,
    always_hash: bool = False,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    affinity: bool = False,
    contents: DataFrame | None = None,
) -> DataFrame:
    """Decide what happens to every file of a new snapshot.

    ``files`` (see ``walk``) has one line per path. Signatures are looked up first; ``hasher`` is
    given only rows without a known signature (all rows with ``always_hash``) and adds
    ``content_hash``, and may add ``now_size`` and ``now_mtime_ns`` if it saw the file change; such
    rows are looked up again with the new values. A file that changes whenever it is read, as a
    ``read_state`` of the hasher says, is ``unstable`` and left out. With ``affinity`` a file with a known signature
    links to the blob of the very record it was found in, as long as that has room, and only then to
    others of its content. ``manifest`` is searched for signatures and ``contents``, by default the same,
    for hashes; a repository's summaries will do. Returns the rows with ``action``, ``blob_id`` and ``hashed``; rows with an
    action in ``STORED`` are the new manifest rows.
    """
    base = ["snapshot", *SIGNATURE, "file"]
    prior = ["prior_hash", "prior_blob"] if affinity else ["prior_hash"]
    look = partial(signature_lookup, manifest=manifest, unique_files=True, with_blob=affinity)
    found = look(files.select(*base))
    looked = stage(found, "looked")
    readable = F.col("size").isNotNull() & F.col("mtime_ns").isNotNull()
    lost = looked.where(~readable)
    wanted = looked.where(readable if always_hash else readable & F.col("prior_hash").isNull())
    trusted = looked.where(F.lit(False) if always_hash else F.col("prior_hash").isNotNull())
    trusted = trusted.select(
        *base,
        *prior,
        F.col("prior_hash").alias("hash"),
        F.lit(False).alias("hashed"),
        F.lit(None).cast("string").alias("read_state"),
    )

    # content is not touched at all when every signature is known
    if wanted.isEmpty():
        rows = trusted
    else:
        fresh = stage(_hash_rows(wanted, look, hasher, [*base, *prior]), "hashed")
        rows = trusted.unionByName(fresh)

    broken = F.col("hashed") & F.col("prior_hash").isNotNull() & (F.col("prior_hash") != F.col("hash"))
    state = (
        F.when(F.col("read_state") == UNSTABLE, UNSTABLE)
        .when(~hash_is_set(F.col("hash")), FAILED)
        .when(broken, CONFLICT)
        .when(F.lit(incremental) & F.col("prior_hash").isNotNull(), SKIP)
    )
    judged = rows.withColumn("action", state).drop("read_state")
    closed = judged.where("action is not null").withColumn("blob_id", F.lit(None).cast("string"))
    open_rows = judged.where("action is null").drop("action", "prior_hash")
    held = manifest if contents is None else contents
    decided = assign_hashed(open_rows, held, run, max_links, min_bytes, stored, hot_rows)
    unread = lost.select(
        *base,
        F.lit(None).cast("string").alias("hash"),
        F.lit(None).cast("string").alias("blob_id"),
        F.lit(FAILED).alias("action"),
        F.lit(False).alias("hashed"),
    )
    return (
        decided.select(*ACTION_COLUMNS)
        .unionByName(closed.select(*ACTION_COLUMNS))
        .unionByName(unread.select(*ACTION_COLUMNS))
    )


def _hash_rows(
    wanted: DataFrame, look: Callable[[DataFrame], DataFrame], hasher: Hasher, columns: list[str]
) -> DataFrame:
    """Rows with the hash of their content, and the signature it was read with.

    Files that were disturbed as often as the hasher tried are read once more after all others; one
    that is disturbed even then keeps ``read_state`` ``UNSTABLE`` and has no hash.
    """
    found = hasher(wanted)
    if "now_size" in found.columns:
        found = _settle(found, look)
        disturbed = found.where(F.col("read_state") == UNSTABLE)
        if not disturbed.isEmpty():
            calm = found.where(~F.col("read_state").eqNullSafe(UNSTABLE))
            found = calm.unionByName(_settle(hasher(disturbed.drop("content_hash", "read_state")), look))
    state = F.col("read_state") if "read_state" in found.columns else F.lit(None).cast("string")
    return found.select(
        *columns,
        F.col("content_hash").alias("hash"),
        F.col("content_hash").isNotNull().alias("hashed"),
        state.alias("read_state"),
    )


def _settle(found: DataFrame, look: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows as read; those that no longer have their listed size and time are looked up again."""
    if "read_state" not in found.columns:
        found = found.withColumn("read_state", F.lit(None).cast("string"))
    found = stage(found, "read")
    changed = (F.col("now_size") != F.col("size")) | (F.col("now_mtime_ns") != F.col("mtime_ns"))
    changed = F.coalesce(changed, F.lit(False))
    steady = found.where(~changed).drop("now_size", "now_mtime_ns")
    moved = found.where(changed).select(
        "snapshot",
        "source",
        F.col("now_size").alias("size"),
        F.col("now_mtime_ns").alias("mtime_ns"),
        "file",
        "content_hash",
        "read_state",
    )
    return steady if moved.isEmpty() else stage(steady.unionByName(look(moved)), "settled")


def access_errors(excluded: DataFrame, snapshot: str) -> DataFrame:
    """Entries and directories (see ``left_out``) that could not be read, as events."""
    lost = excluded.where(F.col("reason") == INACCESSIBLE)
    return lost.select(
        F.lit(snapshot).alias("snapshot"), F.col("path").alias("file"), F.col("reason").alias("detail"), F.lit("error").alias("level")
    )


def run_events(actions: DataFrame, max_path: int = LINUX_MAX_PATH) -> DataFrame:
    """Errors and warnings (snapshot, file, detail, level) of a run: rows left out, long paths."""
    failed = actions.where(F.col("action").isin(CONFLICT, FAILED, UNSTABLE)).select(
        "snapshot", "file", F.col("action").alias("detail"), F.lit("error").alias("level")
    )
    path = full_path(F.col("snapshot"), F.col("file"))
    long = actions.where(is_overlong(path, max_path)).select(
        "snapshot", "file", F.lit("path is too long").alias("detail"), F.lit("warning").alias("level")
    )
    return failed.unionByName(long)


def stored_rows(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("action").isin(STORED)).select(*MANIFEST.names)


def clone(
    source: DataFrame,
    target: DataFrame,
    run: str,
    incremental: bool = False,
    suffix: str | None = None,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    affinity: bool = False,
    contents: DataFrame | None = None,
) -> DataFrame:
    """Decide what happens to every row of ``source`` when its snapshots are cloned into ``target``.

    All snapshots go in one pass. A signature stands for the hash the target has for it, else for
    that of its first row in (snapshot, file) order; rows with another hash are conflicts. With
    ``incremental`` only that first row is stored, and only if the target does not know it. Hashes
    are taken over, not computed. ``affinity`` as in ``take_snapshot``, for records the target has, as
    is ``contents``, the rows of the target that are searched for hashes.
    """
    prior = ["prior_blob"] if affinity else []
    rows = source.select("snapshot", *SIGNATURE, "hash", "file")
    place = F.struct("snapshot", "file", "hash")
    per_source = rows.groupBy(*SIGNATURE).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(hash_is_set(F.col("hash")), place)).alias("first")
    )
    per_signature = per_source.join(newest_per_signature(target, affinity), SIGNATURE, "left").select(
        *SIGNATURE, "_n", "first", F.col("prior_hash").alias("kept_hash"), *prior
    )
    found = attach(rows, per_signature, SIGNATURE, ["snapshot", "file"], "_n", hot_rows)
    canonical = F.coalesce("kept_hash", "first.hash")
    later = F.col("kept_hash").isNotNull() | (place != F.col("first"))
    state = (
        F.when(~hash_is_set(F.col("hash")), FAILED)
        .when(F.col("hash") != canonical, CONFLICT)
        .when(F.lit(incremental) & later, SKIP)
    )
    judged = stage(
        found.withColumn("action", state)
        .withColumn("snapshot", snapshot_name(F.col("snapshot"), suffix))
        .select(*rows.columns, *prior, "action"),
        "clone",
    )
    closed = judged.where("action is not null").withColumn("blob_id", F.lit(None).cast("string"))
    open_rows = judged.where("action is null").drop("action")
    held = target if contents is None else contents
    decided = assign_hashed(open_rows, held, run, max_links, min_bytes, stored, hot_rows)
    columns = [*MANIFEST.names, "action"]
    return decided.select(*columns).unionByName(closed.select(*columns))


def purge_standing(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows with ``stays``: whether the stored file is there."""
    there = inventory.select("snapshot", "file").distinct().withColumn("stays", F.lit(True))
    found = manifest.join(there, ["snapshot", "file"], "left")
    return found.select(*manifest.columns, F.coalesce("stays", F.lit(False)).alias("stays"))


def purge(manifest: DataFrame, inventory: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """``manifest`` without rows of the targets (all by default) whose stored file is gone."""
    if targets is None:
        return staying(purge_standing(manifest, inventory))
    rows = manifest.where(F.col("snapshot").isin(targets))
    return beyond(manifest, targets).unionByName(staying(purge_standing(rows, inventory)))


def staying(standing: DataFrame) -> DataFrame:
    return standing.where("stays").drop("stays")


def beyond(manifest: DataFrame, targets: list[str]) -> DataFrame:
    """Rows of no target; a row without a snapshot is one of them."""
    return manifest.where(~F.coalesce(F.col("snapshot").isin(targets), F.lit(False)))


def distill(manifest: DataFrame, targets: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``manifest`` with the targets, in order, reduced to content found nowhere else."""
    kept = staying(target_standing(manifest, targets, hot_rows))
    return beyond(manifest, targets).unionByName(kept)


def verify(
    manifest: DataFrame,
    inventory: DataFrame,
    hasher: Hasher | None = None,
    snapshots: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Problems (check, snapshot, file, detail, level) of the given manifest rows.

    With ``hasher`` one file per physical id is read again and rows are compared with what it holds.
    Snapshots with integrity problems take no part in the further checks.
    """
    def problems(rows: DataFrame, check: str, detail) -> DataFrame:
        return rows.select(
            F.lit(check).alias("check"), "snapshot", "file", detail.alias("detail"), F.lit("error").alias("level")
        )

    integrity = stage(manifest_integrity(manifest), "integrity")
    # at most one line per snapshot
    barred = F.broadcast(integrity.select("snapshot").distinct())
    linked = stage(link_inventory(manifest.join(barred, "snapshot", "left_anti"), inventory), "linked")
    lost = unreadable_index(linked)
    reps = stage(representatives(linked, snapshots), "reps")
    found = [
        problems(integrity, "integrity", F.col("problem")),
        problems(lost, "unreadable_index", full_path(F.col("snapshot"), F.col("file"))),
    ]
    if hasher is not None:
        reps = stage(rehash(reps, hasher), "rehashed")
        found.append(problems(rehash_mismatch(reps), "rehash_mismatch", F.col("found_hash")))
        found.append(problems(lost, "rehash_mismatch", F.lit("ERROR")))
    found.append(problems(hash_consistency(linked, reps, hot_rows), "hash_consistency", F.col("first_hash")))
    if hasher is not None:
        reps = reps.withColumn("hash", F.col("found_hash"))
    found.append(problems(signature_pairs(reps, hot_rows), "signature_uniqueness", F.col("other_path")))
    report = found[0]
    for part in found[1:]:
        report = report.unionByName(part)
    return report
