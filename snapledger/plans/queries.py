"""Every operator and job as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import filters, lookup, roots, stats, tree, verify
from ..operators.assign import assign_blobs
from ..schemas import (
    DELETE,
    LINUX_MAX_LINKS,
    LINUX_MIN_BYTES,
    WINDOWS_MAX_LINKS,
    WINDOWS_MIN_BYTES,
)
from ..session import scratch_path, stage
from ..sources.content import file_hasher, hash_column, table_hasher
from ..sources.listing import scan_inventory
from ..sources.listing_source import read_inventory
from ..sources.report import read_file_table, write_file_table
from ..sources.repository import Repository
from . import commands, jobs
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]

ROW = ["snapshot", "source", "size", "mtime_ns", "hash", "file"]
DECIDED = [*ROW, "action", "blob_id"]
DOC_SNAPSHOTS = ["s0", "s1", "s2", "s3"]


def staged_docs(spark, sf) -> DataFrame:
    return stage(V.doc_manifest(spark, sf), "docs")


def staged_prior(spark, sf) -> DataFrame:
    return stage(V.prior_manifest(spark, sf), "prior")


def staged_events(spark, sf) -> DataFrame:
    return stage(V.event_manifest(spark, sf), "events")


def new_docs(spark, sf) -> DataFrame:
    """All documents as hashed rows of a new snapshot."""
    rows = V.doc_manifest(spark, sf).withColumn("snapshot", F.lit("s9"))
    return stage(rows.select(*ROW), "new")


def empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


# scans, sources, sinks


def manifest_lookup(spark, sf):
    """A lookup in stored snapshots: only their partitions are read, and filters reach the scan."""
    events = staged_events(spark, sf)
    repo = repository_of(spark, events, event_days(events))
    return lookup.scan_manifest(repo.manifest(), source="/u/8/error", size=9).select(*ROW)


def event_days(events: DataFrame) -> list[str]:
    return sorted(r.snapshot for r in events.select("snapshot").distinct().collect())


def repository_of(spark, rows: DataFrame, names: list[str]) -> Repository:
    repo = Repository(spark, scratch_path(spark, "repository"), create=True)
    repo.write(rows, repo.begin(names, create=True))
    return repo


def repository_union(spark, sf):
    """Two groups of snapshots stored one after the other, read back as one table."""
    repo = repository_of(spark, V.doc_manifest(spark, sf), DOC_SNAPSHOTS)
    events = staged_events(spark, sf)
    repo.write(events, repo.begin(event_days(events), create=True))
    return repo.manifest().select(*ROW)


def append_manifest(spark, sf):
    repo = repository_of(spark, V.prior_manifest(spark, sf), DOC_SNAPSHOTS)
    actions = assign_blobs(new_docs(spark, sf), repo.manifest(), "s9")
    repo.write(jobs.stored_rows(actions), repo.begin(["s9"], create=True))
    return repo.manifest(["s9"])


def manifest_delete(spark, sf):
    """Rows of later daily snapshots go; incomplete rows in the list match nothing."""
    rows = staged_events(spark, sf)
    n = F.substr(F.col("file"), F.lit(2)).cast("long")
    listed = rows.where(F.col("source").endswith("/error")).withColumn(
        "hash", F.when(n % 3 != 0, F.col("hash"))
    )
    return lookup.delete_rows(rows, listed).select(*ROW)


def compact_roundtrip(spark, sf):
    repo = repository_of(spark, V.doc_manifest(spark, sf), DOC_SNAPSHOTS)
    commands.compact(repo, DOC_SNAPSHOTS)
    return repo.manifest().select(*ROW)


def invalid_snapshots(spark, sf):
    return roots.invalid_snapshots(V.snapshot_states(spark, sf))


def write_table(spark, sf):
    docs = staged_docs(spark, sf)
    linked = verify.link_inventory(docs, V.doc_inventory(spark, sf, docs))
    path = scratch_path(spark, "file-table")
    write_file_table(verify.file_table(linked, DOC_SNAPSHOTS), DOC_SNAPSHOTS, path)
    return read_file_table(spark, DOC_SNAPSHOTS, path)


def scan_and_hash(spark, sf):
    """The texts as files in a directory tree, listed and read back: bytes per directory.

    The hashes are compared with those of the same files as Spark reads them.
    """
    tree = scratch_path(spark, "tree")
    texts = V.table(spark, sf, "documents").select("text", "source", "lang")
    texts.hint("rebalance", "source", "lang").write.partitionBy("source", "lang").text(tree)
    top = tree.removeprefix("file://").removeprefix("file:")
    listed = scan_inventory(spark, [top], [".crc"])
    files = filters.exclude_kept(listed, [".crc", "_SUCCESS"]).where("type = 'regular'")
    read = file_hasher(F.col("path"))(files.select("path", "size")).where("content_hash is not null")
    plain = F.regexp_replace("path", "^file:/+", "/")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree)
    expected = binary.select(plain.alias("path"), F.sha2("content", 256).alias("expected"))
    both = read.join(expected, "path", "left")
    place = [F.regexp_extract("path", f"/{part}=([^/]+)", 1).alias(part) for part in ("source", "lang")]
    same = F.coalesce(F.col("content_hash") == F.col("expected"), F.lit(False))
    return both.groupBy(*place).agg(
        F.sum("size").alias("listed_bytes"), F.sum("now_size").alias("read_bytes"), F.bool_and(same).alias("same_hashes")
    )


def scan_source(spark, sf):
    """The same directory tree listed by the data source, without what the conditions leave out."""
    tree = scratch_path(spark, "tree")
    texts = V.table(spark, sf, "documents").select("text", "source", "lang")
    texts.hint("rebalance", "source", "lang").write.partitionBy("source", "lang").text(tree)
    top = tree.removeprefix("file://").removeprefix("file:")
    listed = read_inventory(spark, [top], ["lang=fr"])
    files = listed.where((F.col("type") == "regular") & ~F.col("path").endswith(".crc") & F.col("path").endswith(".txt"))
    place = [F.regexp_extract("path", f"/{part}=([^/]+)", 1).alias(part) for part in ("source", "lang")]
    return files.groupBy(*place).agg(F.sum("size").alias("listed_bytes"))


def content_hash(spark, sf):
    return hash_column(V.table(spark, sf, "documents"), "doc_id", F.col("text"))


# projections, filters, predicates


def exclude_kept(spark, sf):
    return filters.exclude_kept(V.url_paths(spark, sf), V.URL_EXCLUDES)


def exclude_topmost(spark, sf):
    return filters.exclude_topmost(V.url_paths(spark, sf), V.URL_EXCLUDES)


def exclude_by_table(spark, sf):
    return filters.mark_excluded(V.url_paths(spark, sf), V.url_excludes(spark, sf))


def route_by_type(spark, sf):
    return filters.route_by_type(V.url_inventory(spark, sf)).select("page_id", "path", "type", "route")


def target_path(spark, sf):
    return filters.target_path(V.site_roots(spark, sf), V.site_entries(spark, sf))


def path_parts(spark, sf):
    rows = V.doc_manifest(spark, sf)
    full = P.full_path(F.col("snapshot"), F.col("file"))
    return rows.select(
        "doc_id",
        full.alias("path"),
        P.parent_path(full).alias("parent"),
        P.file_name(full).alias("name"),
        P.target_key(F.col("source")).alias("flat"),
        F.lower("file").alias("lowered"),
        F.col("source").startswith("/src1").alias("has_prefix"),
        F.col("source").endswith("7.txt").alias("has_suffix"),
    )


def bad_rows(spark, sf):
    rows = filters.bad_rows(V.flawed_manifest(spark, sf))
    return rows.select(*ROW, "problem")


def overlong_paths(spark, sf):
    return filters.overlong_paths(V.url_paths(spark, sf), 45)


# joins


def signature_lookup(spark, sf):
    files = V.doc_files(spark, sf)
    return lookup.signature_lookup(files, V.prior_manifest(spark, sf), unique_files=True)


def signature_lookup_repeating(spark, sf):
    files = staged_events(spark, sf).select(*ROW)
    return lookup.signature_lookup(files, V.event_target(spark, sf))


def content_lookup(spark, sf):
    files = new_docs(spark, sf)
    return lookup.content_lookup(files, V.prior_manifest(spark, sf), max_links=2).select(
        "file", "hash", "found_blob", "linkable"
    )


def missing_files(spark, sf):
    docs = staged_docs(spark, sf)
    return lookup.missing_files(docs, V.doc_inventory(spark, sf, docs)).select(*ROW)


def shared_content(spark, sf):
    return lookup.shared_content(staged_docs(spark, sf), ["s1", "s3"]).select(*ROW)


def overlapping_roots(spark, sf, mode="string"):
    known = stage(V.url_roots(spark, sf), "roots")
    return roots.overlapping_roots(known, V.REPO_PATH, V.URL_EXCLUDES, mode)


def invalid_roots(spark, sf):
    entries = V.url_inventory(spark, sf).select(F.col("path").alias("root"), "path", "type")
    return roots.invalid_roots(V.url_roots(spark, sf), entries, V.URL_EXCLUDES).distinct()


def unstable_files(spark, sf):
    entries = V.url_inventory(spark, sf)
    named = F.concat_ws("#", "path", F.col("page_id").cast("string"))
    before = entries.select("page_id", named.alias("path"), "size", "mtime_ns")
    later = F.col("page_id") % 9 == 0
    after = before.withColumn("size", F.col("size") + F.when(later, F.col("page_id") % 2).otherwise(0))
    after = after.withColumn("mtime_ns", F.col("mtime_ns") + F.when(later, 5).otherwise(0))
    return lookup.unstable_files(before, after)


def snapshot_set_checks(spark, sf):
    states = V.snapshot_states(spark, sf)
    known = states.where("state is not null").select(F.concat(F.lit("/repo/"), "snapshot").alias("path"), "state")
    return roots.snapshot_set_checks(V.named_paths(spark, sf), known)


# deduplication, aggregation, verification


def assign_all_new(spark, sf):
    files = new_docs(spark, sf)
    return assign_blobs(files, empty(files.withColumn("blob_id", F.lit(""))), "s9").select(*DECIDED)


def assign_limited(spark, sf, max_links, min_bytes):
    files = new_docs(spark, sf)
    rows = assign_blobs(files, staged_prior(spark, sf), "s9", max_links, min_bytes)
    return rows.select(*DECIDED)


def assign_hot(spark, sf):
    """Every hash with more than one new row is numbered in parts; the outcome is that of one order."""
    files = new_docs(spark, sf)
    return assign_blobs(files, staged_prior(spark, sf), "s9", 2, 0, hot_rows=1).select(*DECIDED)


def assign_affinity(spark, sf):
    """Unchanged files keep to the blob of their own record, though contents have two blobs each."""
    hasher = table_hasher(V.doc_hashes(spark, sf), ["source"])
    rows = jobs.take_snapshot(
        V.doc_files(spark, sf), staged_prior(spark, sf), hasher, "s9", max_links=2, affinity=True
    )
    return rows.select(*DECIDED)


def assign_stored(spark, sf):
    """Links as the file system counts them; blobs whose files are all gone cannot be linked."""
    prior = staged_prior(spark, sf)
    return assign_blobs(new_docs(spark, sf), prior, "s9", 3, 0, V.stored_links(prior)).select(*DECIDED)


def clone_affinity(spark, sf):
    """Documents cloned into a repository that knows most of them in one of two blobs."""
    rows = jobs.clone(staged_docs(spark, sf), staged_prior(spark, sf), "run", max_links=3, affinity=True)
    return rows.select(*DECIDED)


def incremental_skip(spark, sf):
    files = staged_events(spark, sf).select(*ROW)
    return lookup.incremental_skip(files, V.event_target(spark, sf))


def signature_conflicts(spark, sf):
    files = staged_events(spark, sf).select(*ROW)
    return lookup.signature_conflicts(files, V.event_target(spark, sf))


def doc_links(spark, sf, mixed: bool) -> DataFrame:
    docs = staged_docs(spark, sf)
    there = V.mixed_inventory(docs) if mixed else V.doc_inventory(spark, sf, docs)
    return stage(verify.link_inventory(docs, there), "linked")


def file_table(spark, sf):
    docs = staged_docs(spark, sf)
    linked = verify.link_inventory(docs, V.doc_inventory(spark, sf, docs))
    return verify.file_table(linked, DOC_SNAPSHOTS)


def event_reps(spark, sf) -> DataFrame:
    linked = verify.link_inventory(V.event_manifest(spark, sf), V.event_inventory(spark, sf))
    return verify.representatives(linked)


def signature_uniqueness(spark, sf):
    return verify.signature_uniqueness(event_reps(spark, sf))


def signature_pairs(spark, sf):
    return verify.signature_pairs(stage(event_reps(spark, sf), "reps"))


def hash_consistency(spark, sf):
    linked = doc_links(spark, sf, mixed=True)
    found = verify.hash_consistency(linked, verify.representatives(linked))
    return found.select("inode", "snapshot", "file", "hash", "first_hash")


def stored_hasher(spark, sf):
    return table_hasher(V.stored_content(spark, sf), ["snapshot", "file"])


def rehash_mismatch(spark, sf):
    linked = doc_links(spark, sf, mixed=False)
    rehashed = verify.rehash(verify.representatives(linked), stored_hasher(spark, sf))
    return verify.rehash_mismatch(rehashed).select("inode", "snapshot", "file", "hash", "found_hash")


def unreadable_index(spark, sf):
    docs = staged_docs(spark, sf)
    linked = verify.link_inventory(docs, V.doc_inventory(spark, sf, docs))
    return verify.unreadable_index(linked).select(*ROW)


def manifest_integrity(spark, sf):
    return verify.manifest_integrity(stage(V.flawed_manifest(spark, sf), "flawed"))


def action_stats(spark, sf):
    return stats.action_stats(take_snapshot(spark, sf, True, True))


def deletion_stats(spark, sf):
    gone = lookup.shared_content(staged_docs(spark, sf), ["s1", "s3"])
    return stats.action_stats(gone.withColumn("action", F.lit(DELETE)))


def exclusion_stats(spark, sf):
    listing = V.doc_listing(spark, sf)
    return stats.exclusion_stats(jobs.left_out(listing, V.DOC_EXCLUDES))


def event_counts(spark, sf):
    """Errors of verification and warnings for long paths."""
    docs = staged_docs(spark, sf)
    errors = jobs.verify(docs, V.mixed_inventory(docs)).select("snapshot", "level")
    long = docs.where(P.is_overlong(F.col("file"), 16)).select("snapshot", F.lit("warning").alias("level"))
    return stats.event_counts(errors.unionByName(long))


def run_events(spark, sf):
    """Conflicts of a run as errors, long paths as warnings."""
    actions = stage(take_snapshot(spark, sf, True, True), "actions")
    return stats.event_counts(jobs.run_events(actions, 17))


def empty_directories(spark, sf):
    docs = staged_docs(spark, sf)
    gone = docs.where(F.col("file").contains("/de/") | F.col("file").startswith("#src3/"))
    return tree.empty_directories(V.doc_tree(docs), gone)


# jobs


def take_snapshot(spark, sf, incremental, always_hash, max_links=LINUX_MAX_LINKS, min_bytes=LINUX_MIN_BYTES):
    files = jobs.walk(V.doc_roots(spark, sf), V.doc_listing(spark, sf), V.DOC_EXCLUDES, "s9")
    hasher = table_hasher(V.doc_hashes(spark, sf), ["source"])
    return jobs.take_snapshot(
        files, staged_prior(spark, sf), hasher, "s9", incremental, always_hash, max_links, min_bytes
    )


def take_first(spark, sf):
    """A snapshot into an empty repository."""
    files = V.doc_files(spark, sf)
    hasher = table_hasher(V.doc_hashes(spark, sf), ["source"])
    return jobs.take_snapshot(files, empty(V.prior_manifest(spark, sf)), hasher, "s9")


def take_again(spark, sf):
    """Nothing changed since the last snapshots: no content is read."""
    files = V.doc_files(spark, sf)
    hasher = table_hasher(V.doc_hashes(spark, sf), ["source"])
    return jobs.take_snapshot(files, staged_docs(spark, sf).drop("doc_id"), hasher, "s9")


def verify_report(spark, sf, rehash: bool):
    docs = staged_docs(spark, sf)
    hasher = stored_hasher(spark, sf) if rehash else None
    return jobs.verify(docs, V.mixed_inventory(docs), hasher, DOC_SNAPSHOTS)


def purge_result(spark, sf):
    docs = staged_docs(spark, sf)
    return jobs.purge(docs, V.doc_inventory(spark, sf, docs), ["s0", "s1"]).select(*ROW)


def distill_result(spark, sf):
    return jobs.distill(staged_docs(spark, sf), ["s1", "s3"]).select(*ROW)


def distill_days(spark, sf):
    """All daily snapshots but the last, oldest first: each content stays in one place."""
    events = staged_events(spark, sf)
    return jobs.distill(events, event_days(events)[:-1]).select(*ROW)


def flawed(spark, sf) -> DataFrame:
    """Flawed rows, some without a snapshot."""
    rows = V.flawed_manifest(spark, sf)
    n = F.substr(F.col("file"), F.lit(2)).cast("long")
    return stage(rows.withColumn("snapshot", F.when(n % 127 != 0, F.col("snapshot"))), "flawed")


def distill_flawed(spark, sf):
    """Rows without a usable hash, or without a snapshot, are never taken for copies."""
    rows = flawed(spark, sf)
    return jobs.distill(rows, event_days(rows.where("snapshot is not null"))[:-1]).select(*ROW)


def purge_flawed(spark, sf):
    rows = flawed(spark, sf)
    n = F.substr(F.col("file"), F.lit(2)).cast("long")
    there = rows.where(n % 37 != 0).select("snapshot", "file")
    return jobs.purge(rows, there, event_days(rows.where("snapshot is not null"))[:10]).select(*ROW)


def purge_stored(spark, sf):
    docs = staged_docs(spark, sf)
    repo = repository_of(spark, docs, DOC_SNAPSHOTS)
    commands.purge(repo, V.doc_inventory(spark, sf, docs), ["s0", "s1"])
    return repo.manifest().select(*ROW)


def distill_stored(spark, sf):
    repo = repository_of(spark, staged_docs(spark, sf), DOC_SNAPSHOTS)
    commands.distill(repo, ["s1", "s3"])
    repo.vacuum()
    return repo.manifest().select(*ROW)


def clone_stored(spark, sf):
    """One repository cloned into another: the rows the target then holds of it."""
    events, target = staged_events(spark, sf), stage(V.event_target(spark, sf), "target")
    source, known = repository_of(spark, events, event_days(events)), repository_of(spark, target, event_days(target))
    commands.clone(source, known, "run", suffix="copy")
    return known.manifest([f"{day}_copy" for day in event_days(events)]).select(*ROW, "blob_id")


def normalised_roots(spark, sf):
    """Hosts as roots, written in ways that mean the same path."""
    pages = V.table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    way = F.col("page_id") % 5
    written = (
        F.when(way == 0, F.concat(F.lit("//"), host, F.lit("/")))
        .when(way == 1, F.concat(F.lit("/./x/../"), host))
        .when(way == 2, F.concat(F.lit("/../"), host, F.lit("//.")))
        .when(way == 3, F.concat(host, F.lit("/a/b/../..")))
        .otherwise(F.concat(F.lit("../"), host, F.lit("/./")))
    )
    return pages.select("page_id", P.normal_path(written).alias("root"))


def clone_into_empty(spark, sf, incremental):
    events = staged_events(spark, sf)
    return jobs.clone(events, empty(events), "run", incremental).select(*DECIDED)


def clone_result(spark, sf, incremental, max_links=LINUX_MAX_LINKS):
    target = stage(V.event_target(spark, sf), "target")
    rows = jobs.clone(staged_events(spark, sf), target, "run", incremental, "copy", max_links)
    return rows.select(*DECIDED)


# scalar functions


def record_text(spark, sf):
    rows = V.doc_manifest(spark, sf)
    start, now = F.lit(V.EPOCH_2024 * V.NANOS), F.col("mtime_ns")
    return rows.select(
        "doc_id",
        X.number_text(F.col("size"), 15).alias("size_text"),
        X.time_text(now).alias("time_text"),
        X.time_text(now, friendly=False).alias("time_name"),
        X.elapsed_text(start, now).alias("elapsed"),
        X.record_text(F.col("size"), now, F.col("source")).alias("record"),
        X.snapshot_name(X.time_text(now, friendly=False), "full").alias("renamed"),
    )


QUERIES: dict[str, Query] = {
    "manifest_lookup": manifest_lookup,
    "repository_union": repository_union,
    "append_manifest": append_manifest,
    "manifest_delete": manifest_delete,
    "compact_roundtrip": compact_roundtrip,
    "invalid_snapshots": invalid_snapshots,
    "write_file_table": write_table,
    "scan_and_hash": scan_and_hash,
    "scan_source": scan_source,
    "content_hash": content_hash,
    "exclude_kept": exclude_kept,
    "exclude_topmost": exclude_topmost,
    "exclude_by_table": exclude_by_table,
    "route_by_type": route_by_type,
    "target_path": target_path,
    "path_parts": path_parts,
    "bad_rows": bad_rows,
    "overlong_paths": overlong_paths,
    "signature_lookup": signature_lookup,
    "signature_lookup_repeating": signature_lookup_repeating,
    "content_lookup": content_lookup,
    "missing_files": missing_files,
    "shared_content": shared_content,
    "overlapping_roots": overlapping_roots,
    "overlapping_roots_component": partial(overlapping_roots, mode="component"),
    "invalid_roots": invalid_roots,
    "unstable_files": unstable_files,
    "snapshot_set_checks": snapshot_set_checks,
    "assign_blobs": assign_all_new,
    "assign_blobs_limited": partial(assign_limited, max_links=2, min_bytes=0),
    "assign_blobs_hot": assign_hot,
    "assign_blobs_affinity": assign_affinity,
    "assign_blobs_stored": assign_stored,
    "clone_affinity": clone_affinity,
    "assign_blobs_windows": partial(
        assign_limited, max_links=WINDOWS_MAX_LINKS, min_bytes=WINDOWS_MIN_BYTES
    ),
    "incremental_skip": incremental_skip,
    "signature_conflicts": signature_conflicts,
    "file_table": file_table,
    "signature_uniqueness": signature_uniqueness,
    "signature_pairs": signature_pairs,
    "hash_consistency": hash_consistency,
    "rehash_mismatch": rehash_mismatch,
    "unreadable_index": unreadable_index,
    "action_stats": action_stats,
    "deletion_stats": deletion_stats,
    "exclusion_stats": exclusion_stats,
    "event_counts": event_counts,
    "run_events": run_events,
    "manifest_integrity": manifest_integrity,
    "empty_directories": empty_directories,
    "take_snapshot": partial(take_snapshot, incremental=False, always_hash=False),
    "take_snapshot_incremental": partial(take_snapshot, incremental=True, always_hash=False),
    "take_snapshot_always_hash": partial(take_snapshot, incremental=False, always_hash=True),
    "take_snapshot_incremental_always_hash": partial(take_snapshot, incremental=True, always_hash=True),
    "take_snapshot_limited": partial(
        take_snapshot, incremental=False, always_hash=True, max_links=2, min_bytes=600
    ),
    "take_snapshot_first": take_first,
    "take_snapshot_repeat": take_again,
    "verify_report": partial(verify_report, rehash=False),
    "verify_report_rehash": partial(verify_report, rehash=True),
    "purge_result": purge_result,
    "distill_result": distill_result,
    "distill_days": distill_days,
    "distill_flawed": distill_flawed,
    "purge_flawed": purge_flawed,
    "purge_stored": purge_stored,
    "distill_stored": distill_stored,
    "clone_stored": clone_stored,
    "normalised_roots": normalised_roots,
    "clone_into_empty": partial(clone_into_empty, incremental=True),
    "clone_result": partial(clone_result, incremental=False),
    "clone_incremental": partial(clone_result, incremental=True),
    "clone_limited": partial(clone_result, incremental=False, max_links=7),
    "record_text": record_text,
}
