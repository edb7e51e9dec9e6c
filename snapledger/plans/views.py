"""Manifests, inventories and rules derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parent_chain, parent_path
from ..operators.skew import attach

EPOCH_2024 = 1_704_067_200
NANOS = 1_000_000_000
MANIFEST_COLUMNS = ["snapshot", "source", "size", "mtime_ns", "hash", "file", "blob_id"]
URL_EXCLUDES = [".html", "#top", ".net"]
DOC_EXCLUDES = ["77.txt", "/fr"]
REPO_PATH = "/spam-farm.example.org/en"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_source() -> Column:
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _doc_file() -> Column:
    return F.concat(F.lit("#"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _doc_mtime() -> Column:
    return ((F.col("doc_id") * 60 + EPOCH_2024) * NANOS).cast("long")


def doc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document in four snapshots; equal texts share a blob."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("snapshot"),
        _doc_source().alias("source"),
        F.octet_length("text").cast("long").alias("size"),
        _doc_mtime().alias("mtime_ns"),
        F.sha2("text", 256).alias("hash"),
        _doc_file().alias("file"),
        F.sha2("text", 256).alias("blob_id"),
        "doc_id",
    )


def prior_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of all documents: a third had other content, some another time, and some
    are recorded with a hash their content does not have. Up to two blobs per content."""
    old, touched, wrong = (F.col("doc_id") % n == 0 for n in (3, 7, 11))
    changed = F.sha2(F.concat("text", F.lit("-old")), 256)
    base = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("snapshot"),
        _doc_source().alias("source"),
        (F.octet_length("text") + F.when(old, 4).otherwise(0)).cast("long").alias("size"),
        (_doc_mtime() - F.when(old | touched, NANOS).otherwise(0)).alias("mtime_ns"),
        F.when(old | wrong, changed).otherwise(F.sha2("text", 256)).alias("hash"),
        _doc_file().alias("file"),
        "doc_id",
    )
    blob = F.concat_ws("-", "hash", (F.col("doc_id") % 2).cast("string"))
    return base.withColumn("blob_id", blob).select(*MANIFEST_COLUMNS)


def stored_links(manifest: DataFrame) -> DataFrame:
    """Stored files of a manifest with their link counts; files of every third blob are gone."""
    last = F.conv(F.substring("hash", 64, 1), 16, 10).cast("int")
    there = manifest.where((last % 3 != 0) | ~F.col("blob_id").endswith("-0"))
    return there.select("snapshot", "file", (last % 4 + 1).cast("long").alias("nlink"))


def doc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as an inventory; a few entries are links or of unknown type."""
    kind = (
        F.when(F.col("doc_id") % 29 == 0, "symlink")
        .when(F.col("doc_id") % 31 == 0, "other")
        .otherwise("regular")
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), "source").alias("root"),
        _doc_source().alias("path"),
        kind.alias("type"),
        F.octet_length("text").cast("long").alias("size"),
        _doc_mtime().alias("mtime_ns"),
    )


def doc_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    return sources.select(F.lit(0).alias("ord"), F.concat(F.lit("/"), "source").alias("root"))


def doc_files(spark: SparkSession, sf_dir: str, snapshot: str = "s9") -> DataFrame:
    """All documents as the files of a new snapshot, without content."""
    return table(spark, sf_dir, "documents").select(
        F.lit(snapshot).alias("snapshot"),
        _doc_source().alias("source"),
        F.octet_length("text").cast("long").alias("size"),
        _doc_mtime().alias("mtime_ns"),
        _doc_file().alias("file"),
    )


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each document's content by its path."""
    return table(spark, sf_dir, "documents").select(
        _doc_source().alias("source"), F.sha2("text", 256).alias("content_hash")
    )


def doc_inventory(spark: SparkSession, sf_dir: str, manifest: DataFrame) -> DataFrame:
    """Stored files; equal contents share a physical id, every 37th is missing."""
    there = manifest.where(F.col("doc_id") % 37 != 0)
    ids = there.groupBy("hash").agg(F.min("doc_id").alias("inode"), F.count(F.lit(1)).alias("_n"))
    found = attach(there, ids, ["hash"], ["file"], "_n")
    return found.select("snapshot", "file", "size", "mtime_ns", "inode")


def mixed_inventory(manifest: DataFrame) -> DataFrame:
    """Stored files where five neighbours share a physical id whatever their hash."""
    return manifest.where(F.col("doc_id") % 37 != 0).select(
        "snapshot", "file", F.floor(F.col("doc_id") / 5).cast("long").alias("inode")
    )


def stored_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the stored files gives: some hold other bytes, some cannot be read."""
    found = (
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256))
        .otherwise(F.sha2("text", 256))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("snapshot"),
        _doc_file().alias("file"),
        found.alias("content_hash"),
    )


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event in daily snapshots; signatures repeat with other hashes."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("source"),
        F.octet_length("props").cast("long").alias("size"),
        F.lit(0).cast("long").alias("mtime_ns"),
        F.sha2("props", 256).alias("hash"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"),
        F.sha2("props", 256).alias("blob_id"),
    )


def event_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second repository of the same events in which odd users were kept at another path."""
    user = F.col("user_id").cast("string")
    top = F.when(F.col("user_id") % 2 == 0, "/u/").otherwise("/v/")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("t"), F.date_format("ts", "yyyy-MM-dd")).alias("snapshot"),
        F.concat(top, user, F.lit("/"), "event_type").alias("source"),
        F.octet_length("props").cast("long").alias("size"),
        F.lit(0).cast("long").alias("mtime_ns"),
        F.sha2("props", 256).alias("hash"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("file"),
        F.sha2("props", 256).alias("blob_id"),
    )


def event_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files of the events, three to a physical id."""
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("snapshot"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"),
        F.floor(F.col("event_id") / 3).cast("long").alias("inode"),
    )


def flawed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with values missing by rule; rows of one kind are recorded twice."""
    n = F.substr(F.col("file"), F.lit(2)).cast("long")
    rows = event_manifest(spark, sf_dir).select(
        "snapshot",
        F.when(n % 101 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(n % 103 != 0, F.col("size")).alias("size"),
        F.when(n % 107 == 0, -1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        F.when(n % 109 == 0, "ERROR").when(n % 113 != 0, F.col("hash")).alias("hash"),
        "file",
        "blob_id",
    )
    times = F.when(F.col("source").endswith("/purchase"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(times)).drop("_copy")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.lit("/").alias("root"), F.regexp_replace("url", "^https?:/", "").alias("path"), "page_id"
    )


def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("url").endswith("#top"), "symlink")
        .when(F.col("url").endswith("/"), "directory")
        .when(F.col("url").endswith(".html"), "regular")
        .when(F.col("url").contains("utm_source"), "not_found")
        .when(F.col("url").contains("ref=x"), "socket")
        .otherwise("regular")
    )
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace("url", "^https?:/", "").alias("path"),
        kind.alias("type"),
        F.octet_length("html").cast("long").alias("size"),
        F.col("page_id").alias("mtime_ns"),
    )


def url_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of suffixes: the last five characters of every Spanish page's path."""
    paths = url_paths(spark, sf_dir).where(F.col("path").contains("/es/"))
    return paths.select(F.expr("right(path, 5)").alias("suffix")).distinct()


def site_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below one root per site and protocol; both roots of a site map to one name."""
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    top = F.when(F.col("url").startswith("https"), "/").otherwise("#")
    below = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, sf_dir, "pages").select(
        F.concat(top, site).alias("root"), F.concat(top, site, below).alias("path"), "page_id"
    )


def site_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_entries(spark, sf_dir).groupBy("root").agg(F.min("page_id").alias("ord"))


def url_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page path and its parent directory as a root."""
    paths = url_paths(spark, sf_dir)
    both = F.explode(F.array("path", parent_path(F.col("path"))))
    return paths.select(F.col("page_id").alias("ord"), both.alias("root")).where("root <> ''")


def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each daily snapshot, by day of month."""
    day = F.substring("snapshot", 9, 2).cast("int")
    state = F.when(day % 5 == 0, "in_progress").when(day % 7 != 0, "complete")
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("snapshot"))
    return days.distinct().withColumn("state", state)


def named_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot paths as a user might name them: one for each kind of event and day."""
    parent = F.when(F.col("event_type") == "error", "/old/").otherwise("/repo/")
    days = table(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.distinct().select(F.concat(parent, "day").alias("path"))


def doc_tree(manifest: DataFrame) -> DataFrame:
    """Files of a manifest with all their directories, and a directory that never had any."""
    files = manifest.select("snapshot", "file", F.lit("regular").alias("type"))
    tops = manifest.select("snapshot", F.substring_index("file", "/", 1).alias("top")).distinct()
    dirs = manifest.select("snapshot", F.explode(parent_chain(F.col("file"))).alias("file")).distinct()
    spare = tops.select("snapshot", F.concat("top", F.lit("/spare")).alias("file"))
    listed = dirs.unionByName(spare).withColumn("type", F.lit("directory"))
    return files.unionByName(listed)

