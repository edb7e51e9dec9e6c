"""Row-wise checks on inventories and manifests, and exclusion by path suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import (
    ancestors,
    contains_any,
    ends_with_any,
    is_overlong,
    join_path,
    relative_path,
    target_key,
)
from ..schemas import LINUX_MAX_PATH
from ..session import stage
from .skew import HOT_ROWS, attach, count_rows, is_small

FOLDED_SUFFIXES = 64


def mark_excluded(
    inventory: DataFrame, excludes: Sequence[str] | DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``excluded_by``: the topmost of the path and its ancestors that ends with a suffix.

    A short list becomes part of the row expression, where a cheap substring test guards the work
    on ancestors. A table (or a long list) is matched by an equi-join of directory endings. Empty
    and null suffixes exclude nothing.
    """
    if not isinstance(excludes, DataFrame):
        excludes = [s for s in excludes if s]
        if len(excludes) <= FOLDED_SUFFIXES:
            chain = ancestors(F.col("root"), F.col("path"))
            hits = F.filter(chain, lambda a: ends_with_any(a, excludes))
            possible = contains_any(F.col("path"), excludes)
            return inventory.withColumn("excluded_by", F.when(possible, F.get(hits, F.lit(0))))
        spark = inventory.sparkSession
        excludes = spark.createDataFrame([(s,) for s in excludes], "suffix string")
    return _mark_by_table(inventory, excludes, hot_rows)


def _mark_by_table(inventory: DataFrame, excludes: DataFrame, hot_rows: int) -> DataFrame:
    suffixes = excludes.select("suffix").where("suffix <> ''").distinct()
    steps = inventory.select(
        "root", "path", F.posexplode(ancestors(F.col("root"), F.col("path"))).alias("depth", "step")
    )
    # one line per directory; the lengths are at most as many as a path has characters
    places = count_rows(steps, ["step"], "_n")
    lengths = suffixes.agg(F.collect_set(F.length("suffix"))).scalar()
    endings = places.select("step", "_n", F.explode(lengths).alias("len")).where(
        F.col("len") <= F.length("step")
    )
    matched = (
        endings.withColumn("suffix", F.expr("right(step, len)"))
        .join(suffixes, "suffix", "left_semi")
        .groupBy("step")
        .agg(F.max("_n").alias("_n"), F.lit(True).alias("hit"))
    )
    matched = stage(matched, "matched")
    if is_small(matched):
        found = steps.join(F.broadcast(matched.select("step")), "step")
    else:
        found = attach(steps, matched, ["step"], ["path"], "_n", hot_rows).where("hit")
    topmost = found.groupBy("root", "path").agg(F.min(F.struct("depth", "step")).alias("first"))
    excluded = topmost.select("root", "path", F.col("first.step").alias("excluded_by"))
    return inventory.join(excluded, ["root", "path"], "left").select(
        *inventory.columns, "excluded_by"
    )


def exclude_kept(inventory: DataFrame, excludes) -> DataFrame:
    marked = mark_excluded(inventory, excludes)
    return marked.where(F.col("excluded_by").isNull()).select(*inventory.columns)


def exclude_topmost(inventory: DataFrame, excludes) -> DataFrame:
    """Each excluded path or subtree once, by its topmost match."""
    marked = mark_excluded(inventory, excludes)
    hit = marked.where(F.col("excluded_by").isNotNull())
    return hit.select("root", F.col("excluded_by").alias("path")).distinct()


def route_by_type(inventory: DataFrame) -> DataFrame:
    """Add ``route``: file, directory, or the reason for leaving the entry out."""
    kind = F.col("type")
    route = (
        F.when(kind == "regular", "file")
        .when(kind == "directory", "directory")
        .when(kind.isin("symlink", "junction"), "symlink")
        .when(kind.isNull() | kind.isin("none", "not_found", "unreadable_directory"), "inaccessible")
        .otherwise("unknown_type")
    )
    return inventory.withColumn("route", route)


def overlong_paths(inventory: DataFrame, limit: int = LINUX_MAX_PATH) -> DataFrame:
    return inventory.where(is_overlong(F.col("path"), limit))


def root_keys(roots: DataFrame, windows: bool = False) -> DataFrame:
    """Directory name inside the snapshot for each root (ord, root).

    Roots that map to the same name are numbered in order: ``name``, ``name_1``, ``name_2``. More
    than 99 of them, or a number that meets another root's own name, raise at run time.
    """
    named = roots.withColumn("name", target_key(F.col("root"), windows))
    # roots are the lines of a rules file, so this window stays small
    numbered = named.withColumn(
        "nth", F.row_number().over(Window.partitionBy("name").orderBy("ord", "root"))
    )
    key = F.when(F.col("nth") == 1, F.col("name")).otherwise(
        F.concat_ws("_", "name", (F.col("nth") - 1).cast("string"))
    )
    too_many = F.raise_error(F.concat(F.lit("cannot create target path for "), "root"))
    keyed = numbered.withColumn("key", F.when(F.col("nth") > 100, too_many).otherwise(key))
    own = named.select(F.col("name").alias("key")).distinct().withColumn("taken", F.lit(True))
    checked = keyed.join(own, "key", "left")
    clash = (F.col("nth") > 1) & F.col("taken")
    taken = F.raise_error(F.concat(F.lit("target path is taken: "), "key"))
    return checked.select("ord", "root", F.when(clash, taken).otherwise(F.col("key")).alias("key"))


def target_path(
    roots: DataFrame, inventory: DataFrame, windows: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``file``: the root's directory name followed by the path below the root."""
    keys = stage(root_keys(roots, windows).select("root", "key"), "roots")
    if is_small(keys):
        found = inventory.join(F.broadcast(keys), "root", "left")
    else:
        sized = count_rows(inventory, ["root"], "_n").join(keys, "root")
        found = attach(inventory, sized, ["root"], ["path"], "_n", hot_rows)
    below = relative_path(F.col("root"), F.col("path"))
    return found.select(
        *inventory.columns, join_path(F.col("key"), below).alias("file")
    )


def bad_rows(manifest: DataFrame) -> DataFrame:
    """Rows with a value that is not set, or a hash that is no SHA-256; ``problem`` says which."""
    def unset(name: str):
        return F.col(name).isNull() | (F.col(name) == "")

    problem = (
        F.when(unset("source"), "source")
        .when(F.col("size").isNull() | (F.col("size") < 0), "size")
        .when(F.col("mtime_ns").isNull() | (F.col("mtime_ns") == -1), "mtime_ns")
        .when(unset("hash"), "hash")
        .when(~F.col("hash").rlike("^[0-9a-f]{64}$"), "hash")
        .when(unset("file"), "file")
        .when(unset("snapshot"), "snapshot")
    )
    return manifest.withColumn("problem", problem).where("problem is not null")
