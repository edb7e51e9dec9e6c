"""Listing directory trees on a mount shared by all executors."""

from __future__ import annotations

import os
import posixpath
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ends_with_any
from ..schemas import INVENTORY
from ..session import scratch_path

BATCH_ROWS = 10_000


def _kind(mode: int) -> str:
    if stat.S_ISREG(mode):
        return "regular"
    if stat.S_ISDIR(mode):
        return "directory"
    if stat.S_ISLNK(mode):
        return "symlink"
    return "other"


def _entry(root: str, path: str) -> tuple:
    try:
        s = os.lstat(path)
    except OSError:
        return root, path, "not_found", None, None, None, None, None
    return root, path, _kind(s.st_mode), s.st_size, s.st_mtime_ns, s.st_ino, s.st_dev, s.st_nlink


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=INVENTORY.names)
    for name in INVENTORY.names[3:]:
        frame[name] = pd.array([r[INVENTORY.names.index(name)] for r in rows], dtype="Int64")
    return frame


NAMES = "root string, path string, readable boolean"


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names in each directory; a directory that cannot be read stands for itself."""
    columns = ["root", "path", "readable"]
    rows: list[tuple] = []
    for batch in batches:
        for root, directory in zip(batch["root"], batch["path"]):
            try:
                entries = os.scandir(directory)
            except OSError:
                rows.append((root, directory, False))
                continue
            with entries:
                for entry in entries:
                    rows.append((root, os.path.join(directory, entry.name), True))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _stat_named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lost = "unreadable_directory", None, None, None, None, None
    for batch in batches:
        found = zip(batch["root"], batch["path"], batch["readable"])
        yield _frame([_entry(root, path) if readable else (root, path, *lost) for root, path, readable in found])


def _stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([_entry(root, path) for root, path in zip(batch["root"], batch["path"])])


def normal_root(root: str) -> str:
    """A root as ``functions.paths.normal_path`` writes it."""
    plain = posixpath.normpath(root)
    return "/" + plain.lstrip("/") if plain.startswith("/") else plain


def scan_inventory(
    spark: SparkSession, roots: list[str], excludes: list[str] = (), tasks: int | None = None
) -> DataFrame:
    """Inventory of all entries below ``roots`` (a root may be a file); links are not followed.

    Roots are paths on the mount, without a scheme; they are normalised by their text. One job per
    directory level: directories are spread over all tasks whatever subtree they come from, and so
    are the entries found in them, so neither a deep root nor a wide directory holds the listing up.
    Excluded directories appear but are not entered. Each level is written to the shared folder.
    """
    for root in roots:
        if "://" in root:
            raise ValueError(f"not a path on a mount: {root}")
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    out = scratch_path(spark, "listing")
    roots = [normal_root(r) for r in roots]
    named = spark.createDataFrame([(r, r) for r in roots], "root string, path string")
    level = 0
    named.repartition(min(tasks, len(roots) or 1)).mapInPandas(_stat, INVENTORY).write.parquet(f"{out}/level={level}")
    while True:
        entered = (
            spark.read.schema(INVENTORY)
            .parquet(f"{out}/level={level}")
            .where((F.col("type") == "directory") & ~ends_with_any(F.col("path"), [s for s in excludes if s]))
            .select("root", "path")
        )
        if entered.isEmpty():
            break
        level += 1
        # names first, so that the entries of one huge directory are looked at by many tasks
        names = entered.repartition(tasks, "path").mapInPandas(_names, NAMES)
        listed = names.repartition(tasks, "path").mapInPandas(_stat_named, INVENTORY)
        listed.write.parquet(f"{out}/level={level}")
    levels = [f"{out}/level={n}" for n in range(level + 1)]
    return spark.read.schema(INVENTORY).parquet(*levels)
