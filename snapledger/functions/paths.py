"""Path expressions. Paths are plain strings with ``/`` between components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(root: Column, path: Column) -> Column:
    """The part of ``path`` below ``root``, without a leading slash; empty for the root itself.

    Paths below the root ``.`` may or may not carry the leading ``./``.
    """
    bare = (root == ".") & ~path.startswith("./") & (path != ".")
    below = F.when(bare, path).otherwise(F.substr(path, F.length(root) + 1))
    return F.when(below.startswith("/"), F.substr(below, F.lit(2))).otherwise(below)


def join_path(parent: Column, child: Column) -> Column:
    return F.when(child == "", parent).otherwise(F.concat_ws("/", parent, child))


def full_path(snapshot: Column, file: Column) -> Column:
    return F.concat_ws("/", snapshot, file)


def parent_path(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut > 0, F.substr(path, F.lit(1), cut)).otherwise(F.lit(""))


def normal_path(path: Column) -> Column:
    """The path without ``.``, ``..``, doubled or trailing slashes, by its text alone.

    ``..`` above the root is dropped; above a relative path it stays.
    """
    absolute = path.startswith("/")
    start = F.array().cast("array<string>")
    up = F.lit("..")

    def add(kept: Column, part: Column) -> Column:
        none, last = F.size(kept) == 0, F.element_at(F.concat(F.array(F.lit("")), kept), -1)
        climbed = F.when(none & absolute, kept).when(none | (last == up), F.concat(kept, F.array(up)))
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == up, climbed.otherwise(shorter)).otherwise(
            F.concat(kept, F.array(part))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), start, add), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(root: Column, path: Column) -> Column:
    """``root``, then every path down to and including ``path``, outermost first."""
    below = relative_path(root, path)
    parts = F.split(below, "/")
    base = F.when(root == "/", F.lit("")).otherwise(root)
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat_ws("/", base, F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(below == "", F.array(root)).otherwise(F.concat(F.array(root), steps))


def parent_chain(path: Column) -> Column:
    """Every proper ancestor of a relative path, outermost first."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def ends_with_any(path: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.endswith(s) for s in suffixes], F.lit(False))


def contains_any(path: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.contains(t) for t in texts], F.lit(False))


def is_overlong(path: Column, limit: int) -> Column:
    return F.octet_length(path) >= limit


def target_key(root: Column, windows: bool = False) -> Column:
    """Directory name for a root inside a snapshot: separators become ``#``, ``.`` too."""
    flat = F.translate(root, ":\\", "##") if windows else F.translate(root, "/", "#")
    return F.when(root == ".", F.lit("#")).otherwise(flat)
