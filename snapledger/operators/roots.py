"""Checks on the roots of a run and on sets of snapshot paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_chain, parent_path
from .filters import mark_excluded
from .skew import HOT_ROWS, attach, count_rows


def overlapping_roots(
    roots: DataFrame,
    repo_path: str,
    excludes: list[str] | DataFrame = (),
    mode: str = "string",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One line per offending root: (root, other, problem).

    ``string`` compares raw text, so ``/data/ab`` counts as part of ``/data/a``; ``component``
    compares whole path components. Prefixes are matched by equality, not by comparing all pairs;
    the shortest covering root is reported.
    """
    known = roots.groupBy("root").agg(F.count(F.lit(1)).alias("times"))
    equal = known.where("times > 1").select(
        "root", F.col("root").alias("other"), F.lit("equal").alias("problem")
    )

    if mode == "string":
        size = F.length("root")
        cuts = F.when(size > 1, F.sequence(F.lit(1), size - 1))
        prefixes = known.select("root", F.explode(cuts).alias("_cut")).select(
            "root", F.expr("left(root, _cut)").alias("prefix")
        )
    else:
        above = F.filter(parent_chain(F.col("root")), lambda a: a != "")
        absolute = F.col("root").startswith("/") & (F.col("root") != "/")
        chain = F.when(absolute, F.concat(F.array(F.lit("/")), above)).otherwise(above)
        prefixes = known.select("root", F.explode(chain).alias("prefix"))
    covering = count_rows(prefixes, ["prefix"], "_n").join(
        known.select(F.col("root").alias("prefix"), F.lit(True).alias("is_root")), "prefix"
    )
    nested = (
        attach(prefixes, covering, ["prefix"], ["root"], "_n", hot_rows)
        .where("is_root")
        .groupBy("root")
        .agg(F.min("prefix").alias("other"))
        .withColumn("problem", F.lit("part_of_root"))
    )

    repo = F.lit(repo_path)
    if mode == "string":
        inside = F.col("root").startswith(repo)
        around = repo.startswith(F.col("root"))
    else:
        inside = (F.col("root") == repo) | F.col("root").startswith(repo_path.rstrip("/") + "/")
        around = (F.col("root") == repo) | (F.col("root") == "/") | repo.startswith(F.concat("root", F.lit("/")))
    excused = _ends_with_excluded(repo_path, excludes)
    in_repo = known.where(inside).select(
        "root", repo.alias("other"), F.lit("part_of_repository").alias("problem")
    )
    has_repo = known.where(around & ~excused).select(
        "root", repo.alias("other"), F.lit("contains_repository").alias("problem")
    )
    return equal.unionByName(nested).unionByName(in_repo).unionByName(has_repo)


def _ends_with_excluded(path: str, excludes):
    if isinstance(excludes, DataFrame):
        return excludes.where(F.lit(path).endswith(F.col("suffix"))).exists()
    return F.lit(any(path.endswith(s) for s in excludes if s))


def invalid_roots(
    roots: DataFrame, inventory: DataFrame, excludes: list[str] | DataFrame
) -> DataFrame:
    """Roots (root, problem) that are excluded themselves, are links, or are not there."""
    itself = inventory.where(F.col("path") == F.col("root")).select("root", "path", "type")
    marked = mark_excluded(itself, excludes).select("root", "type", "excluded_by")
    problem = (
        F.when(F.col("excluded_by").isNotNull(), "excluded")
        .when(F.col("type").isin("symlink", "junction"), "symlink")
        .when(F.col("type").isNull() | (F.col("type") == "not_found"), "missing")
    )
    found = roots.select("root").distinct().join(marked, "root", "left")
    return found.select("root", problem.alias("problem")).where("problem is not null")


def snapshot_set_checks(paths: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Problems (path, problem) in a list of snapshot paths against the known snapshots.

    ``paths`` has one line per named path; ``snapshots`` has (path, state).
    """
    named = paths.groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    twice = named.where("times > 1").select("path", F.lit("duplicate").alias("problem"))

    parents = named.select(parent_path(F.col("path")).alias("path")).distinct()
    several = parents.agg((F.count(F.lit(1)) > 1).alias("several")).scalar()
    mixed = parents.where(several).select("path", F.lit("mixed_repositories").alias("problem"))

    unknown = named.join(snapshots, "path", "left_anti").select(
        "path", F.lit("unknown").alias("problem")
    )
    unfinished = named.join(snapshots.where("state <> 'complete'"), "path", "left_semi").select(
        "path", F.lit("unfinished").alias("problem")
    )
    return twice.unionByName(mixed).unionByName(unknown).unionByName(unfinished)


def invalid_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots that keep a repository from opening: no manifest, or not finished."""
    problem = F.when(F.col("state").isNull(), "manifest_missing").when(
        F.col("state") != "complete", "unfinished"
    )
    return snapshots.withColumn("problem", problem).where("problem is not null").select("snapshot", "problem")
