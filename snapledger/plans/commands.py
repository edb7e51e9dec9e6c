"""The five commands on a stored repository, with states and versioned writes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from ..operators.lookup import target_standing
from ..operators.roots import invalid_roots, overlapping_roots
from ..operators.stats import STATS, action_stats, event_counts, exclusion_stats, stat_columns, stat_lines
from ..operators.tree import empty_directories
from ..operators.verify import Hasher, file_table, link_inventory
from ..schemas import DELETE, LINUX_MAX_LINKS, LINUX_MIN_BYTES, STORED
from ..session import stage
from ..sources.report import write_file_table
from ..sources.repository import COMPLETE, IN_PROGRESS, Repository
from . import jobs

BATCH_ROWS = 20_000_000


class Run(NamedTuple):
    """What a run did: its rows, files and bytes per measure, and warnings and errors.

    ``excluded`` counts what a snapshot left out by reason; ``emptied`` lists the directories that
    a distillation left without files.
    """

    rows: DataFrame
    stats: DataFrame
    events: DataFrame
    excluded: DataFrame | None = None
    emptied: DataFrame | None = None


def take_snapshot(
    repo: Repository,
    roots: DataFrame,
    inventory: DataFrame,
    excludes: list[str] | DataFrame,
    hasher: Hasher,
    at: datetime,
    incremental: bool = False,
    always_hash: bool = False,
    suffix: str | None = None,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    affinity: bool = True,
) -> Run:
    """Take a snapshot named after ``at``.

    ``inventory`` comes from ``scan_inventory``, which writes roots as they are written here.
    ``stored`` (snapshot, file, nlink) gives the link counts of the files in the repository.
    ``affinity`` links a file to the blob of the record it was found in, as ``jobs.take_snapshot`` says.
    """
    roots = roots.withColumn("root", normal_path(F.col("root")))
    name = at.strftime("%Y-%m-%d_%H-%M-%S") + (f"_{suffix}" if suffix else "")
    clash = overlapping_roots(roots, repo.path, excludes).take(1)
    if clash:
        raise ValueError(f"{clash[0].problem}: {clash[0].root} and {clash[0].other}")
    bad = invalid_roots(roots, inventory, excludes).take(1)
    if bad:
        raise ValueError(f"root is {bad[0].problem}: {bad[0].root}")
    signatures, contents = repo.summary("signatures"), _contents(repo, stored)
    generation = repo.begin([name], create=True)
    files = jobs.walk(roots, inventory, excludes, name)
    actions, stats = _counted(
        jobs.take_snapshot(
            files,
            signatures,
            hasher,
            name,
            incremental,
            always_hash,
            max_links,
            min_bytes,
            stored,
            affinity=affinity,
            contents=contents,
        )
    )
    repo.write(jobs.stored_rows(actions), generation)
    excluded = stage(jobs.left_out(inventory, excludes), "excluded")
    events = jobs.run_events(actions).unionByName(jobs.access_errors(excluded, name))
    return Run(actions, stats, event_counts(events), exclusion_stats(excluded))


def _contents(repo: Repository, stored: DataFrame | None) -> DataFrame:
    """Rows to search for hashes; links of files in the file system belong to rows, not to their summary."""
    return repo.summary("contents") if stored is None else repo.manifest()


def _counted(actions: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, staged, and their ``action_stats``, counted while they are written.

    Counting comes after any shuffle, where a task that is repeated counts once.
    """
    seen = Observation()
    ready = actions.hint("rebalance", *by) if by else actions
    rows = stage(ready.observe(seen, *stat_columns(actions)), "actions", by)
    return rows, rows.sparkSession.createDataFrame(stat_lines(seen.get), STATS)


def verify(
    repo: Repository,
    inventory: DataFrame,
    names: list[str] | None = None,
    hasher: Hasher | None = None,
    csv_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Problems and their counts; with ``csv_path`` the file table is written as well."""
    manifest = repo.manifest(names)
    order = names or repo.names()
    problems = stage(jobs.verify(manifest, inventory, hasher, order), "problems")
    if csv_path:
        linked = link_inventory(manifest, inventory)
        write_file_table(file_table(linked, order, order), order, csv_path)
    return problems, event_counts(problems)


def purge(repo: Repository, inventory: DataFrame, names: list[str], compact: bool = False) -> DataFrame:
    """Drop records of missing files from the named snapshots. Returns the dropped rows."""
    repo.check()
    standing = stage(jobs.purge_standing(repo.manifest(names, with_files=True), inventory), "standing")
    _rewrite(repo, names, standing, compact)
    return _dropped(standing)


def distill(
    repo: Repository, names: list[str], compact: bool = False, tree: DataFrame | None = None
) -> Run:
    """Reduce the named snapshots, in order. Returns the deleted rows.

    With ``tree`` (snapshot, file, type) of what is stored, directories without a file left are
    returned as ``emptied``.
    """
    repo.check()
    repo.check(names)
    standing = stage(target_standing(repo.manifest(with_files=True), names), "standing")
    dropped = _dropped(standing)
    _rewrite(repo, names, standing, compact)
    deleted = dropped.withColumn("action", F.lit(DELETE))
    emptied = None if tree is None else empty_directories(tree, dropped)
    return Run(dropped, action_stats(deleted), event_counts(jobs.run_events(deleted)), emptied=emptied)


def _dropped(standing: DataFrame) -> DataFrame:
    return standing.where("not stays").drop("stays", "stored_in")


def _rewrite(repo: Repository, names: list[str], standing: DataFrame, compact: bool) -> None:
    """Write the files that lost rows again; to compact, all rows of the named snapshots."""
    kept = jobs.staying(standing)
    if compact:
        repo.write(kept, repo.begin(names))
        return
    # a line per file, however many rows
    place = ["snapshot", "stored_in"]
    hit = standing.where("not stays").select(*place).distinct()
    files: dict[str, list[str]] = {}
    for row in hit.collect():
        files.setdefault(row.snapshot, []).append(row.stored_in)
    if files:
        repo.replace(kept.join(F.broadcast(hit), place, "left_semi"), files)


def compact(repo: Repository, names: list[str]) -> None:
    """Rewrite snapshots in the storage layout."""
    rows = repo.manifest(names)
    repo.write(rows, repo.begin(names))


def clone(
    source: Repository,
    target: Repository,
    run: str,
    incremental: bool = False,
    suffix: str | None = None,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    affinity: bool = True,
    resume: bool = False,
    batch_rows: int = BATCH_ROWS,
) -> Run:
    """Clone all snapshots of ``source`` into ``target``; ``stored``, ``affinity`` as in ``take_snapshot``.

    All snapshots are decided on together, then stored in their order, a snapshot of ``batch_rows`` rows
    or more at a time and smaller ones together up to that many, so those that are finished stay when a
    later one fails. With ``resume`` a clone that broke is continued: snapshots
    that the target has are left as they are, one that was left unfinished is begun anew, and the rest
    is decided against what the target has by now. ``run`` must be a new name then, too.
    """
    names = {n: n + (f"_{suffix}" if suffix else "") for n in source.names()}
    if resume:
        states = {r.snapshot: r.state for r in target.snapshots().collect()}
        for name in names.values():
            if states.get(name) == IN_PROGRESS:
                target.delete_snapshot(name)
        names = {n: new for n, new in names.items() if states.get(new) != COMPLETE}
    else:
        taken = set(target.names()) & set(names.values())
        if taken:
            raise ValueError(f"snapshot already exists: {min(taken)}")
    rows, signatures = source.manifest(list(names)), target.summary("signatures")
    decided = jobs.clone(
        rows, signatures, run, incremental, suffix, max_links, min_bytes, stored, affinity=affinity, contents=_contents(target, stored)
    )
    actions, stats = _counted(decided, by=["snapshot"])
    kept = actions.where(F.col("action").isin(STORED))
    counts = {r.snapshot: r["count"] for r in kept.groupBy("snapshot").count().collect()}
    for batch in _batches(sorted(names.values()), counts, batch_rows):
        target.write(kept.where(F.col("snapshot").isin(batch)), target.begin(batch, create=True))
    return Run(actions, stats, event_counts(jobs.run_events(actions)))


def _batches(names: list[str], counts: dict[str, int], most: int) -> Iterator[list[str]]:
    """Names in order, as many at a time as have ``most`` rows together, one at least."""
    batch, size = [], 0
    for name in names:
        if batch and size + counts.get(name, 0) > most:
            yield batch
            batch, size = [], 0
        batch.append(name)
        size += counts.get(name, 0)
    if batch:
        yield batch
