"""Directory trees on a shared mount as a data source, with excludes and filters that end in the listing.

``read_inventory`` gives the rows of ``listing.scan_inventory``. Directories near the roots are looked
through on the driver, for names of directories only, until there is a subtree for every task; then a
task lists a subtree, or the entries of one of the directories that were split. Nothing is written. A
tree with most of its entries in one deep directory is better listed level by level with
``scan_inventory``.

Conditions on ``root`` (equality, ``in``) and on the beginning of ``path`` keep whole subtrees from being
opened, as excluded suffixes do; conditions on the end of ``path`` and on ``type`` keep entries from
being looked at or sent. They are pushed if ``spark.sql.python.filterPushdown.enabled`` is set, and are
Spark's to apply otherwise.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    Not,
    StringEndsWith,
    StringStartsWith,
)

from ..schemas import INVENTORY
from .listing import BATCH_ROWS, _entry, normal_root

NAME = "snapledger_inventory"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ARROW = pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in INVENTORY.fields])


class Part(InputPartition):
    """A path below a root, with all below it (``deep``) or with its own entries but no directories."""

    def __init__(self, root: str, path: str, deep: bool, itself: bool):
        super().__init__((root, path))
        self.root, self.path, self.deep, self.itself = root, path, deep, itself


class InventoryReader(DataSourceReader):
    def __init__(self, roots: list[str], excludes: list[str], tasks: int):
        self.roots, self.excludes, self.tasks = roots, tuple(e for e in excludes if e), tasks
        self.begins: list[str] = []
        self.ends: list[str] = []
        self.not_ends: list[str] = []
        self.kinds: set[str] | None = None

    def enters(self, path: str) -> bool:
        """Whether anything below a directory can be wanted."""
        below = path.rstrip("/") + "/"
        return not path.endswith(self.excludes or ("\0",)) and all(
            below.startswith(b) or b.startswith(below) for b in self.begins
        )

    def wants(self, path: str) -> bool:
        return (
            all(path.startswith(b) for b in self.begins)
            and all(path.endswith(e) for e in self.ends)
            and not any(path.endswith(e) for e in self.not_ends)
        )

    def directories(self, path: str, most: int) -> list[str] | None:
        """Directories in a directory; None if they are more than ``most`` or can't be read."""
        found = []
        try:
            with os.scandir(path) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        found.append(os.path.join(path, entry.name))
                        if len(found) > most:
                            return None
        except OSError:
            return None
        return sorted(found)

    def partitions(self) -> list[Part]:
        most = 64 * self.tasks
        whole = [Part(root, root, True, True) for root in self.roots]
        split: list[Part] = []
        while whole and len(whole) < self.tasks:
            opened, kept = [], []
            for part in whole:
                is_tree = os.path.isdir(part.path) and not os.path.islink(part.path) and self.enters(part.path)
                below = self.directories(part.path, most) if is_tree else None
                if not below:
                    kept.append(part)
                    continue
                split.append(Part(part.root, part.path, False, part.itself))
                opened += [Part(part.root, p, True, False) for p in below]
            if not opened:
                whole = kept
                break
            whole = kept + opened
        return split + whole

    def entries(self, part: Part | None) -> Iterator[tuple]:
        """Entries of a part; a directory that cannot be read stands for itself. Without any root there is no part."""
        if part is None:
            return
        if part.itself and self.wants(part.path):
            yield _entry(part.root, part.path)
        if part.itself and (os.path.islink(part.path) or not os.path.isdir(part.path)):
            return
        pending = [part.path]
        while pending:
            directory = pending.pop()
            if not self.enters(directory):
                continue
            try:
                found = os.scandir(directory)
            except OSError:
                if self.wants(directory):
                    yield part.root, directory, "unreadable_directory", None, None, None, None, None
                continue
            with found:
                for entry in found:
                    path = os.path.join(directory, entry.name)
                    if self.wants(path):
                        yield _entry(part.root, path)
                    if part.deep and entry.is_dir(follow_symlinks=False):
                        pending.append(path)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self.entries(part):
            if self.kinds is None or row[2] in self.kinds:
                rows.append(row)
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r, strict=True)) for r in rows], ARROW)


class FilteringReader(InventoryReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for wanted in filters:
            if not self.push(wanted):
                yield wanted

    def push(self, wanted: Filter) -> bool:
        match wanted:
            case EqualTo(("root",), value):
                self.roots = [r for r in self.roots if r == value]
            case In(("root",), values):
                self.roots = [r for r in self.roots if r in values]
            case EqualTo(("type",), value):
                self.kinds = {value} if self.kinds is None else self.kinds & {value}
            case In(("type",), values):
                self.kinds = set(values) if self.kinds is None else self.kinds & set(values)
            case StringStartsWith(("path",), value):
                self.begins.append(value)
            case StringEndsWith(("path",), value):
                self.ends.append(value)
            case Not(StringEndsWith(("path",), value)):
                self.not_ends.append(value)
            case _:
                return False
        return True


class InventorySource(DataSource):
    """Options: ``roots`` and ``excludes`` as JSON lists, ``tasks``, and ``pushdown`` if filters are pushed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):  # noqa: ANN201
        return INVENTORY

    def reader(self, schema) -> InventoryReader:  # noqa: ANN001
        pushed = self.options.get("pushdown", "false") == "true"
        kind = FilteringReader if pushed else InventoryReader
        roots, excludes = (json.loads(self.options.get(n, "[]")) for n in ("roots", "excludes"))
        return kind(roots, excludes, int(self.options.get("tasks", "1")))


def read_inventory(
    spark: SparkSession, roots: list[str], excludes: list[str] = (), tasks: int | None = None
) -> DataFrame:
    """Inventory of all entries below ``roots``, as ``scan_inventory`` returns it, listed when it is read."""
    for root in roots:
        if "://" in root:
            raise ValueError(f"not a path on a mount: {root}")
    spark.dataSource.register(InventorySource)
    reader = spark.read.format(NAME).option("roots", json.dumps([normal_root(r) for r in roots]))
    reader = reader.option("excludes", json.dumps(list(excludes)))
    reader = reader.option("tasks", str(tasks or 4 * spark.sparkContext.defaultParallelism))
    return reader.option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower()).load()
