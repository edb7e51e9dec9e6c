"""A repository of snapshots: one manifest table, summaries of it for lookups, and a small log of states."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import blob_name, hash_is_set, newest_per_signature
from ..schemas import MANIFEST, SIGNATURE, SNAPSHOT_LOG

IN_PROGRESS = "in_progress"
COMPLETE = "complete"
DELETED = "deleted"
# Few by default, since each snapshot has a file per bucket and summary.
BUCKETS = 8
COMMIT_TRIES = 20
COMMIT_WAIT = 0.1

# Per summary, the columns its files are bucketed by, and its schema.
SUMMARIES = {
    "signatures": (SIGNATURE, "source string, size bigint, mtime_ns bigint, hash string, blob_id string"),
    "contents": (["hash"], "hash string, blob_id string, size bigint, n_links bigint"),
}
PARTITIONS = ["snapshot", "generation"]


class Mark(NamedTuple):
    """What a log line says of a snapshot.

    Its rows are the files of ``generation`` and those of the earlier generations in ``bases``, except
    the files named in ``without`` (as ``generation=<n>/<name>``).
    """

    state: str
    generation: int
    bases: tuple[int, ...] = ()
    without: tuple[str, ...] = ()


class Conflict(ValueError):
    """Another writer came first."""


def arrange(manifest: DataFrame) -> DataFrame:
    """Rows laid out for storage: even parts per snapshot, ordered by hash inside each part.

    The rebalance hint splits a large snapshot over many tasks and joins small ones. The order
    begins with the partition columns, so the write has no reason to sort again.
    """
    order = ["snapshot", "generation", "hash", "file"]
    return manifest.hint("rebalance", "snapshot").sortWithinPartitions(*order)


def summarise(manifest: DataFrame, kind: str) -> DataFrame:
    """What lookups need of the rows, reduced per snapshot: a line per signature, or per blob of a content.

    Summaries of several snapshots together give the same lookups as the rows: the newest record of a
    signature, and links, sizes and snapshots of a blob, are maxima, minima and sums over snapshots.
    """
    if kind == "signatures":
        top = newest_per_signature(manifest, True, by=PARTITIONS)
        return top.select(*SIGNATURE, F.col("prior_hash").alias("hash"), F.col("prior_blob").alias("blob_id"), *PARTITIONS)
    rows = manifest.where(hash_is_set(F.col("hash")))
    blobs = rows.groupBy("hash", blob_name(rows).alias("blob_id"), *PARTITIONS)
    held = blobs.agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n_links"))
    return held.select("hash", "blob_id", "size", "n_links", *PARTITIONS)


class Repository:
    """Manifest rows live in ``manifest/snapshot=<name>/generation=<n>``.

    A rewrite (delete, compaction) goes to a new generation of the snapshots it touches; the entry
    added to the log afterwards makes it current, so a path being read is never overwritten, and
    ``vacuum`` removes what is no longer read. Where rows go, only the files that hold them are written
    again; the new generation is based on those before it, without these files. A snapshot whose last line is ``in_progress`` was left
    unfinished and keeps the repository from opening until it is deleted.

    Every log entry is a file named by its number, created only if there is none of that name; of two
    writers that have read the same state one wins, and the other looks again. The file system must
    refuse to create a file that exists, as HDFS does.

    Next to the rows, each generation has two summaries (see ``summarise``) in the same layout, in
    ``signatures`` and ``contents``, bucketed by what lookups join on. Snapshots are so summarised once,
    when they are written, and a long run's lookups shuffle no line of what is stored, if there are at
    least as many buckets as shuffle partitions. To Spark, the current generations are an external
    table of the session's catalog, named after their list.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = False, buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets: int | None = None
        if create and not self._exists("log"):
            stored = T.StructType([*MANIFEST.fields, T.StructField("generation", T.LongType())])
            self._empty(stored).write.mode("ignore").partitionBy(*PARTITIONS).parquet(f"{self.path}/manifest")
            self._create("buckets", str(buckets or BUCKETS))
            place, files = self._folder(f"{self.path}/log")
            files.mkdirs(place)

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _exists(self, name: str) -> bool:
        place, files = self._folder(f"{self.path}/{name}")
        return files.exists(place)

    def _create(self, name: str, text: str) -> bool:
        """Write a small file, unless there is one of that name."""
        place, files = self._folder(f"{self.path}/{name}")
        try:
            out = files.create(place, False)
        except Py4JJavaError as error:
            if files.exists(place):
                return False
            raise error
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def _entries(self) -> list[int]:
        """Numbers of the log's entries.

        An entry that is still empty is being written; one that stays so was left by a run that broke,
        and says nothing.
        """
        place, files = self._folder(f"{self.path}/log")
        for attempt in range(COMMIT_TRIES):
            found = {f.getPath().getName(): f.getLen() for f in files.listStatus(place)}
            if any(name.endswith(".parquet") for name in found):
                raise ValueError(f"the log was written by an earlier version: {self.path}")
            sizes = {int(n.removesuffix(".json")): size for n, size in found.items() if n.removesuffix(".json").isdigit()}
            if all(sizes.values()) or attempt == COMMIT_TRIES - 1:
                break
            time.sleep(COMMIT_WAIT)
        return sorted(sizes)

    def _entry(self, number: int) -> str:
        return f"log/{number:012d}.json"

    def _log(self, entries: list[int] | None = None) -> DataFrame:
        """Lines of the given entries. One that was not written to its end has no line that can be read."""
        entries = self._entries() if entries is None else entries
        if not entries:
            return self._empty(SNAPSHOT_LOG)
        paths = [f"{self.path}/{self._entry(n)}" for n in entries]
        return self.spark.read.schema(SNAPSHOT_LOG).json(paths).where(F.col("snapshot").isNotNull() & F.col("state").isNotNull())

    def snapshots(self) -> DataFrame:
        """Current (snapshot, state, generation), without deleted ones."""
        last = self._log().groupBy("snapshot").agg(
            F.max(F.struct("seq", "state", "generation")).alias("l")
        )
        return last.select("snapshot", "l.state", "l.generation").where(F.col("state") != DELETED)

    def _states(self, entries: list[int] | None = None) -> dict[str, Row]:
        """Last log line of every snapshot, deleted ones too: one line each, however many rows."""
        last = F.max(F.struct("seq", "state", "generation", "bases", "without")).alias("l")
        lines = self._log(entries).groupBy("snapshot").agg(last, F.max("generation").alias("highest"))
        return {r.snapshot: r for r in lines.select("snapshot", "highest", "l.*").collect()}

    def _open(self, names: list[str] | None = None) -> dict[str, Row]:
        known = {n: r for n, r in self._states().items() if r.state != DELETED}
        if names is not None:
            if len(set(names)) != len(names):
                raise ValueError("a snapshot is named twice")
            missing = [n for n in names if n not in known]
            if missing:
                raise ValueError(f"snapshot not in repository: {missing[0]}")
            known = {n: known[n] for n in names}
        for name, line in known.items():
            if line.state != COMPLETE:
                raise ValueError(f"snapshot is unfinished: {name}")
        return known

    def check(self, names: list[str] | None = None) -> None:
        """Raise if a snapshot is unfinished (the named ones only, if given) or not there."""
        self._open(names)

    def names(self) -> list[str]:
        """Snapshot names in order."""
        return sorted(n for n, r in self._states().items() if r.state != DELETED)

    def manifest(self, names: list[str] | None = None, with_files: bool = False) -> DataFrame:
        """Rows of all, or the named, snapshots; only current partitions are listed.

        ``with_files`` adds ``stored_in``, the name of a row's file (see ``Mark``).
        """
        parts = self._parts(self._open(names), self._partitions())
        rows = self._read(parts) if parts else self._empty(MANIFEST)
        if not with_files:
            return rows.select(*MANIFEST.names)
        place = F.regexp_extract(F.col("_metadata.file_path"), "/(generation=[0-9]+/[^/]+)$", 1) if parts else F.lit("")
        return rows.select(*MANIFEST.names, place.alias("stored_in"))

    def _parts(self, current: dict[str, Row], there: dict[tuple[str, int], str]) -> list[str]:
        """Folders to read; single files of the generations that a later one is based on."""
        found = []
        for name, line in current.items():
            if (name, line.generation) in there:
                found.append(there[name, line.generation])
            gone = set(line.without or ())
            for base in line.bases or ():
                if (name, base) in there:
                    place, files = self._folder(there[name, base])
                    inside = [f.getPath() for f in files.listStatus(place)]
                    kept = [p for p in inside if p.getName()[0] not in "._" and f"generation={base}/{p.getName()}" not in gone]
                    found += [p.toString() for p in kept]
        return found

    def _read(self, parts: list[str]) -> DataFrame:
        stored = T.StructType([*MANIFEST.fields, T.StructField("generation", T.LongType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/manifest").parquet(*parts)

    def _folder(self, path: str):
        """A folder and its file system, through Spark's own access to files."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _partitions(self, kind: str = "manifest") -> dict[tuple[str, int], str]:
        """Folder of every stored (snapshot, generation): two levels of names, no files."""
        place, files = self._folder(f"{self.path}/{kind}")
        found = {}
        for outer in files.listStatus(place) if files.exists(place) else []:
            if not outer.getPath().getName().startswith("snapshot="):
                continue
            name = unquote(outer.getPath().getName().removeprefix("snapshot="))
            for inner in files.listStatus(outer.getPath()):
                number = inner.getPath().getName().removeprefix("generation=")
                if number.isdigit():
                    found[name, int(number)] = inner.getPath().toString()
        return found

    def _buckets(self) -> int | None:
        """Number of buckets of the summaries; None in a repository without any."""
        if self.buckets is None and self._exists("buckets"):
            self.buckets = int(self.spark.read.text(f"{self.path}/buckets").first()[0])
        return self.buckets

    def _table(self, kind: str, name: str, buckets: int) -> None:
        keys, columns = SUMMARIES[kind]
        place = self.path.replace("'", "\\'")
        self.spark.sql(
            f"create table if not exists `{name}` ({columns}, snapshot string, generation bigint) using parquet"
            f" partitioned by (snapshot, generation) clustered by ({', '.join(keys)}) sorted by ({', '.join(keys)})"
            f" into {buckets} buckets location '{place}/{kind}'"
        )

    def summary(self, kind: str, names: list[str] | None = None) -> DataFrame:
        """``signatures`` or ``contents`` of all, or the named, snapshots; their rows stand in for the manifest's.

        Snapshots that were stored without one are summarised on the way.
        """
        lines = self._open(names)
        current = {(n, r.generation) for n, r in lines.items()}
        buckets = self._buckets()
        there = {} if buckets is None else self._partitions(kind)
        parts = {place: there[place] for place in sorted(current) if place in there}
        bare = self._parts({n: r for n, r in lines.items() if (n, r.generation) not in there}, self._partitions())
        found = None
        if parts or not bare:
            list_hash = hashlib.sha256(json.dumps([self.path, sorted(parts)]).encode()).hexdigest()[:16]
            name = f"snapledger_{kind}_{list_hash}"
            self._table(kind, name, buckets or 1)
            escape = lambda text: text.replace("\\", "\\\\").replace("'", "\\'")
            added = [f"partition (snapshot='{escape(n)}', generation={g}) location '{escape(p)}'" for (n, g), p in parts.items()]
            if added:
                self.spark.sql(f"alter table `{name}` add if not exists {' '.join(added)}")
            found = self.spark.table(name)
        if bare:
            rows = self._read(bare)
            found = summarise(rows, kind) if found is None else found.unionByName(summarise(rows, kind))
        return found.drop("generation")

    def vacuum(self, keep: int = 0) -> list[str]:
        """Remove generations that the log no longer names; returns their folders.

        ``keep`` older generations of a snapshot stay, for readers that began earlier. Unfinished
        snapshots are left alone, as is everything of a snapshot whose last line is in progress.
        """
        states = self._states()
        gone = []
        summaries = {kind: self._partitions(kind) for kind in SUMMARIES}
        for (name, generation), path in sorted(self._partitions().items()):
            line = states.get(name)
            if line is None or line.state == IN_PROGRESS:
                continue
            # a deleted snapshot's line carries its last number, which is no longer read either
            current = line.generation if line.state == COMPLETE else line.generation + 1
            based_on = line.state == COMPLETE and generation in (line.bases or ())
            if generation < current - keep and not based_on:
                for kind in ("manifest", *SUMMARIES):
                    old = path if kind == "manifest" else summaries[kind].get((name, generation))
                    if old:
                        place, files = self._folder(old)
                        files.delete(place, True)
                gone.append(path)
        return gone

    def _record(self, states: dict[str, Mark], entries: list[int]) -> None:
        """Add an entry after those that were read; raises ``Conflict`` if another writer has done so."""
        number = max(entries, default=0) + 1
        lines = [
            json.dumps({"seq": number, "snapshot": name, **{k: v for k, v in mark._asdict().items() if v != ()}})
            for name, mark in states.items()
        ]
        if not self._create(self._entry(number), "\n".join(lines) + "\n"):
            raise Conflict(f"entry {number} of the log was written by another run")

    def _commit(self, decide: Callable[[dict[str, Row]], dict[str, Mark]]) -> dict[str, Mark]:
        """Record what ``decide`` makes of the states; decides anew when another writer came first."""
        for attempt in range(COMMIT_TRIES):
            entries = self._entries()
            new = decide(self._states(entries))
            try:
                self._record(new, entries)
                return new
            except Conflict:
                if attempt == COMMIT_TRIES - 1:
                    raise
        raise AssertionError

    def begin(self, names: list[str], create: bool = False) -> dict[str, int]:
        """Mark snapshots in progress; returns the generation each will be written to."""

        def decide(known: dict[str, Row]) -> dict[str, Mark]:
            for name in names:
                state = known[name].state if name in known else DELETED
                if create and state != DELETED:
                    raise ValueError(f"snapshot already exists: {name}")
                if not create and state != COMPLETE:
                    raise ValueError(f"snapshot is not open for changes: {name}")
            # the mark carries the new number, so what a broken run left is never written to again
            return {n: Mark(IN_PROGRESS, (known[n].highest if n in known else 0) + 1) for n in names}

        return {name: mark.generation for name, mark in self._commit(decide).items()}

    def replace(self, rows: DataFrame, files: dict[str, list[str]]) -> None:
        """Store ``rows`` in place of the rows in some files (``stored_in``) of each snapshot; other files stay."""
        before = self._open(list(files))
        bases = {n: Mark(COMPLETE, 0, (*(r.bases or ()), r.generation), (*(r.without or ()), *files[n])) for n, r in before.items()}
        self.write(rows, self.begin(list(files)), bases)

    def write(self, rows: DataFrame, generations: dict[str, int], bases: dict[str, Mark] | None = None) -> None:
        """Store rows of snapshots that are in progress, with their summaries, and finish these snapshots.

        A row of any other snapshot, or of none, makes the write fail before anything is recorded, as
        does a snapshot that was deleted or begun anew meanwhile. ``bases`` name what stays of earlier
        generations (see ``replace``).
        """
        marks = {n: (bases or {}).get(n, Mark(COMPLETE, g))._replace(generation=g) for n, g in generations.items()}
        lines = [(name, generation) for name, generation in generations.items()]
        new = self.spark.createDataFrame(lines, "snapshot string, begun long")
        stray = F.concat(F.lit("row of a snapshot that was not begun: "), F.coalesce("snapshot", F.lit("null")))
        number = F.coalesce("begun", F.raise_error(stray).cast("long"))
        joined = rows.select(*MANIFEST.names).join(F.broadcast(new), "snapshot", "left")
        stored = joined.withColumn("generation", number).drop("begun")
        writer = arrange(stored).write.mode("append").partitionBy(*PARTITIONS)
        # a lookup of one hash skips row groups; small files get small filters
        writer = writer.option("parquet.bloom.filter.enabled#hash", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.path}/manifest")
        self._summarise(marks)

        def decide(known: dict[str, Row]) -> dict[str, Mark]:
            for name, generation in generations.items():
                line = known.get(name)
                if line is None or (line.state, line.generation) != (IN_PROGRESS, generation):
                    raise ValueError(f"snapshot is no longer in progress: {name}")
            return marks

        self._commit(decide)

    def _summarise(self, marks: dict[str, Mark]) -> None:
        buckets, parts = self._buckets(), self._parts(marks, self._partitions())
        if buckets is None or not parts:
            return
        numbers = self.spark.createDataFrame([(n, m.generation) for n, m in marks.items()], "snapshot string, generation long")
        rows = self._read(parts).drop("generation").join(F.broadcast(numbers), "snapshot")
        for kind, (keys, _) in SUMMARIES.items():
            # a table of its own, so that what is written is not added to one that is being read
            name = f"snapledger_{kind}_{uuid.uuid4().hex}"
            self._table(kind, name, buckets)
            lines = summarise(rows, kind).repartition(buckets, *keys)
            lines.sortWithinPartitions(*PARTITIONS, *keys).write.insertInto(name)
            self.spark.sql(f"drop table `{name}`")

    def delete_snapshot(self, name: str) -> None:
        self._commit(lambda known: {name: Mark(DELETED, known[name].highest)})
