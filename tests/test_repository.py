"""The commands on a stored repository, fed from a real directory tree."""

import hashlib
import os
import shutil
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snapledger.operators import lookup, skew
from snapledger.operators.stats import action_stats
from snapledger.operators.verify import file_table, link_inventory
from snapledger.plans import commands
from snapledger.schemas import MANIFEST
from snapledger.sources import content
from snapledger.sources.content import file_hasher
from snapledger.sources.listing import scan_inventory
from snapledger.sources.report import read_file_table, write_file_table
from snapledger.sources.repository import Conflict, Mark, Repository


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "data"
    (top / "sub" / "deep").mkdir(parents=True)
    (top / "cache_SKIP" / "in").mkdir(parents=True)
    (top / "a.txt").write_bytes(b"alpha")
    (top / "copy.txt").write_bytes(b"alpha")
    (top / ".hidden").write_bytes(b"h")
    (top / "empty").write_bytes(b"")
    (top / "sub" / "b.txt").write_bytes(b"beta" * 400_000)
    (top / "sub" / "deep" / "c.txt").write_bytes(b"gamma")
    (top / "cache_SKIP" / "in" / "x").write_bytes(b"x")
    os.symlink(top / "a.txt", top / "link")
    os.symlink(top / "sub", top / "dirlink")
    os.utime(top / "a.txt", ns=(1_704_067_200_123_456_789, 1_704_067_200_123_456_789))
    return top


def test_listing(spark, tree, tmp_path):
    single = tmp_path / "one.txt"
    single.write_bytes(b"1")
    got = scan_inventory(spark, [str(tree), str(single)], ["_SKIP"]).collect()
    kinds = {os.path.relpath(r.path, tmp_path): r.type for r in got}
    assert kinds == {
        "data": "directory",
        "one.txt": "regular",
        "data/sub": "directory",
        "data/sub/deep": "directory",
        "data/cache_SKIP": "directory",
        "data/a.txt": "regular",
        "data/copy.txt": "regular",
        "data/.hidden": "regular",
        "data/empty": "regular",
        "data/sub/b.txt": "regular",
        "data/sub/deep/c.txt": "regular",
        "data/link": "symlink",
        "data/dirlink": "symlink",
    }
    a = next(r for r in got if r.path.endswith("/a.txt"))
    assert (a.size, a.mtime_ns, a.inode) == (5, 1_704_067_200_123_456_789, os.stat(a.path).st_ino)


def test_file_hashes(spark, tree):
    names = [str(tree / "sub" / "b.txt"), str(tree / "empty"), str(tree / "missing"), str(tree / "a.txt")]
    rows = spark.createDataFrame([(n, 1_704_067_200_123_456_789) for n in names] + [(None, None)], "source string, t long")
    got = {r.source: r for r in file_hasher(F.col("source"))(rows.where("source is not null")).collect()}
    assert got[names[0]].content_hash == hashlib.sha256(b"beta" * 400_000).hexdigest()
    assert got[names[1]].content_hash == hashlib.sha256(b"").hexdigest()
    assert got[names[2]].content_hash is None and got[names[2]].now_size is None
    assert got[names[3]].now_mtime_ns == got[names[3]].t == 1_704_067_200_123_456_789


def test_reading_a_file_that_changes(tmp_path, monkeypatch):
    """A reading counts only if size, time and file are the same before and after it."""
    path = tmp_path / "f"
    path.write_bytes(b"one")
    digest = hashlib.sha256
    sha = lambda b: digest(b).hexdigest()
    assert content.read_stable(str(path)) == (sha(b"one"), 3, os.stat(path).st_mtime_ns, "steady")
    assert content.read_stable(str(tmp_path / "none")) == (None, None, None, "unreadable")
    changes = []

    class Disturbed:
        """Stands for another process that writes while the bytes are read."""

        def __init__(self):
            self.inner = digest()

        def update(self, chunk):
            self.inner.update(chunk)
            if changes:
                changes.pop()()

        def hexdigest(self):
            return self.inner.hexdigest()

    monkeypatch.setattr(content.hashlib, "sha256", Disturbed)
    changes[:] = [lambda: path.write_bytes(b"three")]
    state = content.read_stable(str(path), 3, 0)
    assert state == (sha(b"three"), 5, os.stat(path).st_mtime_ns, "steady")

    def replace():
        (tmp_path / "g").write_bytes(b"other")
        os.utime(tmp_path / "g", ns=(os.stat(path).st_mtime_ns,) * 2)
        os.replace(tmp_path / "g", path)

    changes[:] = [replace]
    assert content.read_stable(str(path), 3, 0)[::3] == (sha(b"other"), "steady")
    changes[:] = [lambda n=n: os.utime(path, ns=(n, n)) for n in range(3)]
    assert content.read_stable(str(path), 3, 0)[::3] == (None, "unstable")
    changes[:] = [path.unlink]
    assert content.read_stable(str(path), 3, 0)[3] == "unreadable"


def test_growing_file_in_a_snapshot(spark, tree, tmp_path):
    """A file that another process keeps writing to is left out as unstable; all others are stored."""
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    busy = tree / "busy.log"
    busy.write_bytes(b"x" * 30_000_000)
    stop = threading.Event()

    def write():
        with open(busy, "ab", buffering=0) as handle:
            while not stop.wait(0.001):
                handle.write(b"y")

    writer = threading.Thread(target=write)
    writer.start()
    try:
        given = spark.createDataFrame([(0, str(tree))], "ord int, root string")
        inventory = scan_inventory(spark, [str(tree)], ["_SKIP"])
        hasher = file_hasher(F.col("source"), tries=2, wait=0.01)
        run = commands.take_snapshot(repo, given, inventory, ["_SKIP"], hasher, datetime(2024, 1, 1))
        actions = {os.path.basename(r.source): r.action for r in run.rows.collect()}
    finally:
        stop.set()
        writer.join()
    assert actions.pop("busy.log") == "unstable"
    assert set(actions.values()) == {"import", "dup_link"} and len(actions) == 6
    assert [(r.errors) for r in run.events.where("snapshot = '*'").collect()] == [1]
    assert "busy.log" not in {os.path.basename(r.source) for r in repo.manifest().collect()}


def test_change_between_listing_and_reading(spark, tree, tmp_path):
    """What was read is stored with the size and time it was read with, and compared by these."""
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    given = spark.createDataFrame([(0, str(tree))], "ord int, root string")
    listed = spark.createDataFrame(scan_inventory(spark, [str(tree)], ["_SKIP"]).collect())
    (tree / "a.txt").write_bytes(b"longer than before")
    commands.take_snapshot(repo, given, listed, ["_SKIP"], file_hasher(F.col("source")), datetime(2024, 1, 1))
    row = next(r for r in repo.manifest().collect() if r.source.endswith("/a.txt"))
    assert (row.size, row.hash) == (18, hashlib.sha256(b"longer than before").hexdigest())
    assert row.mtime_ns == os.stat(tree / "a.txt").st_mtime_ns


@pytest.mark.parametrize("sizes", [[5] * 200, [100] * 7 + [1] * 300, [10_000, 51, 49, 50, 1], [0, 0, None], [], [7]])
def test_files_are_dealt_by_bytes(spark, sizes):
    rows = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sizes)], "path string, size long")
    packed = content.pack_by_bytes(rows, 100).collect()
    assert sorted(r.path for r in packed) == sorted(r.path for r in rows.collect())
    parts = {}
    for r in packed:
        parts.setdefault(r._part, []).append(r.size or 0)
    assert all(sum(p) <= 150 or len(p) == 1 for p in parts.values())
    assert len(parts) <= 2 * (sum(s or 0 for s in sizes) // 100 + 1) + 1
    spread = content.spread_by_bytes(rows, 100).withColumn("at", F.spark_partition_id())
    held = {}
    for r in spread.collect():
        held.setdefault(r["at"], []).append(r["size"] or 0)
    assert sorted(map(sorted, held.values())) == sorted(map(sorted, parts.values()))


def run_snapshot(spark, repo, tree, minute, **options):
    given = spark.createDataFrame([(0, str(tree))], "ord int, root string")
    inventory = scan_inventory(spark, [str(tree)], ["_SKIP"])
    return commands.take_snapshot(
        repo, given, inventory, ["_SKIP"], file_hasher(F.col("source")), datetime(2024, 1, 1, 0, minute), **options
    )


def counts(df):
    return {r.measure: r.files for r in df.collect()}


def test_life_of_a_repository(spark, tree, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    assert repo.manifest().count() == 0
    _, stats, events, excluded, _ = run_snapshot(spark, repo, tree, 1)
    assert {r.reason for r in excluded.collect()} >= {"suffix", "symlink"}
    assert [tuple(r) for r in events.collect()] == [("*", 0, 0)]
    assert counts(stats) == {"hashed": 6, "copied": 5, "linked": 1, "deleted": 0}
    first = "2024-01-01_00-01-00"
    assert repo.names() == [first]

    # unchanged but for one file
    (tree / "sub" / "b.txt").write_bytes(b"new")
    _, stats, *_ = run_snapshot(spark, repo, tree, 2, incremental=True, suffix="inc")
    second = "2024-01-01_00-02-00_inc"
    assert counts(stats) == {"hashed": 1, "copied": 1, "linked": 0, "deleted": 0}
    assert [r.file.split("/")[-1] for r in repo.manifest([second]).collect()] == ["b.txt"]
    _, stats, *_ = run_snapshot(spark, repo, tree, 3)
    third = "2024-01-01_00-03-00"
    assert counts(stats) == {"hashed": 0, "copied": 0, "linked": 6, "deleted": 0}
    assert repo.manifest().count() == 13 and repo.names() == [first, second, third]

    # stored files: one physical id per blob
    stored = repo.manifest().select(
        "snapshot", "file", F.abs(F.xxhash64("blob_id")).alias("inode"), F.lit(1).alias("nlink")
    )
    report = str(tmp_path / "table")
    problems, events = commands.verify(repo, stored, csv_path=report)
    assert problems.count() == 0
    assert [tuple(r) for r in events.collect()] == [("*", 0, 0)]
    table = read_file_table(spark, repo.names(), report)
    assert table.count() == 6
    assert table.select(F.sum(first), F.sum(second), F.sum(third)).first() == (6, 1, 6)

    # a stored file vanishes
    lost = stored.where(~(F.col("file").endswith("/c.txt") & (F.col("snapshot") == third)))
    problems, _ = commands.verify(repo, lost, [first, third])
    assert [(r.check, r.snapshot) for r in problems.collect()] == [("unreadable_index", third)]
    assert commands.purge(repo, lost, [first, third], compact=True).count() == 1
    assert repo.manifest().count() == 12 and repo.manifest([third]).count() == 5
    assert commands.purge(repo, lost, [third]).count() == 0

    before = {r.hash for r in repo.manifest().collect()}
    dropped, stats, *_ = commands.distill(repo, [first, third])
    assert counts(stats)["deleted"] == dropped.count() > 0
    assert {r.hash for r in repo.manifest().collect()} == before
    again, *_ = commands.distill(repo, [first, third])
    assert again.count() == 0

    other = Repository(spark, str(tmp_path / "other"), create=True)
    _, stats, *_ = commands.clone(repo, other, "clone", suffix="c")
    assert counts(stats)["copied"] == len(before)
    assert other.names() == [n + "_c" for n in repo.names()]
    assert other.manifest().count() == repo.manifest().count()
    with pytest.raises(ValueError, match="already exists"):
        commands.clone(repo, other, "clone2", suffix="c")

    rows = sorted(repo.manifest().collect())
    commands.compact(repo, repo.names())
    assert sorted(repo.manifest().collect()) == rows
    repo.delete_snapshot(second)
    assert repo.names() == [first, third]
    assert second not in {r.snapshot for r in repo.manifest().collect()}


def test_unfinished_snapshot_keeps_the_repository_closed(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    repo.begin(["s1"], create=True)
    with pytest.raises(ValueError, match="unfinished: s1"):
        repo.manifest()
    repo.delete_snapshot("s1")
    assert repo.manifest().count() == 0
    assert repo.begin(["s1"], create=True) == {"s1": 2}
    repo.delete_snapshot("s1")
    with pytest.raises(ValueError, match="not in repository"):
        repo.check(["s1"])
    rows = spark.createDataFrame([("s1", "/a", 1, 1, "a" * 64, "x", "b")], MANIFEST)
    repo.write(rows, repo.begin(["s1", "none"], create=True))
    assert repo.manifest().count() == 1 and repo.manifest(["none"]).count() == 0
    with pytest.raises(ValueError, match="twice"):
        repo.check(["s1", "s1"])


def test_a_failed_run_leaves_the_mark(spark, tree, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    given = spark.createDataFrame([(0, str(tree))], "ord int, root string")

    def broken(rows):
        raise RuntimeError("disk gone")

    with pytest.raises(RuntimeError):
        commands.take_snapshot(repo, given, scan_inventory(spark, [str(tree)]), [], broken, datetime(2024, 1, 1))
    with pytest.raises(ValueError, match="unfinished"):
        repo.manifest()


def test_overlapping_roots_stop_a_snapshot(spark, tree, tmp_path):
    repo = Repository(spark, str(tree / "repo"), create=True)
    with pytest.raises(ValueError, match="contains_repository"):
        run_snapshot(spark, repo, tree, 1)


def test_roots_that_cannot_be_taken(spark, tree, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)

    def attempt(path, excludes=()):
        given = spark.createDataFrame([(0, str(path))], "ord int, root string")
        inventory = scan_inventory(spark, [str(path)], list(excludes))
        hasher = file_hasher(F.col("source"))
        commands.take_snapshot(repo, given, inventory, list(excludes), hasher, datetime(2024, 1, 1))

    with pytest.raises(ValueError, match="root is missing"):
        attempt(tree / "nowhere")
    with pytest.raises(ValueError, match="root is symlink"):
        attempt(tree / "dirlink")
    with pytest.raises(ValueError, match="root is excluded"):
        attempt(tree / "sub", ["/sub"])
    assert repo.names() == []


def test_quotes_in_the_file_table(spark, tmp_path):
    odd = 'a "quoted", name'
    rows = spark.createDataFrame([("s1", odd, 1, 0, "a" * 64, odd, None)], MANIFEST)
    there = spark.createDataFrame([("s1", odd, 5)], "snapshot string, file string, inode long")
    table = file_table(link_inventory(rows, there), ["s1"])
    write_file_table(table, ["s1"], str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"a ""quoted"", name"' in text
    assert read_file_table(spark, ["s1"], str(tmp_path / "csv")).first()["first source"] == odd


def rows_of(spark, names, n=30, shift=0):
    lines = [
        (name, f"/p/{i + shift}", 10 + i % 3, i, f"{i % 7:064x}", f"f{i + shift}", f"b{i % 4}" if i % 5 else None)
        for name in names
        for i in range(n)
    ]
    return spark.createDataFrame(lines, MANIFEST)


def lookups(repo):
    """What lookups find in the summaries, and in the rows."""
    newest = [lookup.newest_per_signature(t, True) for t in (repo.summary("signatures"), repo.manifest())]
    held = [lookup.blobs(t, 50, 11) for t in (repo.summary("contents"), repo.manifest())]
    same = lambda tables: [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in tables]
    return same(newest), same(held)


def check_summaries(repo):
    for found, expected in lookups(repo):
        assert found == expected


def test_summaries_follow_every_change(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "a repo's"), create=True)
    check_summaries(repo)
    repo.write(rows_of(spark, ["s1", "s2"]), repo.begin(["s1", "s2", "empty"], create=True))
    check_summaries(repo)
    repo.write(rows_of(spark, ["s 3='x"], 20, 15), repo.begin(["s 3='x"], create=True))
    check_summaries(repo)
    assert len(lookups(repo)[0][0]) == 50
    there = repo.manifest().where("file <> 'f3' or snapshot <> 's2'").select("snapshot", "file")
    assert commands.purge(repo, there, ["s1", "s2"]).count() == 1
    check_summaries(repo)
    commands.distill(repo, ["s1", "s 3='x"])
    check_summaries(repo)
    other = Repository(spark, str(tmp_path / "other"), create=True)
    commands.clone(repo, other, "run", suffix="c")
    check_summaries(other)
    repo.delete_snapshot("s2")
    check_summaries(repo)
    commands.compact(repo, ["s1"])
    assert repo.vacuum() and not repo.vacuum()
    check_summaries(repo)
    one = other.summary("signatures", ["s2_c"])
    assert one.count() == 29 and one.select("snapshot").distinct().count() == 1


def files_of(repo):
    return {p.name for p in Path(repo.path, "manifest").rglob("*.parquet")}


def test_only_files_that_lose_rows_are_written_again(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "a repo"), create=True)
    names = ["s1", "s:2 %"]
    for name in names:
        generation = repo.begin([name], create=True)
        # a file per part, as a large snapshot has
        parts = rows_of(spark, [name], 40).withColumn("generation", F.lit(1).cast("long")).repartition(8, "file")
        parts.write.mode("append").partitionBy("snapshot", "generation").parquet(f"{repo.path}/manifest")
        repo.write(rows_of(spark, [name], 0), generation)
    before, rows = files_of(repo), sorted(map(repr, repo.manifest().collect()))
    assert len(before) == 16 and len(rows) == 80
    there = repo.manifest().where("file <> 'f3' or snapshot <> 's1'").select("snapshot", "file")
    assert [r.file for r in commands.purge(repo, there, names).collect()] == ["f3"]
    assert len(files_of(repo) - before) == 1 and before <= files_of(repo)
    left = sorted(map(repr, repo.manifest().collect()))
    assert set(rows) - set(left) == {r for r in rows if "file='f3'" in r and "'s1'" in r} and len(left) == 79
    check_summaries(repo)
    # again, from a snapshot that is based on files of an earlier generation
    there = repo.manifest().where("file not in ('f3', 'f4') and snapshot = 's1' or file <> 'f9'").select("snapshot", "file")
    count = commands.purge(repo, there, names).count()
    assert count == 80 - 1 - repo.manifest().count() and repo.manifest().join(there, ["snapshot", "file"], "left_anti").count() == 0
    check_summaries(repo)
    repo.vacuum()
    check_summaries(repo)
    held = sorted(map(repr, repo.manifest().collect()))
    assert len(held) == repo.manifest().count() and len(set(held)) == len(held)
    commands.compact(repo, names)
    repo.vacuum()
    assert sorted(map(repr, repo.manifest().collect())) == held and not files_of(repo) & before
    check_summaries(repo)


def test_snapshots_without_summaries_are_read(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    repo.write(rows_of(spark, ["s1"]), repo.begin(["s1"], create=True))
    shutil.rmtree(tmp_path / "repo" / "signatures")
    shutil.rmtree(tmp_path / "repo" / "contents")
    repo.write(rows_of(spark, ["s2"], 40), repo.begin(["s2"], create=True))
    check_summaries(repo)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_runs_do_not_shuffle_what_is_stored(spark, tmp_path, monkeypatch):
    """Lookups in a repository with as many buckets as shuffle partitions: only the run's rows move."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    repo = Repository(spark, str(tmp_path / "repo"), create=True, buckets=2)
    repo.write(rows_of(spark, ["s1", "s2"]), repo.begin(["s1", "s2"], create=True))
    files = spark.createDataFrame(rows_of(spark, ["s9"], 50).drop("hash", "blob_id").collect(), "snapshot string, source string, size long, mtime_ns long, file string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(lookup.signature_lookup(files, repo.summary("signatures"), unique_files=True))
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
        plan = plan_of(lookup.content_capacity(lookup.blobs(repo.summary("contents"))))
        assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_of_one_hash_uses_filters(spark, tmp_path):
    """Stored files carry a filter of their hashes, and the condition reaches the scan."""
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    # enough hashes that they are not kept as a dictionary, which would do as well
    rows = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("file"))
    blank = {n: F.lit(None).cast(t.dataType) for n, t in zip(MANIFEST.names, MANIFEST.fields, strict=True) if n not in rows.columns}
    repo.write(rows.withColumns({**blank, "snapshot": F.lit("s1")}), repo.begin(["s1"], create=True))
    wanted = hashlib.sha256(b"77").hexdigest()
    found = lookup.scan_manifest(repo.manifest(), hash=wanted)
    assert [r.file for r in found.collect()] == ["77"]
    assert f"EqualTo(hash,{wanted})" in plan_of(found)
    jvm, sizes = spark.sparkContext._jvm, []
    for path in (tmp_path / "repo" / "manifest").rglob("*.parquet"):
        place = jvm.org.apache.hadoop.fs.Path(str(path))
        opened = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, spark.sparkContext._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(opened)
        for block in reader.getFooter().getBlocks():
            sizes += [c.getBloomFilterLength() for c in block.getColumns() if c.getPath().toDotString() == "hash"]
        reader.close()
    assert sizes and all(0 < s < 200_000 for s in sizes)


def test_one_of_many_writers_wins(spark, tmp_path):
    path = str(tmp_path / "repo")
    first, second = Repository(spark, path, create=True), Repository(spark, path, create=True)
    entries = first._entries()
    first._record({"s1": Mark("in_progress", 1)}, entries)
    with pytest.raises(Conflict):
        second._record({"s1": Mark("in_progress", 1)}, entries)
    first.delete_snapshot("s1")

    outcomes = []

    def begin(name):
        try:
            outcomes.append((name, Repository(spark, path).begin([name], create=True)))
        except ValueError as error:
            outcomes.append((name, str(error)))

    threads = [threading.Thread(target=begin, args=(f"t{i % 2}",)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for name in ("t0", "t1"):
        mine = [o for n, o in outcomes if n == name]
        assert sum(isinstance(o, dict) for o in mine) == 1
        assert all("already exists" in o for o in mine if isinstance(o, str))
    lines = first._log().collect()
    assert len({r.seq for r in lines}) == len(lines) == 4


def test_a_broken_entry_says_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("snapledger.sources.repository.COMMIT_WAIT", 0.001)
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    repo.begin(["s1"], create=True)
    (tmp_path / "repo" / "log" / "000000000002.json").write_bytes(b"")
    assert repo.names() == ["s1"]
    repo.delete_snapshot("s1")
    assert repo.names() == [] and repo._entries() == [1, 2, 3]
    (tmp_path / "repo" / "log" / "part-0.parquet").write_bytes(b"x")
    with pytest.raises(ValueError, match="earlier version"):
        repo.names()


def test_a_snapshot_begun_anew_is_not_finished_by_the_old_run(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    old = repo.begin(["s1"], create=True)
    repo.delete_snapshot("s1")
    new = repo.begin(["s1"], create=True)
    with pytest.raises(ValueError, match="no longer in progress"):
        repo.write(rows_of(spark, ["s1"]), old)
    repo.write(rows_of(spark, ["s1"], 5), new)
    assert repo.manifest().count() == 5
    check_summaries(repo)


@pytest.mark.parametrize("breaks_at", [2])
def test_a_broken_clone_is_continued(spark, tmp_path, breaks_at, monkeypatch):
    source = Repository(spark, str(tmp_path / "source"), create=True)
    names = ["s1", "s2", "s3"]
    rows = [rows_of(spark, [n], 20, 7 * i) for i, n in enumerate(names)]
    for n, r in zip(names, rows, strict=True):
        source.write(r, source.begin([n], create=True))
    whole = Repository(spark, str(tmp_path / "whole"), create=True)
    run = commands.clone(source, whole, "run", batch_rows=1)
    assert sorted(map(repr, run.stats.collect())) == sorted(map(repr, action_stats(run.rows).collect()))

    target = Repository(spark, str(tmp_path / "target"), create=True)
    calls, write = [], Repository.write

    def failing(self, *args):
        calls.append(args)
        if len(calls) == breaks_at:
            raise RuntimeError("disk full")
        write(self, *args)

    monkeypatch.setattr(Repository, "write", failing)
    with pytest.raises(RuntimeError):
        commands.clone(source, target, "run", batch_rows=1)
    done = names[: breaks_at - 1]
    assert {r.snapshot for r in target.snapshots().where("state = 'complete'").collect()} == set(done)
    before = sorted(map(repr, target.manifest(done).collect())) if done else []
    with pytest.raises(ValueError):
        commands.clone(source, target, "again", batch_rows=1)
    rest = commands.clone(source, target, "again", batch_rows=1, resume=True)
    assert {r.snapshot for r in rest.rows.collect()} == set(names[breaks_at - 1 :])
    assert target.names() == names
    assert before == (sorted(map(repr, target.manifest(done).collect())) if done else [])
    plain = lambda repo: sorted(repr(tuple(r)) for r in repo.manifest().drop("blob_id").collect())
    assert plain(target) == plain(whole)
    assert commands.clone(source, target, "third", resume=True).rows.count() == 0
