"""Limits that pick a plan give the same rows on both sides, and nothing is lost in silence."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from snapledger.functions.paths import normal_path
from snapledger.operators import filters, skew, verify
from snapledger.operators.assign import assign_blobs
from snapledger.plans import jobs
from snapledger.schemas import MANIFEST
from snapledger.sources.content import spread_by_bytes
from snapledger.sources.listing import normal_root
from snapledger.sources.repository import Repository


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def manifest(spark, n, snapshots=("s0", "s1")):
    rng = random.Random(n)
    rows = [
        (rng.choice(snapshots), f"/a/{i}", 700, 1, f"{rng.randrange(4):064x}", f"f{i}", f"b{i % 5}") for i in range(n)
    ]
    return spark.createDataFrame(rows, MANIFEST)


def test_numbering_is_one_order_at_every_size(spark):
    files = manifest(spark, 40, ("s8", "s9")).drop("blob_id")
    prior = manifest(spark, 12)
    outcomes = [rows_of(assign_blobs(files, prior, "run", 4, 0, hot_rows=n)) for n in (0, 1, 5, 10**6)]
    assert all(o == outcomes[0] for o in outcomes)


def test_small_and_large_tables_give_the_same(spark, monkeypatch):
    files, prior = manifest(spark, 30, ("s9",)).drop("blob_id"), manifest(spark, 30)
    roots = spark.createDataFrame([(0, "/r"), (1, "#r")], "ord int, root string")
    inventory = spark.createDataFrame([("/r", "/r/x"), ("#r", "#r/y")], "root string, path string")
    outcomes = []
    for limit in (100_000, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        outcomes.append((rows_of(assign_blobs(files, prior, "run", 3)), rows_of(filters.target_path(roots, inventory))))
    assert outcomes[0] == outcomes[1]


def test_references_are_counted_per_snapshot(spark):
    known = manifest(spark, 60, ("s0", "s1", "s2", None))
    there = known.select("snapshot", "file", F.abs(F.hash("blob_id")).cast("long").alias("inode"))
    linked = verify.link_inventory(known, there).withColumn("inode", F.coalesce("inode", F.lit(5)))
    counts = {}
    for r in linked.collect():
        counts.setdefault(r.inode, {}).setdefault(r.snapshot, []).append(r.file)
    plain = {inode: {s: len(f) for s, f in held.items() if s is not None} for inode, held in counts.items()}
    assert {r.inode: r.links for r in verify.reference_counts(linked).collect()} == plain
    names = ["s0", "s1", "s2"]
    table = {r.file_index: [r[n] for n in names] for r in verify.file_table(linked, names).collect()}
    assert table == {inode: [held.get(n, 0) for n in names] for inode, held in plain.items()}


def test_file_table_of_a_thousand_snapshots(spark):
    """Work per row does not depend on the number of snapshots; the plan has no aggregate per column."""
    names = [f"s{i:04d}" for i in range(1000)]
    rows = [(n, f"/r/{i % 3}", 1, 1, f"{i % 3:064x}", f"f{i}", None) for i, n in enumerate(names)]
    there = spark.createDataFrame([(r[0], r[5], i % 3) for i, r in enumerate(rows)], "snapshot string, file string, inode long")
    linked = verify.link_inventory(spark.createDataFrame(rows, MANIFEST), there)
    table = verify.file_table(linked, names, names)
    got = {r.file_index: sum(r[n] for n in names) for r in table.collect()}
    assert got == {0: 334, 1: 333, 2: 333}
    plan = verify.reference_counts(linked, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("count(") <= 4


@pytest.mark.parametrize("empty", [[""], ["", None], []])
def test_empty_suffixes_exclude_nothing(spark, monkeypatch, empty):
    tree = spark.createDataFrame([("/r", "/r/a.tmp"), ("/r", "/r/b")], "root string, path string")
    table = spark.createDataFrame([(s,) for s in [".tmp", *empty]], "suffix string")
    for excludes in ([".tmp", *empty], (".tmp", *empty), table):
        assert [r.path for r in filters.exclude_kept(tree, excludes).collect()] == ["/r/b"]
    monkeypatch.setattr(filters, "FOLDED_SUFFIXES", 0)
    assert [r.path for r in filters.exclude_kept(tree, [".tmp", *empty]).collect()] == ["/r/b"]


def test_rows_without_a_snapshot_stay(spark):
    known = spark.createDataFrame([("s0", "/a", 1, 1, "a" * 64, "x", None), (None, "/a", 1, 1, "a" * 64, "x", None)], MANIFEST)
    none = known.select("snapshot", "file").limit(0)
    assert [r.snapshot for r in jobs.purge(known, none, ["s0"]).collect()] == [None]
    assert [r.snapshot for r in jobs.distill(known, ["s0"]).collect()] == [None]


@pytest.mark.parametrize("hash", [None, "", "ERROR"])
def test_no_hash_is_no_content(spark, hash):
    known = spark.createDataFrame([("a", "/a", 1, 1, hash, "x", None), ("b", "/b", 1, 1, hash, "y", None)], MANIFEST)
    assert jobs.distill(known, ["a"]).count() == 2


def test_a_stray_row_makes_the_write_fail(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    with pytest.raises(PySparkException, match="not begun"):
        repo.write(manifest(spark, 20), repo.begin(["s0"], create=True))
    with pytest.raises(ValueError, match="unfinished"):
        repo.manifest()


def test_files_are_in_order_and_old_ones_go(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "repo"), create=True)
    names = ["s0", "s:1 %"]
    repo.write(manifest(spark, 200, names), repo.begin(names, create=True))
    before = rows_of(repo.manifest())
    for _ in range(2):
        repo.write(repo.manifest(["s0"]), repo.begin(["s0"]))
    files = repo.manifest().inputFiles()
    assert files and not any("generation=2" in f for f in files if "snapshot=s0" in f)
    for path in (tmp_path / "repo" / "manifest").rglob("*.parquet"):
        found = pq.ParquetFile(path).read()["hash"].to_pylist()
        assert found == sorted(found)
    assert len(repo.vacuum(keep=1)) == 1 and len(repo.vacuum()) == 1 and repo.vacuum() == []
    assert rows_of(repo.manifest()) == before
    repo.delete_snapshot("s:1 %")
    assert len(repo.vacuum()) == 1 and {r.snapshot for r in repo.manifest().collect()} == {"s0"}


def test_content_is_dealt_by_bytes(spark):
    rows = spark.createDataFrame([(f"/{i}", 100) for i in range(50)] + [("/big", 5000), ("/none", None)], "path string, size long")
    one = rows.coalesce(1)
    assert spread_by_bytes(one, 1000).rdd.getNumPartitions() == 6
    assert spread_by_bytes(one, 10**9).rdd.getNumPartitions() == 1
    assert rows_of(spread_by_bytes(one, 1000)) == rows_of(rows)


@pytest.mark.parametrize(
    ("path", "plain"),
    [("/d/a/", "/d/a"), ("/d//a", "/d/a"), ("/d/x/../a", "/d/a"), ("/../a/.", "/a"), ("/", "/"), ("//", "/"), ("a/./b/", "a/b"),
     ("../a/../../b", "../../b"), ("", "."), ("a/..", "."), (".", "."), ("/..", "/")],
)
def test_normal_paths(spark, path, plain):
    assert spark.range(1).select(normal_path(F.lit(path))).first()[0] == plain == normal_root(path)
