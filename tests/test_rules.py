"""Rules that must hold, on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from snapledger.functions import paths as P
from snapledger.functions import text as X
from snapledger.operators import filters, lookup, roots, stats, tree, verify
from snapledger.operators.skew import attach, count_rows, running_total
from snapledger.plans import jobs
from snapledger.schemas import MANIFEST, WINDOWS_MAX_LINKS, WINDOWS_MIN_BYTES
from snapledger.sources.content import table_hasher

LISTING = "root string, path string, type string, size long, mtime_ns long"


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST)


# the six files of the only data fixture: name, bytes, content
SIX = [
    ("big.bin", 497, "A"),
    ("big_copy.bin", 497, "A"),
    ("big_other.bin", 497, "B"),
    ("tiny.bin", 1, "1"),
    ("tiny_other.bin", 1, "3"),
    ("left_out.bin", 1, "2"),
]


def six_files(spark):
    listing = [("tree", "tree", "directory", 0, 0)]
    listing += [("tree", f"tree/{n}", "regular", size, 5) for n, size, _ in SIX]
    inventory = spark.createDataFrame(listing, LISTING)
    given = spark.createDataFrame([(0, "tree")], "ord int, root string")
    content = spark.createDataFrame([(f"tree/{n}", c) for n, _, c in SIX], "source string, c string")
    hashes = content.select("source", F.sha2("c", 256).alias("content_hash"))
    return given, inventory, table_hasher(hashes, ["source"])


@pytest.mark.parametrize("limits,copy", [((65000, 0), "dup_link"), ((WINDOWS_MAX_LINKS, WINDOWS_MIN_BYTES), "dup_copy")])
def test_first_and_second_snapshot(spark, limits, copy):
    given, inventory, hasher = six_files(spark)
    excludes = ["out.bin"]
    assert jobs.left_out(inventory, excludes).collect() == [("tree/left_out.bin", "suffix")]
    files = jobs.walk(given, inventory, excludes, "s1")
    none = manifest(spark, [])
    first = jobs.take_snapshot(files, none, hasher, "s1", False, True, *limits)
    actions = {r.file: r.action for r in first.collect()}
    assert actions.pop("tree/big_copy.bin") == copy
    assert set(actions.values()) == {"import"} and len(actions) == 4
    counts = {r.measure: (r.files, r.bytes) for r in stats.action_stats(first).collect()}
    assert counts["hashed"] == (5, 1493)
    assert counts["copied"] == ((4, 996) if copy == "dup_link" else (5, 1493))

    kept = jobs.stored_rows(first)
    again = jobs.walk(given, inventory, excludes, "s2")
    second = jobs.take_snapshot(again, kept, hasher, "s2", False, True, *limits)
    assert "import" not in {r.action for r in second.collect()}
    skipped = jobs.take_snapshot(again, kept, hasher, "s2", True, True, *limits)
    assert [r.action for r in skipped.collect()] == ["skip"] * 5


def test_content_is_read_only_for_unknown_signatures(spark):
    given, inventory, _ = six_files(spark)
    files = jobs.walk(given, inventory, ["out.bin"], "s2")
    known = [("s1", f"tree/{n}", size, 5, f"{i:064x}", n, None) for i, (n, size, _) in enumerate(SIX)]

    def refuse(rows):
        raise AssertionError("content was read")

    rows = jobs.take_snapshot(files, manifest(spark, known), refuse, "s2").collect()
    assert {r.action for r in rows} == {"dup_link"} and not any(r.hashed for r in rows)

    asked = []

    def hasher(rows):
        asked.extend(r.source for r in rows.collect())
        return rows.withColumn("content_hash", F.lit("e" * 64))

    jobs.take_snapshot(files, manifest(spark, known[1:]), hasher, "s2").collect()
    assert set(asked) == {"tree/big.bin"}


def test_file_changed_while_hashing_is_looked_up_again(spark):
    files = spark.createDataFrame(
        [("s2", "/a", 1, 1, "#a"), ("s2", "/b", 1, 1, "#b")],
        "snapshot string, source string, size long, mtime_ns long, file string",
    )
    known = manifest(spark, [("s1", "/a", 2, 9, "a" * 64, "#a", None), ("s1", "/b", 3, 9, "b" * 64, "#b", None)])

    def hasher(rows):
        size = F.when(F.col("source") == "/a", 2).otherwise(3).cast("long")
        return rows.select(
            "*",
            F.lit("a" * 64).alias("content_hash"),
            size.alias("now_size"),
            F.lit(9).cast("long").alias("now_mtime_ns"),
        )

    got = {r.source: r for r in jobs.take_snapshot(files, known, hasher, "s2").collect()}
    assert (got["/a"].action, got["/a"].size, got["/a"].mtime_ns) == ("dup_link", 2, 9)
    assert got["/b"].action == "conflict"


def test_unreadable_files_fail(spark):
    files = spark.createDataFrame(
        [("s2", "/a", 1, 1, "#a"), ("s2", "/b", None, 1, "#b")],
        "snapshot string, source string, size long, mtime_ns long, file string",
    )

    def hasher(rows):
        return rows.withColumn("content_hash", F.lit(None).cast("string"))

    got = jobs.take_snapshot(files, manifest(spark, []), hasher, "s2").collect()
    assert [(r.action, r.blob_id) for r in got] == [("failed", None)] * 2


def test_newest_snapshot_wins_then_smallest_hash(spark):
    rows = [
        ("s1", "/a", 1, 1, "1" * 64, "x", None),
        ("s3", "/a", 1, 1, "f" * 64, "y", None),
        ("s3", "/a", 1, 1, "c" * 64, "z", None),
        ("s2", "/a", 1, 1, "0" * 64, "w", None),
        ("s9", "/a", 1, 1, "", "v", None),
    ]
    found = lookup.newest_per_signature(manifest(spark, rows)).collect()
    assert [(r.prior_hash, r.prior_snapshot) for r in found] == [("c" * 64, "s3")]


def test_hot_keys_join_like_any_other(spark):
    rng = random.Random(1)
    keys = [None if rng.random() < 0.1 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}") for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(keys)), "n int, k string")
    per_key = count_rows(rows, ["k"], "size").withColumn("v", F.concat(F.lit("v"), "k")).where("k <> 'k3'")
    expected = {n: None if k in (None, "k3") else f"v{k}" for n, k in enumerate(keys)}
    for limit in (0, 20, 1_000_000):
        got = attach(rows, per_key, ["k"], ["n"], "size", limit).collect()
        assert len(got) == 300 and {r.n: r.v for r in got} == expected


def test_running_total(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", rng.randrange(4), f"m{i}", rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, a int, m string, v long")
    got = running_total(df, ["k"], ["a"], "m", "v", "before").collect()
    import model

    order = sorted(rows, key=lambda r: (r[0], r[1], model.bucket(r[2]), r[2]), reverse=True)
    total, expected = {}, {}
    for k, _, m, v in order:
        expected[m] = total.get(k, 0)
        total[k] = expected[m] + v
    assert {r.m: r.before for r in got} == expected


TREE = [
    ("/r", "/r", "directory"),
    ("/r", "/r/keep.txt", "regular"),
    ("/r", "/r/x_SKIP", "directory"),
    ("/r", "/r/x_SKIP/a.txt", "regular"),
    ("/r", "/r/x_SKIP/deep/b.tmp", "regular"),
    ("/r", "/r/.hidden", "regular"),
    ("/r", "/r/empty", "regular"),
    ("/r", "/r/a.TMP", "regular"),
    ("/r", "/r/b.tmp", "regular"),
    ("/r", "/r/link", "symlink"),
    ("/r", "/r/pipe", "other"),
    ("/r", "/r/gone", "not_found"),
    ("/s/one.txt", "/s/one.txt", "regular"),
]


@pytest.mark.parametrize("form", ["list", "long list", "table", "large table"])
def test_exclusion(spark, form, monkeypatch):
    inventory = spark.createDataFrame([(*t, 1, 1) for t in TREE], LISTING)
    excludes = ["_SKIP", ".tmp"]
    if form == "long list":
        excludes += [f"/unused{i}" for i in range(80)]
    elif form != "list":
        excludes = spark.createDataFrame([(e,) for e in excludes], "suffix string")
    if form == "large table":
        monkeypatch.setattr("snapledger.operators.filters.is_small", lambda df: False)
    kept = {r.path for r in filters.exclude_kept(inventory, excludes).collect()}
    assert kept == {t[1] for t in TREE if "SKIP" not in t[1] and not t[1].endswith(".tmp")}
    topmost = sorted(r.path for r in filters.exclude_topmost(inventory, excludes).collect())
    assert topmost == ["/r/b.tmp", "/r/x_SKIP"]
    reasons = {r.reason: r.entries for r in stats.exclusion_stats(jobs.left_out(inventory, excludes)).collect()}
    assert reasons == {"suffix": 2, "symlink": 1, "unknown_type": 1, "inaccessible": 1}


def test_ancestors_above_the_root_do_not_exclude(spark):
    inventory = spark.createDataFrame([("/a.tmp/r", "/a.tmp/r/f", "regular", 1, 1)], LISTING)
    assert filters.exclude_kept(inventory, [".tmp"]).count() == 1
    assert filters.exclude_kept(inventory, [".tmp/r"]).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_target_path(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr("snapledger.operators.filters.is_small", lambda df: False)
    given = [(0, "/a/b"), (1, "#a#b"), (2, "."), (3, "/"), (4, "/one.txt")]
    entries = [
        ("/a/b", "/a/b/c/d"),
        ("#a#b", "#a#b/c"),
        (".", "./x"),
        (".", "y"),
        ("/", "/z"),
        ("/one.txt", "/one.txt"),
    ]
    inventory = spark.createDataFrame([(*e, "regular", 1, 1) for e in entries], LISTING)
    df = spark.createDataFrame(given, "ord int, root string")
    got = {r.path: r.file for r in filters.target_path(df, inventory).collect()}
    assert got == {
        "/a/b/c/d": "#a#b/c/d",
        "#a#b/c": "#a#b_1/c",
        "./x": "#/x",
        "y": "#/y",
        "/z": "#_1/z",
        "/one.txt": "#one.txt",
    }
    windows = spark.createDataFrame([("C:\\data",)], "p string")
    assert windows.select(P.target_key(F.col("p"), windows=True)).first()[0] == "C##data"


def test_taken_target_path_raises(spark):
    df = spark.createDataFrame([(0, "/a"), (1, "#a"), (2, "/a_1")], "ord int, root string")
    with pytest.raises(Exception, match="target path is taken"):
        filters.root_keys(df).collect()


def test_overlapping_roots(spark):
    def check(names, repo="/zz", excludes=(), mode="string"):
        df = spark.createDataFrame(list(enumerate(names)), "ord int, root string")
        found = roots.overlapping_roots(df, repo, excludes, mode).collect()
        return sorted((r.root, r.other, r.problem) for r in found)

    assert check(["/a", "/b"]) == []
    assert check(["/a", "/a"]) == [("/a", "/a", "equal")]
    assert check(["/a", "/ab", "/a/b/c", "/a/b"]) == [
        ("/a/b", "/a", "part_of_root"),
        ("/a/b/c", "/a", "part_of_root"),
        ("/ab", "/a", "part_of_root"),
    ]
    assert check(["/a", "/ab", "/a/b"], mode="component") == [("/a/b", "/a", "part_of_root")]
    assert check(["/", "/a"], "/r", mode="component") == [
        ("/", "/r", "contains_repository"),
        ("/a", "/", "part_of_root"),
    ]
    assert check(["/a/x"], "/a") == [("/a/x", "/a", "part_of_repository")]
    assert check(["/a"], "/a/repo") == [("/a", "/a/repo", "contains_repository")]
    assert check(["/a"], "/a/repo", ["/repo"]) == []
    table = spark.createDataFrame([("/repo",)], "suffix string")
    assert check(["/a"], "/a/repo", table) == []
    assert check(["/a"], "/a/other", table) != []


def test_snapshot_set_checks(spark):
    named = spark.createDataFrame([("/r/a",), ("/r/a",), ("/q/b",), ("/r/c",)], "path string")
    known = spark.createDataFrame([("/r/a", "complete"), ("/r/c", "in_progress")], "path string, state string")
    got = sorted(tuple(r) for r in roots.snapshot_set_checks(named, known).collect())
    assert got == [
        ("/q", "mixed_repositories"),
        ("/q/b", "unknown"),
        ("/r", "mixed_repositories"),
        ("/r/a", "duplicate"),
        ("/r/c", "unfinished"),
    ]
    one = roots.snapshot_set_checks(named.where("path = '/r/c'"), known.withColumn("state", F.lit("complete")))
    assert one.count() == 0


def test_nulls_never_widen_a_delete(spark):
    rows = [("s1", "/a", 1, 1, "a" * 64, "x", None), ("s1", "/b", 1, 1, "b" * 64, "y", None)]
    known = manifest(spark, rows)
    for gap in range(1, 6):
        row = list(rows[0])
        row[gap] = None
        assert lookup.delete_rows(known, manifest(spark, [tuple(row)])).count() == 2
    assert [r.file for r in lookup.delete_rows(known, manifest(spark, rows[:1])).collect()] == ["y"]


def test_rows_without_a_hash_are_reported(spark):
    rows = [("s1", "/a", 1, 1, None, "x", None), ("s1", "/b", 1, 1, "", "y", None), ("s1", "/c", 1, 1, "c" * 64, "z", None)]
    got = jobs.clone(manifest(spark, rows), manifest(spark, []), "run").collect()
    assert sorted((r.file, r.action) for r in got) == [("x", "failed"), ("y", "failed"), ("z", "import")]


def test_empty_directories_cascade(spark):
    entries = [
        ("s1", "#r", "directory"),
        ("s1", "#r/a", "directory"),
        ("s1", "#r/a/b", "directory"),
        ("s1", "#r/a/b/f", "regular"),
        ("s1", "#r/c", "directory"),
        ("s1", "#r/c/g", "regular"),
        ("s1", "#r/old", "directory"),
        ("s2", "#r", "directory"),
        ("s2", "#r/h", "regular"),
    ]
    inventory = spark.createDataFrame(entries, "snapshot string, file string, type string")

    def gone(*deleted):
        df = spark.createDataFrame(list(deleted), "snapshot string, file string")
        return sorted(tuple(r) for r in tree.empty_directories(inventory, df).collect())

    assert gone(("s1", "#r/a/b/f")) == [("s1", "#r/a"), ("s1", "#r/a/b"), ("s1", "#r/old")]
    assert gone(("s1", "#r/a/b/f"), ("s1", "#r/c/g"), ("s2", "#r/h")) == [
        ("s1", "#r"),
        ("s1", "#r/a"),
        ("s1", "#r/a/b"),
        ("s1", "#r/c"),
        ("s1", "#r/old"),
        ("s2", "#r"),
    ]


def test_texts(spark):
    df = spark.createDataFrame([(1234567, -1), (-100, 0), (None, None)], "n long, t long")
    got = df.select(
        X.number_text(F.col("n"), 4).alias("narrow"),
        X.number_text(F.col("n"), 12).alias("wide"),
        X.record_text(F.col("n"), F.lit(1704067200123456789), F.lit("/p")).alias("record"),
        X.record_text(F.col("n"), F.col("t"), F.lit("/p")).alias("blank"),
    ).collect()
    assert got[0].narrow == "1,234,567" and got[0].wide == "   1,234,567"
    assert got[1].narrow == "-100" and got[1].wide == "        -100"
    assert got[0].record == "      1,234,567 2024-01-01 00:00:00 /p"
    assert got[2].blank == " " * 15 + " " + " " * 19 + " /p"
    stamp = F.lit(1720000000999999999)
    zones = spark.range(1).select(
        X.time_text(stamp, "Europe/Berlin").alias("a"),
        X.time_text(stamp, "America/New_York", friendly=False).alias("b"),
        X.elapsed_text(F.lit(5), F.lit(2_999_999_999)).alias("c"),
    ).first()
    assert tuple(zones) == ("2024-07-03 11:46:40", "2024-07-03_05-46-40", "2s")


def verify_model(rows, inode, content, order):
    """Walk the rows in order as a verification does."""
    table, problems = {}, []
    for r in sorted(rows, key=lambda r: (order.index(r[0]), r[5])):
        snapshot, source, size, mtime, h, file, _ = r
        key = inode.get((snapshot, file))
        if key is None:
            problems.append(("unreadable_index", snapshot, file))
            if content is not None:
                problems.append(("rehash_mismatch", snapshot, file))
            continue
        if key in table:
            if table[key]["hash"] != h:
                problems.append(("hash_consistency", snapshot, file))
            table[key]["refs"][snapshot] = table[key]["refs"].get(snapshot, 0) + 1
            continue
        found = h if content is None else content.get((snapshot, file)) or "ERROR"
        if found != h:
            problems.append(("rehash_mismatch", snapshot, file))
        table[key] = {"hash": found, "refs": {snapshot: 1}, "sig": (source, size, mtime)}
    groups = {}
    for e in table.values():
        groups.setdefault(e["sig"], set()).add(e["hash"])
    pairs = sum(len(g) - 1 for g in groups.values())
    return table, sorted(problems), pairs


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rehash", [False, True])
def test_verify_against_model(spark, seed, rehash):
    rng = random.Random(seed)
    order = ["b", "a", "c"]
    rows = [
        (rng.choice(order), f"/r/{rng.randrange(12)}", 1, 1, f"{rng.randrange(5):064x}", f"f{i}", None) for i in range(60)
    ]
    inode = {(r[0], r[5]): rng.randrange(25) for r in rows if rng.random() < 0.9}
    content = {(r[0], r[5]): r[4] if rng.random() < 0.7 else "9" * 64 for r in rows if rng.random() < 0.9}
    table, expected, pairs = verify_model(rows, inode, content if rehash else None, order)

    known = manifest(spark, rows)
    there = spark.createDataFrame([(*k, v) for k, v in inode.items()], "snapshot string, file string, inode long")
    read = spark.createDataFrame([(*k, v) for k, v in content.items()], "snapshot string, file string, content_hash string")
    hasher = table_hasher(read, ["snapshot", "file"]) if rehash else None
    report = jobs.verify(known, there, hasher, order, hot_rows=3).collect()
    got = sorted((r.check, r.snapshot, r.file) for r in report if r.check != "signature_uniqueness")
    assert got == expected
    assert sum(r.check == "signature_uniqueness" for r in report) == pairs

    linked = verify.link_inventory(known, there)
    counts = {
        r.file_index: {n: r[n] for n in order if r[n]} for r in verify.file_table(linked, order, order).collect()
    }
    assert counts == {k: e["refs"] for k, e in table.items()}


def test_barred_snapshots_take_no_part_in_verification(spark):
    rows = [("s1", "/a", 1, 1, "a" * 64, "x", None), ("s2", "/b", 1, 1, "bad", "y", None), ("s2", "/c", 1, 1, "c" * 64, "z", None)]
    none = spark.createDataFrame([], "snapshot string, file string, inode long")
    got = sorted((r.check, r.snapshot, r.file) for r in jobs.verify(manifest(spark, rows), none).collect())
    assert got == [("integrity", "s2", "y"), ("unreadable_index", "s1", "x")]


def test_devices_keep_equal_inodes_apart(spark):
    rows = [("s1", "/a", 1, 1, "a" * 64, "x", None), ("s1", "/b", 1, 1, "b" * 64, "y", None)]
    there = spark.createDataFrame([("s1", "x", 7, 1), ("s1", "y", 7, 2)], "snapshot string, file string, inode long, device long")
    linked = verify.link_inventory(manifest(spark, rows), there)
    assert verify.representatives(linked).count() == 2
    assert verify.hash_consistency(linked, verify.representatives(linked)).count() == 0
