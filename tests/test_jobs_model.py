"""Set-based jobs against the row-by-row model on random data."""

import random

import pytest
from pyspark.sql import functions as F

import model
from snapledger.operators import skew
from snapledger.operators.assign import assign_blobs
from snapledger.plans import jobs
from snapledger.schemas import MANIFEST
from snapledger.sources.content import table_hasher


def random_manifest(rng, snapshots, rows, max_links, hashes=6, start=0):
    """Rows of consistent blobs: a hash always has one size, and no blob is over the limit."""
    out, links = [], {}
    for i in range(rows):
        # a third of all rows share one content
        h = "0" * 64 if rng.random() < 0.34 else f"{rng.randrange(1, hashes):064x}"
        size = 10 if int(h, 16) % 2 == 0 else 700
        blob = f"b{rng.randrange(5)}-{h[-2:]}"
        while links.get(blob, 0) >= max_links:
            blob += "x"
        links[blob] = links.get(blob, 0) + 1
        source = f"/r/{rng.randrange(rows // 2)}"
        out.append(
            dict(
                snapshot=rng.choice(snapshots),
                source=source,
                size=size,
                mtime_ns=rng.randrange(2),
                hash=h,
                file=f"f{start + i}",
                blob_id=blob,
            )
        )
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in MANIFEST.names) for r in rows], MANIFEST)


CASES = [(s, inc, always, False) for s in range(3) for inc in (False, True) for always in (False, True)]
CASES += [(s, False, s == 2, True) for s in range(4)]
HOT = [1_000_000, 5, 0]


@pytest.mark.parametrize("seed,incremental,always_hash,affinity", CASES)
def test_take_snapshot(spark, seed, incremental, always_hash, affinity, monkeypatch):
    if incremental != always_hash:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rng = random.Random(seed)
    max_links, min_bytes = 4, 100 * (seed % 2)
    prior = random_manifest(rng, ["s1", "s2", "s3"], 40, max_links)
    files, content = [], {}
    for i in range(60):
        h = "0" * 64 if rng.random() < 0.34 else f"{rng.randrange(1, 9):064x}"
        size = 10 if int(h, 16) % 2 == 0 else 700
        files.append(
            dict(snapshot="s9", source=f"/r/{i}", size=size, mtime_ns=rng.randrange(2), file=f"#r/{i}")
        )
        content[f"/r/{i}"] = h
    expected, read = model.take_snapshot(
        files, prior, content, "s9", incremental, always_hash, max_links, min_bytes, affinity
    )
    table = spark.createDataFrame(list(content.items()), "source string, content_hash string")
    cols = ["snapshot", "source", "size", "mtime_ns", "file"]
    listing = spark.createDataFrame(
        [tuple(f[c] for c in cols) for f in files],
        "snapshot string, source string, size long, mtime_ns long, file string",
    )
    got = jobs.take_snapshot(
        listing,
        frame(spark, prior),
        table_hasher(table, ["source"]),
        "s9",
        incremental,
        always_hash,
        max_links,
        min_bytes,
        hot_rows=HOT[seed % 3],
        affinity=affinity,
    ).collect()
    assert {r.file: (r.action, r.blob_id) for r in got} == expected
    assert len(got) == len(files)
    assert {r.source for r in got if r.hashed} == read


@pytest.mark.parametrize(
    "seed,incremental,affinity", [*[(s, i, False) for s in range(3) for i in (False, True)], (0, False, True), (1, False, True)]
)
def test_clone(spark, seed, incremental, affinity):
    rng = random.Random(100 + seed)
    max_links, min_bytes = 3, 100 * (seed % 2)
    source = random_manifest(rng, ["a", "b", "c"], 50, max_links)
    target = random_manifest(rng, ["t1", "t2"], 25, max_links, hashes=8, start=1000)
    expected = model.clone(source, target, "run", incremental, max_links, min_bytes, affinity)
    got = jobs.clone(
        frame(spark, source),
        frame(spark, target),
        "run",
        incremental,
        max_links=max_links,
        min_bytes=min_bytes,
        hot_rows=HOT[seed],
        affinity=affinity,
    ).collect()
    assert {(r.snapshot, r.file): (r.action, r.blob_id) for r in got} == expected
    assert len(got) == len(source)


@pytest.mark.parametrize("seed", range(4))
def test_assign_fills_older_blobs(spark, seed):
    """Many part-filled blobs of one content: rows run over from the newest to older ones."""
    rng = random.Random(seed)
    prior = []
    for b in range(6):
        for i in range(rng.randrange(1, 5)):
            prior.append(
                dict(
                    snapshot=f"s{rng.randrange(4)}",
                    source=f"/p/{b}/{i}",
                    size=700,
                    mtime_ns=0,
                    hash="0" * 64,
                    file=f"p{b}-{i}",
                    blob_id=f"b{b}",
                )
            )
    new = [
        dict(snapshot="s9", source=f"/n/{i}", size=700, mtime_ns=0, hash="0" * 64, file=f"n{i}", blob_id=None)
        for i in range(40)
    ]
    blobs = model.Blobs(prior, 5, 0)
    expected = {r["file"]: blobs.place(r, "run") for r in model.walk_order(new)}
    files = frame(spark, new).drop("blob_id")
    got = assign_blobs(files, frame(spark, prior), "run", 5, 0, hot_rows=20 * seed)
    assert {r.file: (r.action, r.blob_id) for r in got.collect()} == expected


@pytest.mark.parametrize("targets", [["b"], ["b", "d"], ["d", "b"], ["a", "b", "c", "d"]])
@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_distill(spark, targets, hot_rows):
    rows = random_manifest(random.Random(7), ["a", "b", "c", "d"], 60, 9, hashes=20)
    got = jobs.distill(frame(spark, rows), targets, hot_rows)
    kept = [(r.snapshot, r.file) for r in got.collect()]
    assert set(kept) == model.distill(rows, targets)
    assert len(kept) == len(set(kept))
    # nothing more to do, and no content is lost
    assert jobs.distill(got, targets, hot_rows).count() == len(kept)
    assert got.select("hash").distinct().count() == len({r["hash"] for r in rows})


def test_failed_when_stored_files_are_gone(spark):
    rows = random_manifest(random.Random(3), ["a"], 6, 9, hashes=3)
    prior = frame(spark, rows)
    files = prior.withColumn("snapshot", F.lit("z")).drop("blob_id")
    gone = {rows[0]["hash"]}
    left = [(r["snapshot"], r["file"], 1) for r in rows if r["hash"] not in gone]
    stored = spark.createDataFrame(left, "snapshot string, file string, nlink long")
    got = assign_blobs(files, prior, "run", 9, 0, stored).collect()
    assert {r.hash for r in got if r.action == "failed"} == gone
    assert all(r.action == "dup_link" for r in got if r.hash not in gone)


@pytest.mark.parametrize("max_links", [1, 2, 3, 100])
def test_links_follow_their_record(spark, max_links):
    """Two blobs of one content: files keep to the blob of their own record while it has room."""
    row = dict(size=700, mtime_ns=0, hash="0" * 64)
    prior = [dict(row, snapshot="s1", source=f"/p/{i}", file=f"p{i}", blob_id=f"b{i % 2}") for i in range(2)]
    prior += [dict(row, snapshot="s2", source="/q", file="q", blob_id="b1")]
    new = [dict(row, snapshot="s9", source=f"/p/{i}", file=f"n{i}", blob_id=None) for i in range(4)]
    expected, _ = model.take_snapshot(new, prior, {r["source"]: "0" * 64 for r in new}, "s9", False, False, max_links, 0, True)
    listing = frame(spark, new).drop("blob_id", "hash")
    content = spark.createDataFrame([(r["source"], "0" * 64) for r in new], "source string, content_hash string")
    got = jobs.take_snapshot(
        listing, frame(spark, prior), table_hasher(content, ["source"]), "s9", max_links=max_links, affinity=True
    ).collect()
    assert {r.file: (r.action, r.blob_id) for r in got} == expected
    if max_links == 100:
        assert expected["n0"] == ("dup_link", "b0") and expected["n1"] == ("dup_link", "b1")


def test_rows_without_a_size_take_no_blob_by_record(spark):
    rows = [("s9", "/a", None, 0, "0" * 64, "a", "b0"), ("s9", "/b", 5, 0, "0" * 64, "b", None)]
    files = spark.createDataFrame(rows, "snapshot string, source string, size long, mtime_ns long, hash string, file string, prior_blob string")
    prior = spark.createDataFrame([("s1", "/a", 5, 0, "0" * 64, "a", "b0")], MANIFEST)
    got = assign_blobs(files, prior, "run")
    assert "prior_blob" not in got.columns
    assert sorted(r.file for r in got.collect()) == ["a", "b"]
