"""Merkle manifest, periodic runs and language identification against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_data import awkward, documents, words
from pyspark.sql import functions as F

from snapledger.llm import languages, merkle, periods
from snapledger.llm.languages import Compression
from snapledger.llm.merkle import LOWER, UPPER, Manifest
from snapledger.llm.periods import Runs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    steps = []
    for level in levels[:-1]:
        first = at // 8 * 8
        run = level[first : first + 8]
        steps.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= 8
    return steps


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        found = r[1].translate(str.maketrans(UPPER, LOWER)) if hit else r[1]
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, found), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:2])
        trees[name] = plain_tree([x[1] for x in groups[name]])
    top = plain_tree([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, (_, own, other, key) in enumerate(groups[name]):
            steps = siblings(trees[name], at) + siblings(top, place)
            for before, after in steps:
                other = sha(before + other + after)
            proof = sha("".join(b + a for b, a in steps))
            out.append((key, own, trees[name][-1][0], top[-1][0], proof, other, other == top[-1][0]))
    return sorted(map(repr, out))


def manifest_of(df):
    manifest = Manifest()
    rows = merkle.check(merkle.manifest_rows(df, manifest, merkle.tampered_text(manifest)))
    names = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(repr(tuple(r[n] for n in names)) for r in rows.collect())


def many(languages=(None, "", "de", "en", "ü"), sizes=(1, 8, 9, 64, 70)):
    rows = [(i, f"Text {i} of {name}", name, None, i) for name, size in zip(languages, sizes, strict=True) for i in range(size)]
    return rows[::-1]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_manifest_of_many_groups(spark, monkeypatch, digits):
    """Blocks of 8, 64 and 4096 leaves, so that trees end inside, at and beyond blocks."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = many()
    assert manifest_of(documents(spark, rows).repartition(3)) == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark):
    rows = [*awkward(), *[(7, "same in all", "en", "a", 1)] * 20]
    assert manifest_of(documents(spark, rows)) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "Alone", "en", "a", 5)], [(None, None, None, None, None)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifest_of(documents(spark, rows)) == plain_manifest(rows)


def test_manifest_ignores_further_columns(spark):
    clashes = documents(spark).select("*", *[F.lit(3).alias(c) for c in ("tree", "place", "digest", "steps", "block", "d0", "kid", "total")])
    assert manifest_of(clashes) == manifest_of(documents(spark))


def test_manifest_tells_every_change(spark):
    """A change of any field, a lost row and a moved row show in the root; untouched rows verify."""
    rows = many(("en", "fr"), (20, 9))
    root = lambda r: {x.root for x in merkle.manifest_rows(documents(spark, r), Manifest()).collect()}
    first = root(rows)
    changed = [(*rows[0][:3], "src", rows[0][4]), *rows[1:]]
    assert len(first) == 1 and root(rows[::-1]) == first
    assert len({*first, *root(changed), *root(rows[1:])}) == 3
    checked = merkle.check(merkle.manifest_rows(documents(spark, rows), Manifest())).collect()
    assert all(r.verified for r in checked)


def plain_runs(held, runs):
    size, found = len(held), {}
    for period in range(1, size // runs.min_exponent + 1):
        at = 0
        while at + period < size:
            end = at
            while end + period < size and held[end] == held[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(runs.min_length, runs.min_exponent * period):
                found.setdefault((at, length), period)
            at = end + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    held = [rng.choice("abcdefghijklmnop"[: rng.choice([1, 2, 3, 5, 16])]) for _ in range(rng.choice([0, 1, 23, 24, 25, 60, 300]))]
    for _ in range(rng.randint(0, 4) if held else 0):
        at, period = rng.randrange(len(held)), rng.randint(1, 12)
        held[at:at] = [held[(at + i % period) % len(held)] for i in range(rng.randint(10, 80))]
        if rng.random() < 0.4:
            held[rng.randrange(len(held))] = "zz"
    return held


@pytest.mark.parametrize("runs", [Runs(), Runs(6, 3), Runs(10, 4), Runs(1, 3)])
@pytest.mark.parametrize("part", [50, periods.PART_WORDS])
def test_runs_of_random_texts(runs, part, monkeypatch):
    monkeypatch.setattr(periods, "PART_WORDS", part)
    rng, total = random.Random(7), 0
    texts = [random_words(rng) for _ in range(150)]
    for held, (size, found, body) in zip(texts, periods.search([" ".join(t) for t in texts], runs), strict=True):
        expected = plain_runs(held, runs)
        total += len(expected)
        gone = {i for s, n, p in expected for i in range(s + p, s + n)}
        assert (size, found) == (len(held), expected)
        assert body == " ".join(w for i, w in enumerate(held) if i not in gone)
    assert total > 100


def test_runs_repeat_three_times():
    with pytest.raises(ValueError):
        Runs(24, 2)


def test_colliding_hashes_only_cost_time(monkeypatch):
    rng = random.Random(11)
    texts = [random_words(rng) for _ in range(40)]
    monkeypatch.setattr(periods, "repeating_texts", lambda ids, bounds, width: np.arange(len(bounds) - 1))
    for held, (_, found, _) in zip(texts, periods.search([" ".join(t) for t in texts], Runs()), strict=True):
        assert found == plain_runs(held, Runs())


def test_runs_of_very_long_texts():
    """One word over and over, and a passage repeated far apart: both near linear."""
    passage = " ".join(f"w{i}" for i in range(30))
    far = " ".join(f"x{i} {passage} y{i}" for i in range(3000))
    close = "a b c " * 30_000
    got = [found for _, found, _ in periods.search(["go " * 100_000, far, close], Runs())]
    assert got == [[(0, 100_000, 1)], [], [(0, 90_000, 3)]]


def test_runs_of_awkward_rows(spark):
    df = documents(spark).withColumn("runs", F.lit("old")).withColumn("_0", F.lit(1)).withColumn("_text", F.lit("x"))
    found = periods.find_runs(df, Runs(3, 3))
    assert found.columns == [*[c for c in df.columns if c != "runs"], "n_words", "runs", "collapsed"]
    got = sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in found.collect())
    expected = []
    for r in awkward():
        held = words(r[1])
        runs = plain_runs(held, Runs(3, 3)) if len(held) < 1000 else []
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        expected.append(repr((r[0], len(held), runs, " ".join(w for i, w in enumerate(held) if i not in gone))))
    assert got == sorted(expected)
    assert periods.find_runs(documents(spark, []), Runs()).collect() == []


def test_planted_and_strongest_runs(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % (j + 3)}" for j in range(i % 90)), "en", "a", 1) for i in range(300)]
    planted = periods.with_planted_runs(documents(spark, [*rows, (None, "a b c", None, None, None)]))
    found = periods.find_runs(planted, Runs(), columns=["doc_id"]).select("doc_id", "runs", periods.strongest(F.col("runs")).alias("best"))
    got = {r.doc_id: r for r in found.collect()}
    assert any(r.best for r in got.values())
    for key, text, *_ in rows:
        held, check = words(text), zlib.crc32(str(key).encode())
        if check % 10 == 0 and held:
            first = check // 10 % len(held)
            period = 1 + (len(held) - first) // (3 + check // 10 % 8)
            held = [held[i] if i < first else held[first + (i - first) % period] for i in range(len(held))]
        runs = plain_runs(held, Runs())
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert [tuple(r) for r in got[key].runs] == runs
        assert (got[key].best and tuple(got[key].best)) == best


def spoken(rng, alphabet, size):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 5))) for _ in range(size))


def test_languages_held_out(spark):
    """Three languages with words of their own, out of the same letters."""
    rng = random.Random(2)
    known = {name: spoken(rng, "abcdefghijklmnoprstuäö", 80).split() for name in ("aa", "bb", "cc")}
    texts = {name: [" ".join(rng.choices(w, k=rng.choice([20, 60, 400]))) for _ in range(40)] for name, w in known.items()}
    rows = [(i, t, name, None, 1) for i, (name, t) in enumerate((n, t) for n in texts for t in texts[n])]
    df = documents(spark, rows)
    known = languages.learn(df.where("doc_id % 4 <> 0"), Compression())
    found = languages.identify(df.where("doc_id % 4 = 0"), known, Compression()).collect()
    assert len(found) == 30
    assert sum(r.lang_pred == r.lang for r in found) >= 29
    assert all(r.accepted and 0.01 <= r.score <= 1 for r in found if r.lang_pred == r.lang)


def test_real_texts_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = languages.learn(df.where(~languages.held_out("doc_id")), Compression())
    found = languages.identify(df.where(languages.held_out("doc_id")), known, Compression()).collect()
    assert list(known)[0] == "en" and len(known) == 4
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def plain_dictionary(spark, rows, how):
    """Distinct texts by hash, as many bytes as fit."""
    by_language = {}
    for text, name, number in {tuple(r) for r in rows}:
        by_language.setdefault(name, []).append((number, text))
    result = {}
    for name, held in by_language.items():
        left, parts = how.dictionary_bytes, []
        for _, text in sorted(held):
            if left > 0:
                parts.append(languages.letters_of(text[:left]) or b"")
            left -= len(text.encode())
        result[name] = b"\n".join(parts)[: how.dictionary_bytes]
    return result


@pytest.mark.parametrize("size", [1, 300, 5000, 10**6])
def test_dictionaries_take_the_smallest_hashes(spark, size):
    rng = random.Random(4)
    rows = [(i, spoken(rng, "abcxyz", rng.randint(1, 80)), rng.choice(["aa", "bb", None]), None, 1) for i in range(120)]
    rows += [(500, rows[0][1], "aa", None, 1)] * 200
    how = Compression(dictionary_bytes=size)
    df = documents(spark, rows).repartition(3)
    number = F.xxhash64(F.lit(how.seed), "text").bitwiseAND((1 << 62) - 1)
    plain = df.where("lang is not null").select("text", "lang", number).collect()
    assert languages.learn(df, how) == plain_dictionary(spark, plain, how)


def test_languages_of_awkward_rows(spark):
    df = documents(spark).withColumn("score", F.lit("old")).withColumn("_text", F.lit("x"))
    known = languages.learn(df, Compression())
    assert set(known) == {"en", "xx", "fr"}
    found = languages.identify(df, known, Compression())
    assert found.columns == [*[c for c in df.columns if c != "score"], *languages.RESULTS]
    rows = found.collect()
    assert len(rows) == len(awkward())
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred in known) == letters and (letters or (r.lang_pred, r.score, r.accepted) == ("und", 0, False))
        assert 0 <= r.score <= 1
    assert len({(r.lang_pred, r.score) for r in rows if r.text and r.text.startswith("go go")}) == 1
    assert languages.identify(documents(spark, []), known, Compression()).collect() == []


def test_languages_without_labels(spark):
    df = documents(spark)
    assert languages.learn(df.where("lang is null or text is null"), Compression()) == {}
    assert {r.lang_pred for r in languages.identify(df, {}, Compression()).collect()} == {"und"}
    only = languages.identify(df, {"en": b"some words"}, Compression()).collect()
    assert {(r.lang_pred, r.score) for r in only} == {("en", 1.0), ("und", 0.0)}


def test_letters():
    assert [languages.letters_of(t) for t in (None, "", "12 ²³ _!", "A1b", "नमस्ते!", "É!É")] == [
        None, None, None, b" a b ", " नमस्ते ".encode(), " é é ".encode()
    ]


def test_narrow_margins_are_rejected():
    assert languages.choose(["a", "b"], [100, 100], Compression()) == ("a", 0.0, False)
    assert languages.choose(["a", "b"], [1000, 999], Compression())[::2] == ("b", False)
    assert languages.choose(["a", "b", "c"], [100, 80, 90], Compression()) == ("b", round(1 / 9, 6), True)


