"""The n-gram join against all pairs, and the sketches' promise on random sets."""

import random

import numpy as np
import pytest
from llm_data import SCHEMA, awkward, documents, words

from snapledger.llm import components, ngram_join
from snapledger.llm.components import stars
from snapledger.llm.ngram_join import Join, find_components, key_rows, one_of_each, shared_keys, sketch_keys
from snapledger.llm.shingles import distinct_shingles, hash_words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = words((text or "").translate(ASCII))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def plain_components(rows, join):
    sets = [shingles(r[1], join.width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            two = sets[j]
            shared = len(one & two)
            if one and two and 100 * shared >= join.percent * (len(one) + len(two) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), names.get(find(i))) for i, r in enumerate(rows)), key=repr)


def found(spark, rows, join):
    return sorted((tuple(r) for r in find_components(documents(spark, rows), join).collect()), key=repr)


@pytest.mark.parametrize("join", [Join(), Join(2, 60, 1.3)])
def test_awkward_rows(spark, join):
    rows = [tuple(r) for r in documents(spark).collect()]
    assert found(spark, rows, join) == plain_components(rows, join)


def test_empty_table(spark):
    assert found(spark, [], Join()) == []
    assert one_of_each(documents(spark, []), Join()).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def chains(seed):
    """Families of texts in which neighbours are alike and the ends are not, of many sizes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        text = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.choice([6, 9, 14, 30, 80, 300]))]
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), " ".join(text), None, None, None))
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice("xyz") * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 2])
def test_chains_of_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "ONE_TASK", 20_000 * (seed > 0))  # with 0, sketches refuse pairs
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", seed)  # with 0 rounds, all is left to the last step
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 0)
    join = Join(3, 70)
    rows = chains(seed)
    assert found(spark, rows, join) == plain_components(rows, join)


def test_sets_within_reach_share_a_key():
    rng = np.random.default_rng(1)
    join = Join(4, 85)
    starts = join.starts()
    for size in (1, 3, 7, 12, 40, 200, 900):
        for _ in range(15):
            one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            most = (100 - join.percent) * 2 * len(one) // (100 + join.percent)
            gone = rng.integers(0, most + 1)
            two = np.unique(np.append(one[gone:], rng.integers(0, 2**63, int(most - gone)).astype(np.uint64)))
            shared = len(np.intersect1d(one, two))
            if 100 * shared < join.percent * (len(one) + len(two) - shared):
                continue
            keys = []
            for found_set in (one, two):
                n = len(found_set)
                low = int(np.searchsorted(starts, n, side="right")) - 1
                high = int(np.searchsorted(starts, n * 100 // join.percent, side="right")) - 1
                bands = np.arange(low, high + 1)
                counts = np.array([join.words(b, starts) for b in bands.tolist()])
                bounds = np.arange(len(bands) + 1) * n
                found_keys, near, _ = sketch_keys(np.tile(found_set, len(bands)), bounds, bands, counts)
                keys.append([(int(k), int(m)) for k, m in zip(found_keys, near, strict=True)])
            cut = [(n, (1 << ngram_join.FORM * n) - 1) for n in range(1, ngram_join.NEXT_WORDS + 1)]
            near = lambda x, y: all((x & mask ^ y & mask).bit_count() <= n for n, mask in cut)
            assert any(k == k2 and near(m, m2) for k, m in keys[0] for k2, m2 in keys[1])


def test_words_do_not_cross_texts_or_blocks(monkeypatch):
    from snapledger.llm import shingles as module

    texts = ["ab cd", "", "cd", "  ", "ef\n" * 30, "g" * 50]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0, *[len(t) for t in texts]])
    whole, before = hash_words(data, bounds)
    assert np.diff(before).tolist() == [2, 0, 1, 0, 30, 1]
    assert whole[1] == whole[2]
    monkeypatch.setattr(module, "BLOCK", 7)
    parted, again = hash_words(data, bounds)
    assert (whole == parted).all() and (before == again).all()
    values, held = distinct_shingles(whole, before, 4)
    assert np.diff(held).tolist() == [1, 0, 1, 0, 1, 1] and len(values) == 4
    again, held = distinct_shingles(whole, before, 1)
    assert np.diff(held).tolist() == [2, 0, 1, 0, 1, 1] and again[1] != again[0]


def test_shared_keys_over_batches():
    import pyarrow as pa

    rows = [(1, 5, 0), (1, 5, 0), (2, 5, 0), (2, 6, 1), (2, 6, 1), (2, 9, 1), (3, 1, 0), (4, 7, 0), (4, 8, 0)]
    rows = [(key << 16, sig, near) for key, sig, near in rows]
    expected = [(2, 5, 0, 5, 0), (2, 5, 0, 6, 1), (2, 5, 0, 9, 1), (4, 7, 0, 7, 0), (4, 7, 0, 8, 0)]
    far = 0xFFFFFFFF << 16
    expected = [(key << 16, first, one | far, sig, two | far) for key, first, one, sig, two in expected]
    for size in (1, 2, 3, 9):
        batches = []
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            columns = [pa.array([key + near for key, _, near in part]), pa.array([sig for _, sig, _ in part])]
            batches.append(pa.record_batch([*columns, pa.array([-1] * len(part), pa.int32())], names=["key", "sig", "far"]))
        got = [tuple(r.values()) for b in shared_keys(iter(batches)) for r in b.to_pylist()]
        assert sorted(set(got)) == expected and len(got) <= len(expected) + 1


@pytest.mark.parametrize("most", [3, 256])
def test_keys_are_split_by_near_forms(monkeypatch, most):
    """Sets without a near one under their key go, others stay with all they are near to, at any batch size."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "NEAR_SETS", most)
    rng = random.Random(4)
    bits = lambda: sum(1 << 8 * w + b for w in range(6) for b in [rng.randrange(40)] if b < 8)
    bases = [rng.getrandbits(48) for _ in range(3)]
    rows = {(key << 16, sig): rng.choice(bases) ^ bits() for key in range(60) for sig in range(rng.choice([1, 2, 3, 9]))}
    rows = sorted((key | near & 0xFFFF, sig, near) for (key, sig), near in rows.items())
    cut = [(n, (1 << 8 * n) - 1) for n in range(1, 7)]
    near = lambda x, y: all((x & mask ^ y & mask).bit_count() <= n for n, mask in cut)
    pairs = {(k >> 16, a, b) for k, a, x in rows for k2, b, y in rows if k >> 16 == k2 >> 16 and a < b and near(x, y)}
    lonely = {(k >> 16, a) for k, a, _ in rows} - {(k, s) for k, *both in pairs for s in both}
    assert len(pairs) > 20 < len(lonely)
    for lines, size in ((1, 1), (1, 7), (1 << 14, 50)):
        monkeypatch.setattr(ngram_join, "PART_LINES", lines)
        batches = []
        for at in range(0, len(rows), size):
            key, sig, forms = zip(*rows[at : at + size], strict=True)
            far = pa.array(np.array([f >> 16 for f in forms], dtype=np.uint32).view(np.int32))
            batches.append(pa.record_batch([pa.array(key), pa.array(sig), far], names=["key", "sig", "far"]))
        got = [r for b in shared_keys(iter(batches)) for r in b.to_pylist()]
        together = {}
        for r in got:
            together.setdefault(r["key"], set()).add(r["sig"])
        found = {(k >> 16, a, b) for k, sigs in together.items() for a in sigs for b in sigs if a < b}
        assert pairs <= found
        if most == 256:
            assert not lonely & {(r["key"] >> 16, r["sig"]) for r in got}


def test_copies_in_a_task_send_keys_once():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["a b c d e f g"] * 3 + ["", None])], names=["_text"])
    once = pa.record_batch([pa.array(["a b c d e f g"])], names=["_text"])
    rows = lambda b: sum(out.num_rows for out in key_rows(Join())(iter([b])))
    assert rows(batch) == rows(once) > 0


def test_one_of_each(spark):
    rows = documents(spark).collect()
    left = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in one_of_each(documents(spark), Join()).collect())
    ids = [i for i, _ in left]
    assert 2 not in ids and 3 not in ids and 11 not in ids and ids.count(14) == 1
    assert {1, 4, 5, 6, 7, 9, 10, 12, 13} <= set(ids) and ids.count(0) == 2
    assert len(rows) > len(left)


def test_one_of_each_decides_by_row(spark):
    """Texts that share a key, and near copies without one, go or stay by themselves."""
    left = [(r.doc_id, r.text) for r in one_of_each(documents(spark), Join()).collect()]
    assert [t for i, t in left if i == 15] == ["other text under one number"]
    base = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"item{i}" for i in range(120))
    rows = [(5, f"a text number {i} of its own", "en", "a", 1) for i in range(9)]
    rows += [(None, base + f" more {i}", "en", "a", i) for i in range(4)] + [(None, base + " more 0", "de", "b", 7)] * 3
    rows += [(6, other, "en", "a", 1), (6, other + " end", "en", "b", 2), (6, other.upper(), "en", "c", 3), (7, other, "en", "d", 4)]
    rows += [(None, other, "en", "a", 1), (None, "", "en", "a", 1), (5, None, "en", "a", 1), (5, None, "en", "a", 1)]
    got = [tuple(r) for r in one_of_each(documents(spark, rows), Join()).collect()]
    assert len([r for r in got if r[0] == 5]) == 11 and len([r for r in got if r[0] == 6]) == 1
    assert len([r for r in got if r[0] is None and r[1]]) == 1 and (None, "", "en", "a", 1) in got
    assert len(got) == 14 and set(got) <= set(rows)
    again = one_of_each(documents(spark, rows[::-1]).repartition(3), Join()).collect()
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in again)


@pytest.mark.parametrize("sets", [1, 2, 1000])
def test_every_link_is_found(spark, monkeypatch, sets):
    """Also inside a component; copies are counted, not expanded."""
    monkeypatch.setattr(ngram_join, "KEY_SETS", sets)
    join = Join(2, 60, 1.3)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]]), None, None, None) for i in range(14)]
    rows += [*[(50 + i, rows[0][1].upper(), None, None, None) for i in range(3)], *awkward(), *chains(5)[:40]]
    sets_of = [shingles(r[1], join.width) for r in rows]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= join.percent * len(x | y)
    counts = sorted(
        ((r[0], sum(alike(one, two) for j, two in enumerate(sets_of) if j != i)) for i, (r, one) in enumerate(zip(rows, sets_of))), key=repr
    )
    assert max(n for _, n in counts) >= 16
    got = ngram_join.count_links(documents(spark, rows), join).collect()
    assert sorted(((r._key, r.n_links) for r in got), key=repr) == counts
    distinct = list({s for s in sets_of if s})
    links = ngram_join.find_links(documents(spark, rows), join).collect()
    assert len(links) == len({frozenset((r.class_a, r.class_b)) for r in links})
    assert len(links) == sum(alike(x, y) for i, x in enumerate(distinct) for y in distinct[:i])


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_long_path(spark, one_task, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in stars(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_sketches_of_whole_sets(spark):
    """Their distance is never above the difference, at any widths, and near it for similar sets."""
    rng = np.random.default_rng(3)
    join, rows = Join(4, 85), []
    for size in (1, 2, 9, 60, 100, 400, 5000):
        for gone in {0, 1, size // 20, size // 6, size // 2, size}:
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            two = np.append(one[gone:], rng.integers(0, 2**63, int(gone * rng.choice([0, 1, 3]))).astype(np.uint64))
            if not len(two):
                continue
            apart = len(np.setxor1d(one, two))
            sketches = [ngram_join.whole_sketch(x, join) for x in (one, two)]
            if 100 * min(len(one), len(two)) < 85 * max(len(one), len(two)):
                continue  # sizes alone rule these out
            assert max(map(len, sketches)) <= 2 * min(map(len, sketches))
            similar = 100 * (len(one) + len(two) - apart) >= join.percent * (len(one) + len(two) + apart)
            assert (apart <= join.may_differ(len(one) + len(two))) == similar
            rows.append((len(one), len(two), *[x.tolist() for x in sketches], apart, similar))
    frame = spark.createDataFrame(rows, "a_n long, b_n long, a_sketch array<bigint>, b_sketch array<bigint>, apart long, similar boolean")
    got = frame.withColumn("fit", ngram_join.sketches_fit(join, "a", "b")).collect()
    assert all(r.fit for r in got if r.similar) and sum(r.similar for r in got) > 10
    assert len({len(r.a_sketch) == len(r.b_sketch) for r in got}) == 2
    wide = [r for r in got if r.a_n >= 60 and r.apart > 1.4 * join.may_differ(r.a_n + r.b_n)]
    assert wide and not any(r.fit for r in wide)


def test_keys_of_many_sets(spark, monkeypatch):
    """Sets that share nothing but one passage, some of them near copies, with every key cut into groups."""
    monkeypatch.setattr(ngram_join, "KEY_SETS", 1)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 0)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(40):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(60))
        rows += [(10 * i + j, f"{passage} {own} {'end ' * (j > 0)}{j}", None, None, None) for j in range(i % 3 + 1)]
    join = Join(4, 85)
    expected = plain_components(rows, join)
    assert len({r[2] for r in expected}) == 40
    assert found(spark, rows, join) == expected


def test_keys_of_few_sets_are_opened_once(spark, monkeypatch):
    """They are done with every pair of the first turn; only keys of more sets go on to the next ones."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 1)
    monkeypatch.setattr(ngram_join, "NEAR_SETS", 1)
    turns, opened = [], ngram_join.open_members

    def counted(*given):
        members = opened(*given)
        turns.append([r["count"] for r in members.groupBy("key").count().collect()])
        return members

    monkeypatch.setattr(ngram_join, "open_members", counted)
    rng = random.Random(9)
    text = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    texts = []
    for shared, families in ((text(90), 30), *[(text(90), 2) for _ in range(6)]):
        for _ in range(families):
            own = text(60)
            texts += [f"{shared} {own} {'end ' * j}{j}" for j in range(rng.choice([1, 2, 3]))]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [(len(rows) + r[0], *r[1:]) for r in chains(3)]
    join = Join(4, 85)
    assert found(spark, rows, join) == plain_components(rows, join)
    assert len(turns) > 1 and min(turns[0]) < 4 < max(turns[0])
    assert min(turns[1]) > 3
