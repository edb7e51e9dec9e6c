"""Quality rules, sharding and mixing on awkward rows and against plain versions."""

import math
import zlib
from collections import Counter

import pytest
from llm_data import awkward, documents, words
from pyspark.sql import functions as F
from test_oracles import SF_DIR

from snapledger.llm import mixing, quality_rules, sharding
from snapledger.llm.common import count_words, running_sums
from snapledger.llm.queries import QUERIES


def plain_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_counts(spark):
    rows = [*awkward(), (50, "a b c a b c a b\nx\nx \nx\n\n\n#*|", None, None, 1), (51, "p q r s t p q r", "en", "a", 1)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.measure(documents(spark, rows).withColumn("n_words", F.lit("clash")))
    assert sorted((r.doc_id or 0, *[r[n] for n in names]) for r in got.collect()) == sorted(
        (r[0] or 0, *plain_counts(r[1])) for r in rows
    )


def test_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.05), (20, 4000, 0.005), (0, 100000, 0.005)]
    for wrong, total, rate in cases:
        tail = quality_rules.binomial_tail(F.lit(wrong).cast("long"), F.lit(total).cast("long"), rate)
        expected = sum(
            math.exp(
                math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1)
                + i * math.log(rate) + (total - i) * math.log(1 - rate)
            )
            for i in range(wrong + 1)
        )
        assert spark.range(1).select(tail).first()[0] == pytest.approx(expected, rel=1e-9)


def test_cutoffs_need_evidence(spark):
    good = " ".join(f"w{i}" for i in range(60))
    bad = " ".join("#" + w for w in good.split())
    rows = [(i, f"{good} {i}", "en", "a", 1) for i in range(3000)] + [(5000 + i, f"{bad} {i}", "en", "a", 1) for i in range(50)]
    rows += [(9000 + i, f"{good} fr{i}", "fr", "a", 1) for i in range(20)] + [(9900, bad, "fr", "a", 1)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame(
        [(r[0], int(r[0] < 5000 or 9000 <= r[0] < 9900), 0) for r in rows] + [(None, 1, 0), (7, None, 0), (123456, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    risk = quality_rules.Risk()
    measured = quality_rules.measure(docs)
    cutoffs = quality_rules.find_cutoffs(measured, labels, risk)
    cuts = {r.stratum: r.cut_symbols for r in cutoffs.collect()}
    assert cuts["en"] is not None and cuts.get("fr") is None
    judged = {r.doc_id: r.passed for r in quality_rules.judge(measured, cutoffs, risk).collect()}
    assert all(judged[i] for i in range(3000)) and not any(judged[5000 + i] for i in range(50))
    assert judged[9900], "a stratum without evidence rejects nothing"
    nothing = quality_rules.find_cutoffs(measured, labels.limit(0), risk)
    assert all(r.passed for r in quality_rules.judge(measured, nothing, risk).collect())
    empty = quality_rules.measure(documents(spark, []))
    assert quality_rules.judge(empty, cutoffs, risk).count() == 0


def check_rows_law(got, total, shards):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 16, 1 << 30])
def test_shards(spark, bucket_bytes):
    docs = documents(spark).withColumns({"bucket": F.lit("clash"), "offset": F.lit(1), "Slot": F.lit(2)})
    shuffle = sharding.Shuffle(4, bucket_bytes)
    got = sharding.shuffle_records(docs, shuffle).collect()
    check_rows_law(got, len(awkward()), 4)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in awkward())
    again = sharding.shuffle_records(docs.repartition(5), shuffle).collect()
    key = lambda r: (r.shard, r.slot, r.doc_id or 0, r.text or "")
    assert sorted(map(key, got)) == sorted(map(key, again)), "the order of arrival must not matter"
    assert sharding.shuffle_records(documents(spark, []), shuffle).count() == 0


def test_one_key_with_most_texts(spark):
    """A key larger than a bucket is spread; records equal in key and text are told apart by the rest."""
    rows = [(7, f"text number {i} " * 20, "en", "a", i) for i in range(400)]
    rows += [(i, "short", "en", "a", i) for i in range(100, 150)] + [(8, "same", "en", str(i), i) for i in range(40)]
    docs, shuffle = documents(spark, rows), sharding.Shuffle(4, 4 << 10)
    got = sharding.shuffle_records(docs, shuffle).collect()
    check_rows_law(got, len(rows), 4)
    again = sharding.shuffle_records(documents(spark, rows[::-1]).repartition(7), shuffle).collect()
    key = lambda r: (r.shard, r.slot, r.doc_id, r.text, r.source)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert [r._large for r in sharding.large_keys(docs, "doc_id", "text", 4 << 10).collect()] == [7]
    neighbours = sorted((r.shard, r.slot, r.doc_id) for r in got)
    assert sum(a[2] != b[2] for a, b in zip(neighbours, neighbours[1:], strict=False)) > 60


def test_equal_sizes_keep_their_order_in_the_mix(spark):
    rows = [(5, f"t{i}", "en", "a", i) for i in range(50)] + [(6, "t", "en", "b", 1)]
    mix = lambda df: [tuple(r) for r in mixing.mix_rows(df, mixing.Mix(), "doc_id", "source", F.lit(3)).collect()]
    assert mix(documents(spark, rows)) == mix(documents(spark, rows[::-1]).repartition(5))


def test_shard_query(spark):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op3_sharding"](spark, SF_DIR).collect()
    check_rows_law(got, len(source), 16)
    for r in got:
        raw = (source[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:], strict=False)) < 0.7 * len(order)


def plain_targets(sizes, weights, cap, budget):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), budget
    while open_:
        total = sum(weight[n] for n in open_)
        full = {n for n in open_ if left * weight[n] / total > cap * sizes[n]}
        if not full:
            target.update({n: left * weight[n] / total for n in open_})
            break
        for n in full:
            target[n] = cap * sizes[n]
        left -= sum(target[n] for n in full)
        open_ -= full
    return target


def check_mix(rows, mix):
    sizes = Counter()
    for r in rows:
        sizes[(r.source is None, r.source or "")] += r.size
    target = plain_targets(sizes, mix.weights, mix.max_repeats, sum(sizes.values()) * mix.budget)
    taken, largest = Counter(), Counter()
    for r in rows:
        k = (r.source is None, r.source or "")
        assert r.source_size == sizes[k] and r.target == pytest.approx(target[k])
        assert 0 <= r.copies <= mix.max_repeats
        taken[k] += r.size * r.copies
        largest[k] = max(largest[k], r.size)
    for k, size in largest.items():
        assert abs(taken[k] - target[k]) <= size / 2 + 1e-6


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix((1, 9), 2, 0.5, 3), mixing.Mix((1,), 1, 2.0)])
def test_mix(spark, mix):
    rows = [*awkward(), *[(100 + i, "w " * (i % 7), None, f"s{i % 5}", 1) for i in range(300)]]
    docs = documents(spark, rows).withColumns({"size": F.lit("clash"), "target": F.lit(0), "_part": F.lit(1)})
    planned = mixing.schedule(docs, mix, "doc_id", "source", count_words("text"))
    check_mix(planned.collect(), mix) if mix.budget <= 1 else None
    again = mixing.schedule(docs.repartition(3), mix, "doc_id", "source", count_words("text"))
    key = lambda r: (r.doc_id or 0, r.size, r.copies, tuple(r.finish))
    assert sorted(map(key, planned.collect())) == sorted(map(key, again.collect()))
    mixed = mixing.mix_rows(docs, mix, "doc_id", "source", count_words("text")).collect()
    assert len(mixed) == sum(r.copies for r in planned.collect())
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)


def test_mix_of_nothing(spark):
    for rows in ([], [(1, "", None, None, 0), (2, None, None, "a", None)]):
        got = mixing.schedule(documents(spark, rows), mixing.Mix(), "doc_id", "source", count_words("text")).collect()
        assert len(got) == len(rows) and all(r.size == 0 and r.target == 0 for r in got)


def test_mix_keeps_its_pace(spark):
    """At any point of the mix, uncapped sources have given tokens in proportion to their weights."""
    rows = [(i, "w " * 10, None, "ab"[i % 2], 1) for i in range(2000)]
    mix = mixing.Mix((3, 1), 3, 0.5)
    mixed = mixing.mix_rows(documents(spark, rows), mix, "doc_id", "source", count_words("text")).collect()
    for at in (200, 500, 900):
        given = Counter(r.source for r in mixed[:at])
        assert given["a"] == pytest.approx(3 * given["b"], abs=4)


def test_mix_query(spark):
    got = QUERIES["op5_mixing"](spark, SF_DIR).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in got} == {i: len(words(d.text)) for i, d in docs.items()}
    by = Counter()
    for r in got:
        by[docs[r.doc_id].source] += r.taken
    targets = {docs[r.doc_id].source: r.target for r in got}
    most = max(r.size for r in got)
    assert all(abs(by[s] - t) <= most / 2 + 1e-6 for s, t in targets.items())


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    df = spark.createDataFrame([(i * 3, i + 1) for i in range(50)], "k long, v long")
    got = {r.k: r.before_v for r in running_sums(df, "k", ["v"], descending, block=7).collect()}
    order = sorted(got, reverse=descending)
    assert [got[k] for k in order] == [sum(j // 3 + 1 for j in order[:i]) for i in range(50)]
