"""Classifier, sampled pieces, token counts and chat formatting."""

import math
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from llm_data import awkward, documents
from pyspark.sql import functions as F
from test_oracles import SF_DIR

from snapledger.llm import chat_format, classifier, sampled_pieces, token_counts
from snapledger.llm.queries import QUERIES, vocabulary

SF = SF_DIR.replace("sf0.001", "sf0.01")


def test_classifier_on_the_held_out_fold(spark):
    got = QUERIES["op7_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in held)
    bad = [r for r in held if r.quality == 0]
    assert len(held) > 50 and right / len(held) > 0.95
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.8


def test_classifier_on_awkward_rows(spark):
    training = classifier.Training(train_rows=50, steps=500, buckets_bits=10)
    docs = documents(spark, [*awkward(), *[(200 + i, f"good words here {i}" if i % 2 else "### !!! ###", "en", "a", 1) for i in range(60)]])
    docs = docs.withColumns({"score": F.lit("clash"), "good": F.lit(1)})
    labels = spark.createDataFrame([(200 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (201, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(docs, labels, training, "doc_id", "text")
    rows = classifier.score(docs, model, training).collect()
    assert len(rows) == len(awkward()) + 60 and all(0 <= r.score <= 1 for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(r.text or "", r.score) == r.score
        assert r.predicted == (r.score >= classifier.THRESHOLD)
    by = {r.doc_id: r.predicted for r in rows}
    assert all(by[200 + i] == i % 2 for i in range(60))
    again = classifier.train(docs.repartition(4), labels, training, "doc_id", "text")
    assert (model[0] == again[0]).all() and model[1] == again[1]
    for few in (labels.limit(0), labels.where("quality = 1")):
        constant = classifier.train(docs, few, training, "doc_id", "text")
        assert len({r.score for r in classifier.score(docs, constant, training).collect()}) == 1
    assert classifier.score(documents(spark, []), model, training).count() == 0


def test_folded_model_equals_the_network():
    """Scoring by one number per bucket is the linear layer over the averaged vectors."""
    training = classifier.Training(steps=200, buckets_bits=6, dim=4)
    texts = ["a b a a", "zz !!", "", "a b c d"]
    features = list(classifier.texts_of(pa.array(texts), training.buckets_bits))
    numbers, bias = classifier.fit(features, np.array([1, 0, 0, 1]), training)
    for found in features:
        total = bias + sum(float(parts @ numbers[g, ids]) for g, (ids, parts) in enumerate(found))
        assert math.isfinite(total)
    by_text = [bias + sum(float(p @ numbers[g, i]) for g, (i, p) in enumerate(f)) for f in features]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0, *[len(t) for t in texts]])
    total = np.full(len(texts), bias)
    for g, (ids, ends) in enumerate(classifier.feature_ids(data, bounds, training.buckets_bits)):
        total += classifier.segment_means(numbers[g][ids], ends)
    assert total == pytest.approx(by_text)


@pytest.fixture(scope="module")
def pieces():
    return sampled_pieces.Pieces(vocabulary("piece_bpe_32k.model"))


def test_pieces_decode_to_the_text(spark, pieces):
    docs = documents(spark).withColumns({"pieces": F.lit("clash"), "row_key": F.lit(7)})
    encoded = sampled_pieces.encode(docs, pieces)
    rows = sampled_pieces.decode(encoded, pieces).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((r[0], r[1]) for r in awkward())
    assert all((r.pieces is None) == (r.text is None) for r in rows)
    assert next(r.pieces for r in rows if r.text == "") == []
    again = sampled_pieces.encode(docs.repartition(5), pieces).collect()
    key = lambda r: (r.doc_id or 0, r.text or "", r.pieces or [])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sampled_pieces.decode(sampled_pieces.encode(documents(spark, []), pieces), pieces).count() == 0


def test_piece_query_is_lossless(spark):
    got = QUERIES["op9_sampled_pieces"](spark, SF_DIR).collect()
    assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in got)


def test_samples_follow_the_weights(pieces):
    """Sampled cuts of one word against the chances of all its cuts."""
    trie = sampled_pieces.load(pieces)
    contents = {trie.content[b : b + n].tobytes(): i for i, (b, n) in enumerate(zip(trie.begins, trie.lengths, strict=True)) if n}
    for i in trie.one_byte.tolist():
        contents[trie.content[trie.begins[i] : trie.begins[i] + 1].tobytes()] = i
    word = b" the"
    chances = {}
    for cuts in product([False, True], repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate([*cuts, True]):
            if cut:
                parts.append(word[at : i + 1])
                at = i + 1
        if all(p in contents for p in parts):
            ids = tuple(contents[p] for p in parts)
            chances[ids] = math.exp(sum(trie.weights[i] for i in ids))
    total = sum(chances.values())
    data = np.frombuffer(word, dtype=np.uint8)
    filtered = sampled_pieces.forward(trie, data, np.array([0]), np.array([4]))
    n = 40000
    zeros = np.zeros(n, dtype=np.int64)
    rows = sampled_pieces.mix64(np.arange(n, dtype=np.uint64))
    ids, counts = sampled_pieces.draw(filtered, zeros, zeros + 3, rows, zeros.astype(np.uint64))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True))
    assert set(seen) <= set(chances)
    for cut, chance in chances.items():
        p = chance / total
        assert abs(seen[cut] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_pieces_in_one_go_or_in_parts(pieces, monkeypatch):
    texts = ["one two  three", "", "ünï 漢字▁ x", "a" * 300, " lead", "tail "] * 5
    whole = list(cut(pieces, texts, 1 << 20))
    assert whole == list(cut(pieces, texts, 8))


def test_memory_of_pieces_follows_parts_not_batches(pieces):
    """Arrays of a batch of 1000 texts, each way, stay near those of one part."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).tolist()).decode() for n in rng.integers(2, 9, 2000)]
    texts = [" ".join(rng.choice(words, 600)) for _ in range(998)] + [None, ""]
    trie, column = sampled_pieces.load(pieces), pa.array(texts)
    peaks = []

    def measured(function, *args):
        tracemalloc.start()
        found = function(*args)
        peaks.append(tracemalloc.get_traced_memory()[1] - found.nbytes)
        tracemalloc.stop()
        return found

    lists = measured(sampled_pieces.encode_column, trie, pieces, column, np.arange(1000))
    decoded = measured(sampled_pieces.decode_column, trie, lists)
    assert decoded.to_pylist() == texts and column.nbytes > 6 * sampled_pieces.BATCH_BYTES
    assert sampled_pieces.decode_column(trie, lists.slice(7, 991)).to_pylist() == texts[7:998]
    assert max(peaks) < 40 << 20, peaks


def cut(pieces, texts, size):
    trie, keys = sampled_pieces.load(pieces), np.arange(len(texts))
    for data, bounds, first in sampled_pieces.text_parts(pa.array(texts), size):
        ids, before = sampled_pieces.encode_part(trie, pieces, data, bounds, keys[first : first + len(bounds) - 1])
        yield from (ids[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True))


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers

    return token_counts.Encoding(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_histogram_answers_every_limit(spark, encoding):
    docs = documents(spark).withColumn("n_tokens", F.lit("clash"))
    lengths = token_counts.encoded_lengths(docs, encoding)
    coder = token_counts.load(encoding)
    plain = [len(coder.encode_ordinary(r[1] or "")) for r in awkward()]
    assert sorted(r.n_tokens for r in lengths.collect()) == sorted(plain)
    lines = token_counts.histogram(lengths)
    for r in lines.collect():
        limit = r.n_tokens
        assert r.docs == plain.count(limit) and r.tokens == limit * r.docs
        assert r.docs_longer == sum(n > limit for n in plain) and r.tokens_longer == sum(n for n in plain if n > limit)
        assert r.docs_shorter == sum(n < limit for n in plain) and r.tokens_shorter == sum(n for n in plain if n < limit)
        assert r.truncated_tokens == sum(min(n, limit) for n in plain)
    assert lines.agg(token_counts.truncated_total(lines, 50)).first()[0] == sum(min(n, 50) for n in plain)
    ordered = sorted(plain)
    for part in (0.1, 0.5, 0.99, 1.0):
        expected = ordered[max(0, math.ceil(part * len(ordered) - 1e-9) - 1)]
        assert token_counts.quantile(lines, part).first()[0] == expected
    assert token_counts.histogram(token_counts.encoded_lengths(documents(spark, []), encoding)).count() == 0


def test_token_query(spark, encoding):
    coder = token_counts.load(encoding)
    plain = Counter(len(coder.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())
    assert {r.n_tokens: r.docs for r in QUERIES["op4_token_counts"](spark, SF_DIR).collect()} == dict(plain)


TURNS = "conv_id long, turn long, role string, text string"


def chat(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def talks(n, turns):
    rows = []
    for c in range(n):
        for t in range(turns):
            role = "system" if t == 0 else "user" if t % 2 else "assistant"
            text = {"system": "Be brief.", "user": f"What is {c} plus {t}?", "assistant": "\n".join([f"It is a long answer {c} {t} " * 6] * 3)}[role]
            rows.append((c, t, role, text))
    return rows


def test_marked_turns_are_recovered(spark):
    rows = talks(12, 7)
    transcripts = chat_format.as_transcripts(chat(spark, rows), unmarked=10**9)
    lines = chat_format.lines_of(transcripts, keep=("role",)).cache()
    model = chat_format.fit(lines)
    got = {(int(r.conv), r.turn_no): r.rendered for r in chat_format.render(chat_format.recover(lines, model)).collect()}
    assert got == {(c, t): f"<|im_start|>{role}\n{text}<|im_end|>" for c, t, role, text in rows}
    lines.unpersist()


def test_blocks_give_the_path_of_one_go(spark, monkeypatch):
    rows = talks(3, 40)
    transcripts = chat_format.as_transcripts(chat(spark, rows), unmarked=3)
    outcomes = []
    for block in (10**6, 7, 1):
        monkeypatch.setattr(chat_format, "BLOCK_TURNS", block)
        lines = chat_format.lines_of(transcripts, keep=("role",)).cache()
        if not outcomes:
            model = chat_format.fit(lines)
        recovered = chat_format.recover(lines, model)
        outcomes.append(sorted((r.conv, r.turn_no, r.role, r.rendered) for r in chat_format.render(recovered).collect()))
        lines.unpersist()
    assert outcomes[0] == outcomes[1] == outcomes[2]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    states, n = chat_format.STATES, 4
    start, step = np.log(rng.dirichlet(np.ones(states))), np.log(rng.dirichlet(np.ones(states), states))
    seen = np.log(rng.random((n, states)))
    score = lambda p: start[p[0]] + sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(seen[t, s] for t, s in enumerate(p))
    best = max(product(range(states), repeat=n), key=score)
    model = chat_format.Model(start, step, np.zeros((states, 4)), np.zeros((states, 1)))
    for cut in (1, 2, 3):
        tables = [chat_format.best_through(model, seen[:cut]), chat_format.best_through(model, seen[cut:])]
        ends = chat_format.states_between(tables)
        one = chat_format.best_path(start, step, seen[:cut], ends[0])
        two = chat_format.best_path(step[ends[0]], step, seen[cut:], ends[1])
        assert tuple([*one, *two]) == best


def test_awkward_transcripts(spark):
    rows = [
        (1, 0, "user", None), (1, None, "user", "User: hi"), (1, 2, None, ""), (1, 2, "assistant", "A: yes\n\nAI: no"),
        (None, 0, "user", "Human: who"), (None, 1, "tool", "x"), (2, 0, "user", "y " * 50_000), (2, 0, "user", "y " * 50_000), (3, 5000, "user", "late"),
    ]
    lines = chat_format.lines_of(chat(spark, rows).withColumn("extra", F.lit(1)), keep=("role",)).cache()
    model = chat_format.fit(lines)
    turns = chat_format.render(chat_format.recover(lines, model)).collect()
    total = sum(len((r[3] or "").split("\n")) for r in rows)
    assert sum(r.n_lines for r in turns) == total
    assert {r.conv for r in turns} == {"1", "2", "3", None} and all(r.role in chat_format.ROLES for r in turns)
    none = chat_format.lines_of(chat(spark, []), keep=("role",))
    even = chat_format.fit(none)
    assert chat_format.recover(none, even).count() == 0
    assert chat_format.render(chat_format.recover(lines, even)).count() > 0
    lines.unpersist()


def test_chat_query_recovers_most_roles(spark):
    """Of conversations that the model was not trained on, and there of turns without a marker."""
    held_out = lambda key: zlib.crc32(str(key).encode()) % 5 == 0
    got = [r for r in QUERIES["op10_chat_format"](spark, SF).collect() if held_out(r.conv_id)]
    found = Counter((r.conv_id, r.rendered) for r in got)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    source = spark.read.parquet(f"{SF}/conversations.parquet").withColumn("bare", bare)
    shares = []
    for unmarked in (False, True):
        turns = [r for r in source.collect() if held_out(r.conv_id) and (r.bare or not unmarked)]
        plain = Counter((r.conv_id, f"<|im_start|>{r.role}\n{r.text}<|im_end|>") for r in turns)
        shares.append(sum((plain & found).values()) / sum(plain.values()))
    print(f"recovered of held-out turns {shares[0]:.3f}, of those without a marker {shares[1]:.3f}")
    assert shares[0] > 0.75 and shares[1] > 0.3


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_steps_are_counted_line_by_line(spark, monkeypatch, block):
    """Also inside turns, and from block to block."""
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", block)
    turns = [("user", 2), ("assistant", 1), ("user", 2), ("assistant", 7), ("assistant", 1), ("user", 2), ("system", 1)]
    rows = [(c, i, role, "\n".join(f"line {k}" for k in range(n))) for c in (1, None) for i, (role, n) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    states = [2 * chat_format.ROLES.index(role) + (k > 0) for role, n in turns for k in range(n)]
    counts = np.zeros((chat_format.STATES, chat_format.STATES))
    for one, two in zip(states, states[1:]):
        counts[one, two] += 2
    allowed = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(chat_format.STATES)] for a in range(chat_format.STATES)])
    model = chat_format.fit(chat_format.lines_of(df, keep=("role",)))
    assert np.exp(model.step) == pytest.approx(np.exp(chat_format.shares(counts, allowed)))
