"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
from llm_data import awkward, documents, words
from pyspark.sql import functions as F
from test_llm_ngram_join import plain_components
from test_llm_rules_and_mix import plain_targets
from test_oracles import SF_DIR

from snapledger.llm import classifier, mixing, quality_rules
from snapledger.llm.ngram_join import Join

SF = SF_DIR.replace("sf0.001", "sf0.01")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "drop_junk", "keep_good", "drop_near_copies", "mix_sources", "encode_pieces",
    ]


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    after = corpus_pipeline.drop_junk(spark, docs, SF)
    assert after.columns == COLUMNS
    rows = after.collect()
    ids = {r.doc_id for r in rows}
    for r in docs.collect():
        if labels.get(r.doc_id) == 1:
            assert r.doc_id in ids, "clean documents stay"

    kept = corpus_pipeline.keep_good(spark, docs, SF)
    assert kept.columns == COLUMNS
    left = {r.doc_id for r in kept.collect()}
    held = [r[0] for r in docs.where(classifier.held_out("doc_id")).select("doc_id").collect() if r[0] in labels]
    assert sum((i in left) == (labels[i] == 1) for i in held) / len(held) > 0.95

    small = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    one = corpus_pipeline.drop_near_copies(spark, small, SF_DIR)
    assert one.columns == COLUMNS
    source = [tuple(r) for r in small.collect()]
    expected = {c for _, n, c in plain_components(source, Join()) if n}
    assert Counter(r.doc_id for r in one.collect()) == Counter(expected)

    mixed = corpus_pipeline.mix_sources(spark, small, SF_DIR)
    assert mixed.columns == COLUMNS
    mix = mixing.Mix()
    sizes, taken = Counter(), Counter()
    for r in source:
        sizes[r[3]] += len(words(r[1]))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    most = max(len(words(r[1])) for r in source)
    for name, target in plain_targets(sizes, mix.weights, mix.max_repeats, sum(sizes.values())).items():
        assert abs(taken[name] - target) <= most / 2 + 1e-6

    encoded = corpus_pipeline.encode_pieces(spark, small, SF_DIR)
    assert encoded.where("lossless").count() == len(source)
    small.unpersist()


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.count() > 0 and got.where("not lossless").count() == 0


def test_awkward_and_empty_documents(spark):
    for rows in (awkward(), []):
        docs = documents(spark, rows)
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, SF_DIR)
            assert out.columns == COLUMNS
            found = {(r.doc_id, r.text) for r in out.collect()}
            assert found <= {(r[0], r[1]) for r in rows}
        last = corpus_pipeline.encode_pieces(spark, docs, SF_DIR)
        assert last.where(F.col("lossless")).count() == len(rows)


def test_rules_without_evidence_reject_only_repeats(spark):
    got = {r.doc_id for r in corpus_pipeline.drop_junk(spark, documents(spark), SF_DIR).collect()}
    assert 14 not in got and {1, 4, 5, 7, 10, 12} <= got
    assert quality_rules.BASE_WORDS == 50
