"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stage
from . import (
    chat_format,
    classifier,
    languages,
    merkle,
    mixing,
    ngram_join,
    periods,
    quality_rules,
    sampled_pieces,
    sharding,
    style_tree,
    syncmers,
    token_counts,
)
from .common import count_words, table


def vocabulary(name: str) -> str:
    """A public vocabulary file: in the folder the setting names, else where the package has it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    join = ngram_join.Join(width=4, percent=85)
    return ngram_join.find_components(documents, join).withColumnRenamed("_key", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = quality_rules.Risk()
    documents = table(spark, sf_dir, "documents")
    # Staged without the texts: the cutoffs and the verdicts both read it.
    measured = stage(quality_rules.measure(documents).drop("text"), "measured")
    cutoffs = quality_rules.find_cutoffs(measured, table(spark, sf_dir, "labels"), risk)
    return quality_rules.judge(measured, cutoffs, risk).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("passed")).alias("kept"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    written = sharding.write_shards(documents, scratch_path(spark, "shards"), sharding.Shuffle())
    content = F.coalesce("text", F.lit("")).cast("binary")
    return written.select(
        "doc_id",
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # Staged because totals are taken of it before the rows are placed; the texts are read once.
    counted = stage(documents.select("doc_id", "source", count_words("text").alias("n_words")), "counted")
    planned = mixing.schedule(counted, mixing.Mix(), "doc_id", "source", F.col("n_words"))
    return planned.orderBy(F.get("finish", F.lit(0)).asc_nulls_last(), "doc_id").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = classifier.Training()
    model = classifier.train(documents, table(spark, sf_dir, "labels"), training, "doc_id", "text")
    scored = classifier.score(documents, model, training, columns=["doc_id"])
    return scored.select("doc_id", classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = sampled_pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    decoded = sampled_pieces.decode(sampled_pieces.encode(documents, pieces), pieces)
    return decoded.select(
        "doc_id",
        F.size("pieces").alias("n_pieces"),
        "pieces",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("text")
    encoding = token_counts.Encoding(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    # Staged, as the sums run over the histogram twice.
    lengths = stage(token_counts.encoded_lengths(documents, encoding, columns=[]), "lengths")
    return token_counts.histogram(lengths)


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = style_tree.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = chat_format.as_transcripts(table(spark, sf_dir, "conversations"))
    lines = stage(chat_format.lines_of(transcripts, keep=("role",)), "lines")
    model = chat_format.fit(lines.where(F.crc32(F.col("conv").cast("string")) % 5 != 0))
    turns = chat_format.render(chat_format.recover(lines, model))
    return turns.withColumn("conv_id", F.col("conv").cast("long")).drop("conv")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.Manifest()
    rows = merkle.manifest_rows(table(spark, sf_dir, "documents"), manifest, merkle.tampered_text(manifest))
    return merkle.check(rows).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = periods.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.find_runs(documents, periods.Runs(), columns=["doc_id"])
    best = found.withColumn("best", periods.strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periods.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    how = languages.Compression()
    known = languages.learn(documents.where(~languages.held_out("doc_id")), how)
    found = languages.identify(documents, known, how, columns=["doc_id"])
    return found.select("doc_id", languages.held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_style_tree": op6_style_tree,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_syncmers": op8_syncmers,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}
