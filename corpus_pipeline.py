"""From raw documents to a mixed and encoded corpus, in stages that are written and read again.

Every stage gets what the one before it kept and returns the columns of documents; the last one adds
the pieces. SQL can express neither the trained classifier nor the sampled pieces, so there is none;
the tests compare the stages with plain versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import classifier, mixing, ngram_join, quality_rules, sampled_pieces
from snapledger.llm.common import count_words, table
from snapledger.llm.queries import vocabulary
from snapledger.session import stage


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a certified cutoff, or the limit on repeated words, rejects go.

    The base rule on length is left out, as short documents may be clean.
    """
    risk = quality_rules.Risk()
    measured = stage(quality_rules.measure(docs), "measured")
    cutoffs = quality_rules.find_cutoffs(measured, table(spark, sf_dir, "labels"), risk)
    repeats = 100 * F.col("n_repeat_words") > quality_rules.BASE_REPEAT_PERCENT * F.col("n_words")
    return quality_rules.judge(measured, cutoffs, risk).where(F.col("passed") & ~repeats).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on labelled raw documents."""
    training = classifier.Training()
    raw = table(spark, sf_dir, "documents")
    model = classifier.train(raw, table(spark, sf_dir, "labels"), training, "doc_id", "text")
    return classifier.score(docs, model, training).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays, that of the smallest number."""
    return ngram_join.one_of_each(docs, ngram_join.Join())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order, a row per copy of a document."""
    return mixing.mix_rows(docs, mixing.Mix(), "doc_id", "source", count_words("text")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, and whether these decode to the text."""
    pieces = sampled_pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    decoded = sampled_pieces.decode(sampled_pieces.encode(docs, pieces), pieces)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("pieces").alias("n_pieces"),
        "pieces",
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", drop_junk),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sampled pieces", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
