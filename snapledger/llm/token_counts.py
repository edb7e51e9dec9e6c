"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Texts are encoded in batches with a public byte-level BPE; only their lengths are kept. Documents are
counted by length, and sums over shorter and longer lengths turn the histogram into totals,
quantiles and truncated totals for any limit. The histogram has at most one line per length, however
many documents there are; the sums run in blocks of lengths.

Defined results: a null or empty text has no tokens; strings that look like special tokens are
ordinary text; repeated rows count each; an empty table gives an empty histogram; a column of the
input named ``n_tokens`` is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, running_sums, without


@dataclass(frozen=True)
class Encoding:
    """A file of ranks, and the pattern that cuts texts before merging."""

    ranks: str
    pattern: str


@lru_cache(maxsize=2)
def load(encoding: Encoding):
    import tiktoken

    with open(encoding.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=encoding.pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(
    df: DataFrame, encoding: Encoding, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """``columns`` of ``df``, or all, with ``n_tokens``."""
    df = without(df, "n_tokens")
    kept = df.columns if columns is None else columns
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(encoding)
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.int64)
            for i, value in enumerate(batch.column(text)):  # one text at a time is a Python string
                found[i] = len(coder.encode_ordinary(value.as_py() or ""))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(found)], names=[*kept, "n_tokens"]
            )

    return modest_batches(df).mapInArrow(run, schema)


def histogram(lengths: DataFrame) -> DataFrame:
    """A line per length with the sums that answer for it as a limit.

    ``docs_longer`` and ``tokens_longer`` are over longer documents, ``docs_shorter`` and
    ``tokens_shorter`` over shorter ones; ``truncated_tokens`` is the total if every document were
    cut to this length.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    longer = running_sums(counts, "n_tokens", ["docs", "tokens"], descending=True)
    longer = longer.withColumnsRenamed({"before_docs": "docs_longer", "before_tokens": "tokens_longer"})
    both = running_sums(longer, "n_tokens", ["docs", "tokens"])
    both = both.withColumnsRenamed({"before_docs": "docs_shorter", "before_tokens": "tokens_shorter"})
    cut = F.col("tokens_shorter") + F.col("n_tokens") * (F.col("docs") + F.col("docs_longer"))
    return both.withColumn("truncated_tokens", cut)


def truncated_total(lines: DataFrame, limit: int) -> Column:
    """Aggregate over a histogram: all tokens if documents are cut to ``limit``."""
    return F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit)))


def quantile(lines: DataFrame, part: float) -> DataFrame:
    """The smallest length that at least ``part`` of the documents don't exceed."""
    total = F.col("docs_shorter") + F.col("docs") + F.col("docs_longer")
    reached = F.col("docs_shorter") + F.col("docs") >= F.lit(part) * total
    return lines.where(reached).agg(F.min("n_tokens").alias("n_tokens"))
