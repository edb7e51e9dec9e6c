"""Quality classifier over learned subword embeddings.

Words, word pairs and byte 4-grams are hashed into buckets, each with a learned vector. A document
is the sum of the three means of its vectors; a linear layer and a softmax give the class
probabilities. A pair of equal words falls into one bucket of its own whatever the word. Vectors and
layer are trained by stochastic gradient descent in numpy, on at most ``train_rows`` labelled
documents with the smallest hashes, which bounds memory and time of the one task that trains.

Scoring runs over all rows in batches. As the layer is linear, every vector is first multiplied
into one number, so a document costs a lookup per feature; the model that tasks receive has a fixed
size of three small tables.

Defined results: a null, empty or blank text gets the score of the bias alone; without labels of
both classes the score is the smoothed share of good labels; null labels and labels without a
document don't count, a document with several labels counts as good if all say so; equal texts have
equal scores; a row without a key is not held out; rows that repeat are scored alike; an empty table gives an empty result; columns of
the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, without
from .shingles import ODD, STEP, U, hash_words, mix64, text_parts

FOLDS = 5
THRESHOLD = 0.3
GROUPS = 3  # words, word pairs, byte 4-grams


@dataclass(frozen=True)
class Training:
    train_rows: int = 6000
    steps: int = 30000
    buckets_bits: int = 16
    dim: int = 8
    rate: float = 0.5
    seed: int = 5


def held_out(key: str) -> Column:
    """Whether a row is kept for testing; a row without a key is not."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % FOLDS == 0, F.lit(False))


def feature_ids(data: np.ndarray, bounds: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every feature and bounds per text, for words, word pairs and byte 4-grams."""
    shift = U(64 - bits)
    words, before = hash_words(data, bounds)
    ids = (words >> shift).astype(np.int32)
    pairs = mix64(words[1:] * STEP + words[:-1])
    pairs[words[1:] == words[:-1]] = 0
    pair_ids = np.append((pairs >> shift).astype(np.int32), np.int32(0))
    pair_ends = np.maximum(before[1:] - 1, before[:-1])
    size = len(data)
    if size >= 4:
        wide = data.astype(np.uint64)
        grams = wide[:-3] | (wide[1:-2] << U(8)) | (wide[2:-1] << U(16)) | (wide[3:] << U(24))
        gram_ids = ((grams + U(1)) * ODD >> shift).astype(np.int32)
    else:
        gram_ids = np.zeros(0, np.int32)
    gram_ends = np.maximum(bounds[1:] - 3, bounds[:-1])
    return [
        (ids, np.stack([before[:-1], before[1:]])),
        (pair_ids, np.stack([before[:-1], pair_ends])),
        (gram_ids, np.stack([bounds[:-1], gram_ends])),
    ]


def segment_means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of ``values`` between each pair of bounds; 0 of nothing."""
    begin, end = bounds
    sizes = end - begin
    full = np.flatnonzero(sizes > 0)
    means = np.zeros(len(begin))
    if len(full):
        # Every second sum is of what lies between two texts.
        edges = np.stack([begin[full], end[full]], axis=1).ravel()
        padded = np.append(values, 0.0)
        sums = np.add.reduceat(padded, edges)[::2]
        means[full] = sums / sizes[full]
    return means


def texts_of(column: pa.Array, bits: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Per text and group: distinct buckets and their parts of the mean."""
    for data, bounds, _ in text_parts(column):
        groups = feature_ids(data, bounds, bits)
        for row in range(len(bounds) - 1):
            found = []
            for ids, (begin, end) in groups:
                part, counts = np.unique(ids[begin[row] : end[row]], return_counts=True)
                found.append((part, counts / max(1, counts.sum())))
            yield found


def fit(texts: list, good: np.ndarray, training: Training) -> tuple[np.ndarray, float]:
    """One number per group and bucket, and the bias, of the log odds of a good text."""
    buckets = 1 << training.buckets_bits
    rng = np.random.default_rng(training.seed)
    if not len(good) or good.min() == good.max():
        share = (good.sum() + 1) / (len(good) + 2)
        return np.zeros((GROUPS, buckets)), float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / training.dim, 1 / training.dim, (GROUPS, buckets, training.dim))
    layer, bias = np.zeros((2, training.dim)), np.zeros(2)
    order = np.zeros(0, dtype=np.int64)
    for step in range(training.steps):
        if step % len(good) == 0:
            order = rng.permutation(len(good))
        row = order[step % len(good)]
        rate = training.rate * (1 - step / training.steps)
        hidden = np.zeros(training.dim)
        for group, (ids, parts) in enumerate(texts[row]):
            hidden += parts @ vectors[group, ids]
        scores = layer @ hidden + bias
        chance = np.exp(scores - scores.max())
        chance /= chance.sum()
        chance[good[row]] -= 1
        back = chance @ layer
        layer -= rate * np.outer(chance, hidden)
        bias -= rate * 0.1 * chance
        for group, (ids, parts) in enumerate(texts[row]):
            vectors[group, ids] -= rate * parts[:, None] * back
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, training: Training, key: str, text: str) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out fold; returns the folded model."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
        .where(~held_out("doc_id"))
    )
    chosen = known.orderBy(F.xxhash64(F.lit(training.seed), "doc_id"), "doc_id").limit(training.train_rows)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    # At most train_rows lines, whatever the data.
    rows = source.join(F.broadcast(chosen), "doc_id").select(F.lit(1).alias("_one"), "doc_id", "_text", "good")

    def run(part: pa.Table) -> pa.Table:
        # The rows' order must not depend on how they arrived; a repeated document counts once.
        part = part.sort_by([("doc_id", "ascending"), ("_text", "ascending")])
        ids = part["doc_id"].to_numpy()
        part = part.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))
        texts = list(texts_of(part["_text"], training.buckets_bits))
        numbers, bias = fit(texts, (part["good"].to_numpy() != 0).astype(np.int64), training)
        return pa.table({"model": pa.array([numbers.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([bias])})

    fitted = rows.groupBy("_one").applyInArrow(run, "model binary, bias double").collect()
    if not fitted:
        return fit([], np.zeros(0, np.int64), training)
    numbers = np.frombuffer(fitted[0]["model"], dtype=np.float32).reshape(GROUPS, -1)
    return numbers.astype(np.float64), fitted[0]["bias"]


def score(
    df: DataFrame,
    model: tuple[np.ndarray, float],
    training: Training,
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``df``, or all, with ``score``, the probability of a good text, and ``predicted``."""
    numbers, bias = model[0].astype(np.float32), model[1]
    df = without(df, "score", "predicted")
    kept = df.columns if columns is None else columns
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for data, bounds, _ in text_parts(batch.column(text)):
                total = np.full(len(bounds) - 1, bias)
                for group, (ids, ends) in enumerate(feature_ids(data, bounds, training.buckets_bits)):
                    total += segment_means(numbers[group][ids].astype(np.float64), ends)
                found.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            scores = pa.array(np.round(np.concatenate(found), 6))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], names=[*kept, "score"])

    scored = modest_batches(df).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
