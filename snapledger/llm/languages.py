"""Language identification by compression.

Every language has a dictionary: raw text of that language, at most ``dictionary_bytes``. A text is
compressed with each of them by zstandard, in slices of ``slice_bytes`` so that the dictionary counts
up to the text's end and not only until the text has taught the compressor its own words. The
language whose dictionary gives the fewest bytes is chosen. How much smaller it is than the next one,
as a share, is the margin; with less than ``least_margin`` the choice is rejected. Texts and
dictionaries are lower-cased and reduced to letters with their marks, all else becoming one space.

Dictionaries are drawn from labelled rows: texts that are equal count once, and those with the
smallest hashes are taken per language until the bytes are full. Bytes are first counted per bit
length of the hash, 63 lines a language, which tells up to which length to read; so no more than
about twice the wanted bytes are ranked, however many rows a language has. Dictionaries travel with
the task and are bounded by languages times ``dictionary_bytes``. Rows are compressed where they are
read; nothing is shuffled.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not accepted, as
is every text if no labelled row has a letter; equally small results go to the language with more
labelled bytes, then to the first name, with score 0; with a single language every choice scores 1;
texts of any length are compressed whole; equal texts have equal results; repeated rows are kept; an
empty table gives an empty one; rows with a null language or text teach nothing; columns of the input
named like a result are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import is_small
from ..session import stage
from .common import modest_batches

FOLDS, TEST_FOLD = 4, 2
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "accepted")
TYPES = T.StructType([T.StructField(n, t) for n, t in zip(RESULTS, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Compression:
    dictionary_bytes: int = 256 << 10
    slice_bytes: int = 2 << 10
    level: int = 3
    least_margin: float = 0.01
    seed: int = 13


def held_out(key: str) -> Column:
    """Whether a row is kept for testing; a row without a key is not."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % FOLDS == TEST_FOLD, F.lit(False))


def letters_of(text: str | None) -> bytes | None:
    """What is compressed of a text; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    low = text.lower()
    if any(unicodedata.combining(c) for c in set(low)):
        low = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in low)
        return " ".join(["", *low.split(), ""]).encode()
    return NOT_LETTERS.sub(" ", f" {low} ").encode()


def draw_texts(labelled: DataFrame, how: Compression, text: str, lang: str) -> DataFrame:
    """(lang, text, hash): distinct texts, by ascending hash as many as fill a dictionary."""
    number = F.xxhash64(F.lit(how.seed), "text").bitwiseAND((1 << 62) - 1)
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")))
    rows = rows.select("lang", "text", number.alias("hash"))
    bits = F.floor(F.log2(F.col("hash") + 1)).cast("int")
    size = F.octet_length("text").cast("long")

    once = rows.groupBy("lang", "hash").agg(F.max(size).alias("size"))
    steps = once.groupBy("lang", bits.alias("bits")).agg(F.sum("size").alias("size"))
    upward = Window.partitionBy("lang").orderBy("bits").rowsBetween(Window.unboundedPreceding, -1)
    needed = steps.withColumn("before", F.coalesce(F.sum("size").over(upward), F.lit(0)))
    last = needed.groupBy("lang").agg(
        F.max(F.when(F.col("before") < how.dictionary_bytes, F.col("bits"))).alias("last"), F.sum("size").alias("known")
    )
    last = stage(last, "dictionary_limits")
    if is_small(last):
        last = F.broadcast(last)
    read = rows.join(last, "lang").where(bits <= F.col("last")).select("lang", "text", "hash", "known").distinct()
    by_hash = Window.partitionBy("lang").orderBy("hash", "text").rowsBetween(Window.unboundedPreceding, -1)
    ranked = read.withColumn("before", F.coalesce(F.sum(size).over(by_hash), F.lit(0)))
    left = (F.lit(how.dictionary_bytes) - F.col("before")).cast("int")
    return ranked.where(left > 0).select("lang", F.left("text", left).alias("text"), "hash", "known")


def learn(
    labelled: DataFrame, how: Compression, text: str = "text", lang: str = "lang"
) -> dict[str, bytes]:
    """A dictionary per language, those with more labelled bytes first."""
    drawn: dict[str, list] = {}
    for row in draw_texts(labelled, how, text, lang).collect():
        drawn.setdefault(row["lang"], []).append(row)
    order = sorted(drawn, key=lambda name: (-drawn[name][0]["known"], name))
    return {
        name: b"\n".join(letters_of(r["text"]) or b"" for r in sorted(drawn[name], key=lambda r: (r["hash"], r["text"])))[
            : how.dictionary_bytes
        ]
        for name in order
    }


def sizes_with(dictionaries: dict[str, bytes], how: Compression):  # noqa: ANN201
    """A function from a text's bytes to its compressed size with each dictionary."""
    import zstandard

    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=how.level)
        return zstandard.ZstdCompressor(level=how.level, dict_data=data, write_content_size=False, write_dict_id=False)

    tools = [compressor(content) for content in dictionaries.values()]

    def sizes(content: bytes) -> list[int]:
        slices = [content[at : at + how.slice_bytes] for at in range(0, len(content), how.slice_bytes)]
        return [sum(len(tool.compress(part)) for part in slices) for tool in tools]

    return sizes


def choose(names: list[str], sizes: list[int], how: Compression) -> tuple[str, float, bool]:
    """Language, margin, and whether the margin is wide enough."""
    best = min(range(len(names)), key=sizes.__getitem__)
    others = [size for i, size in enumerate(sizes) if i != best]
    margin = round(1 - sizes[best] / min(others), 6) if others else 1.0
    return names[best], margin, margin >= how.least_margin


def identify(
    df: DataFrame, dictionaries: dict[str, bytes], how: Compression, text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """``columns`` of ``df``, or all, with ``lang_pred``, ``score`` (the margin) and ``accepted``."""
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in RESULTS]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *TYPES.fields])
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizes_with(dictionaries, how)
        for batch in batches:
            found = []
            for value in batch.column("_text"):
                content = letters_of(value.as_py()) if names else None
                found.append((UNKNOWN, 0.0, False) if content is None else choose(names, sizes(content), how))
            made = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.fieldNames())

    scored = modest_batches(source).mapInArrow(run, schema)
    return scored.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], *RESULTS)
