"""Document fingerprints of closed syncmers over words.

Every run of ``K`` words is looked at by itself: it is chosen if the least hash among its runs of
``S`` words stands at its first or last place. Whether it is chosen depends on nothing around it, so
an edit changes only the anchors that touch it, and the rest keep their order; of ``K - S``
neighbouring runs one at least is chosen. Texts are padded with empty words at both ends, so the
shortest text has an anchor, and its first and last words count as such.

A fingerprint is the anchors' hashes in the order of the text. Likeness is twice the number of
distinct anchors that two fingerprints share, divided by the number in both.

A document meets the next one in a window over blocks of keys. The keys are cut at ``QUANTILES``
approximate quantiles of the rows, and each piece into equal ranges of the key, at most ``MAX_BLOCKS``
in all; so ids far apart or close together move few rows, and no block has more than about a piece.
The first document of the following block is added to each block as its last. Built-in functions only.

Defined results: a null text counts as empty; a text without words has an empty fingerprint, and two
empty ones have likeness 1, one empty and another 0; null keys come first; rows that share a key
follow each other by the hash of their text; a single document is its own next one; an empty table
gives an empty result; other columns of the input are kept unless named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words_of

K = 8
S = 2
HEX = 8
MAX_BLOCKS = 1 << 16
QUANTILES = 256
BLOCK_ROWS = 1024


def anchors(text: Column) -> Column:
    """Hashes of the chosen runs of words, in order."""
    padding = F.array(*[F.lit("")] * (K - 1))
    words = words_of(text)

    def chosen(padded: Column) -> Column:
        runs = F.slice(padded, 1, F.size(padded) - S + 1)
        keys = F.transform(runs, lambda w, i: F.md5(F.concat_ws(" ", w, *[F.get(padded, i + j) for j in range(1, S)])))

        def pick(found: Column) -> Column:
            width = K - S + 1
            starts = F.sequence(F.lit(0), F.size(found) - width)
            edge = lambda i: F.least(F.get(found, i), F.get(found, i + width - 1)) == F.least(
                *[F.get(found, i + j) for j in range(width)]
            )
            name = lambda i: F.substring(F.md5(F.array_join(F.slice(padded, i + 1, K), " ")), 1, HEX)
            return F.transform(F.filter(starts, edge), name)

        return let(keys, pick)

    empty = F.array().cast("array<string>")
    return let(
        words,
        lambda w: F.when(F.size(w) == 0, empty).otherwise(let(F.concat(padding, w, padding), chosen)),
    )


def fingerprint(found: Column) -> Column:
    return F.array_join(found, "")


def names_in(column: str) -> Column:
    """The distinct anchors of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f".{{{HEX}}}"), F.lit(0)))


def likeness(one: Column, two: Column) -> Column:
    """Dice coefficient of two arrays of distinct anchors."""
    total = F.size(one) + F.size(two)
    shared = 2 * F.size(F.array_intersect(one, two))
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def block_of(key: Column, cuts: list[float], blocks: int) -> Column:
    """A block's number, which never falls as the key rises: pieces between cuts, each in equal ranges."""
    taken = sorted({*cuts[:: max(1, len(cuts) // blocks)], cuts[-1]})
    begins = taken[:-1] or taken
    widths = [max(after - before, 1.0) for before, after in zip(begins, taken[1:], strict=True)] if len(taken) > 1 else [1.0]
    ranges = -(-blocks // len(begins))
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
    piece = F.greatest(F.size(F.filter(numbers(begins), lambda b: b <= key)) - 1, F.lit(0))

    def inside(at: Column) -> Column:
        part = F.floor((key - F.get(numbers(begins), at)) / F.get(numbers(widths), at) * ranges)
        return at.cast("long") * ranges + F.greatest(F.least(part, F.lit(ranges - 1)), F.lit(0))

    return let(piece, inside)


def with_next(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Add ``next_<v>`` of the row with the next key; the first row follows the last.

    ``_key`` and ``_tie`` order the rows; both are dropped again.
    """
    number = F.col(f"`{key}`").cast("decimal(20,0)")
    rough = number.cast("double")
    cuts = F.percentile_approx(rough, F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)]), F.lit(40 * QUANTILES))
    stats = df.agg(F.min(number).alias("low"), cuts.alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    low = int(stats["low"] or 0) - 1  # the place of null keys
    ordered = df.withColumn("_key", F.coalesce(number, F.lit(str(low)).cast("decimal(20,0)")))
    blocks = max(1, min(MAX_BLOCKS, stats["n"] // BLOCK_ROWS))
    ordered = ordered.withColumn("_block", block_of(F.col("_key").cast("double"), stats["cuts"] or [0.0], blocks))
    # At most MAX_BLOCKS lines: the first key of every block, and the block before it.
    firsts = ordered.groupBy("_block").agg(F.min("_key").alias("_key"))
    line = Window.orderBy("_block")
    last = F.max("_block").over(Window.partitionBy())
    heads = firsts.select("_key", F.coalesce(F.lag("_block").over(line), last).alias("_before"))
    extra = (
        ordered.drop("_block").join(F.broadcast(heads), "_key").withColumnRenamed("_before", "_block").withColumn("_extra", F.lit(1))
    )
    rows = ordered.withColumn("_extra", F.lit(0)).unionByName(extra)
    order = Window.partitionBy("_block").orderBy("_extra", "_key", "_tie")
    following = F.lead(F.struct(*values)).over(order)
    found = rows.withColumn("_next", following).where("_extra = 0")
    return found.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "_tie"],
        *[F.col("_next")[v].alias(f"next_{v}") for v in values],
    )


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The last quarter of the edited text comes from the next document's beginning.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # Four bytes per anchor move with the text.
    own = df.select(F.col(f"`{key}`").alias("doc_id"), body.alias("body")).select(
        "doc_id", "body", F.unhex(fingerprint(anchors(F.col("body")))).alias("found"), F.xxhash64("body").alias("_tie")
    )
    paired = with_next(own, "doc_id", ["body", "found"])
    size = F.length("body")
    quarter = F.floor(size / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("body"), F.lit(1), size - quarter), F.substring(F.col("next_body"), F.lit(1), quarter)
    )
    staged = paired.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        edited.alias("edited"),
        F.lower(F.hex("found")).alias("fingerprint"),
        F.lower(F.hex("next_found")).alias("next_fingerprint"),
    )
    staged = staged.withColumn("edited_fingerprint", fingerprint(anchors(F.col("edited"))))
    unique = staged.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        names_in("fingerprint").alias("a"),
        names_in("edited_fingerprint").alias("b"),
        names_in("next_fingerprint").alias("c"),
    )
    return unique.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
