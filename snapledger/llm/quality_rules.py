"""Quality rules with risk-controlled cutoffs.

Each rule is a share in thousandths that is high for junk. Labelled documents are the holdout: for
every stratum and rule the cutoffs of a fixed ladder are tested from the mildest on, and a cutoff
stands as long as the exact binomial tail shows that the rule wrongly rejects no more than its part
of ``max_false_rejection`` of the good documents. The error level is divided among all strata and
rules (Bonferroni); within a ladder the fixed order needs no further division. With probability
``1 - error`` every stratum therefore loses at most ``max_false_rejection`` of its good documents.
A rule without a certified cutoff rejects nothing.

Everything runs as built-in DataFrame functions. Only counts by stratum, rule and cutoff are
gathered, and the table of cutoffs has one line per named stratum, so it may be broadcast.

Defined results: a null text counts as empty; a null or unnamed language belongs to the stratum
``other``; labels without a document, repeated labels and null labels are left out (a document that
is labelled more than once counts as good only if all its labels say so); repeated documents are
judged alike, and weigh as often as they occur; an empty table gives an empty result; columns of
the input that carry a name of the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, spare, without, words_of

BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50

# Symbols of the base counts, and the ladder of cutoffs in thousandths.
SYMBOLS = "#*$%&|<>"
LADDER = (700, 600, 500, 400, 350, 300, 250, 200, 175, 150, 125, 100, 80, 60, 50, 40, 30)
OTHER = "other"


@dataclass(frozen=True)
class Risk:
    """What the cutoffs guarantee, and for which strata."""

    max_false_rejection: float = 0.02
    error: float = 0.05
    strata: tuple[str, ...] = ("de", "en", "es", "fr")
    ladder: tuple[int, ...] = field(default=LADDER)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by hash with their place; those equal to a neighbour are repeats. Their
    sorted places give the words they cover, each counted once.
    """
    windows = F.transform(
        words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pair = lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
        repeats = let(placed, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), pair))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(repeats, lambda x: x.isNotNull()))))
        gaps = let(
            places, lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3), y - x))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.coalesce(gap, F.lit(3)))

    def distinct_or_covered(hashes: Column) -> Column:
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0)).otherwise(covered(hashes))

    whole = F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(whole, distinct_or_covered).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts, ``base_failed`` and the measures of the rules to every document."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    body, words, lines = spare(df, "body"), spare(df, "words"), spare(df, "lines")
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = without(df, *added, "n_lines", "n_shouts").columns
    has_word = lambda x: F.trim(x, F.lit(BLANKS)) != ""
    counted = (
        df.withColumn(body, source)
        .withColumn(words, words_of(body))
        .withColumn(lines, F.filter(F.split(F.col(body), "\n"), has_word))
        .select(
            *[F.col(f"`{c}`") for c in kept],
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
            F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(words)).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.regexp_count(body, F.lit("!")).cast("long").alias("n_shouts"),
        )
    )
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def share(part: str, whole: str) -> Column:
    """Thousandths of ``part`` in ``whole``, rounded down; 0 of nothing."""
    return F.coalesce(F.expr(f"(1000 * `{part}`) div nullif(`{whole}`, 0)"), F.lit(0)).cast("long")


RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "shouts": ("n_shouts", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def stratum_of(lang: str, risk: Risk) -> Column:
    known = F.col(f"`{lang}`").isin(*risk.strata)
    return F.when(F.coalesce(known, F.lit(False)), F.col(f"`{lang}`")).otherwise(F.lit(OTHER))


def binomial_tail(wrong: Column, total: Column, rate: float) -> Column:
    """P(Binomial(total, rate) <= wrong), summed in logarithms term by term."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = total * F.log(F.lit(1 - rate))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((total - i + 1) / i) + odds
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(wrong > 0, F.sequence(F.lit(1).cast("long"), wrong)).otherwise(
        F.array().cast("array<long>")
    )
    return F.exp(F.aggregate(steps, start, add, lambda acc: acc["sum"]))


def find_cutoffs(
    measured: DataFrame, labels: DataFrame, risk: Risk, key: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """One line per stratum: the certified cutoff of every rule, null where there is none.

    ``measured`` comes from ``measure``; ``labels`` has ``doc_id`` and ``quality``. Good documents
    that pass the base rules are the holdout.
    """
    good = (
        labels.where(F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias(key))
        .agg(F.min("quality").alias("_good"))
        .where("_good = 1")
    )
    names = list(RULES)
    held = (
        measured.where(~F.col("base_failed"))
        .select(
            F.col(f"`{key}`").alias(key),
            stratum_of(lang, risk).alias("stratum"),
            *[share(*RULES[r]).alias(f"r_{r}") for r in names],
        )
        .join(good, key, "left_semi")
    )
    over = [
        F.count(F.when(F.col(f"r_{r}") > c, 1)).alias(f"{r}_{c}") for r in names for c in risk.ladder
    ]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("total"), *over)
    rate = risk.max_false_rejection / len(names)
    level = risk.error / (len(names) * (len(risk.strata) + 1))

    tests = counts.select(
        "stratum",
        "total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("rule"),
                        F.lit(step).alias("step"),
                        F.lit(c).cast("long").alias("cutoff"),
                        F.col(f"{r}_{c}").alias("wrong"),
                    )
                    for r in names
                    for step, c in enumerate(risk.ladder)
                ]
            )
        ).alias("t"),
    ).select("stratum", "total", "t.*")
    # Beyond the allowed rate the tail cannot be small, so its sum is not needed.
    passed = F.when(
        F.col("wrong") <= rate * F.col("total"),
        binomial_tail(F.col("wrong"), F.col("total"), rate) <= level,
    ).otherwise(F.lit(False))
    tested = tests.withColumn("passed", passed)
    # At most strata x rules x ladder lines from here on.
    first_failed = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("failed")
    )
    standing = tested.join(F.broadcast(first_failed), ["stratum", "rule"]).where(
        F.col("failed").isNull() | (F.col("step") < F.col("failed"))
    )
    return standing.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in names]
    )


def judge(
    measured: DataFrame, cutoffs: DataFrame, risk: Risk, lang: str = "lang"
) -> DataFrame:
    """Add ``passed``: no rule of the document's stratum exceeds its certified cutoff."""
    stratum = spare(measured, "stratum")
    cuts = cutoffs.withColumnRenamed("stratum", stratum)
    names = [f"cut_{r}" for r in RULES]
    over = F.lit(False)
    for rule, parts in RULES.items():
        over = over | F.coalesce(share(*parts) > F.col(f"cut_{rule}"), F.lit(False))
    return (
        without(measured, "passed", *names)
        .withColumn(stratum, stratum_of(lang, risk))
        .join(F.broadcast(cuts), stratum, "left")
        .withColumn("passed", ~over)
        .drop(stratum, *names)
    )
