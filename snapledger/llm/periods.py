"""Runs of periodic text, found as maximal pairs in the tree of LCP intervals.

A run is a stretch of consecutive words that a period runs through at least ``min_exponent`` times and
that neither neighbour prolongs. Two places i < j of one text are a maximal pair if the words from i
and from j on agree for ``lcp`` words, the next ones differ, and so do the words before i and j. Then
the words from i to j + lcp are a stretch with period j - i that cannot be prolonged. So the maximal
pairs with ``min_exponent * distance <= distance + lcp`` are the runs, each once for its smallest
period and once per multiple of it that still fits; the smallest distance of a stretch is kept.

Pairs come from the suffixes of a text, ordered by doubling, and the longest common prefixes of
neighbours. The intervals of that list form a tree that is walked bottom-up with a stack. An interval
holds its places in order, and once more in lists by the word before them. Putting a child into its
interval, each place of the smaller side looks for places of the other side within reach, in the
lists of other words than its own. Within half of what two places share, occurrences repeat at one
distance, so all but the first have the same word before them, and two lists at most are asked. The
smaller side is always the one put in, so a text costs n log n steps and what it returns.

A run's places agree for at least ``least_shared`` words. Texts no such stretch of which repeats (by
hashes, a collision costs time only) are done; of the others only places whose stretch repeats enter
the tree. Texts are independent and are treated where they are read: nothing is shuffled.

Defined results: a null, empty or blank text has no words and no runs; one word repeated is one run;
texts of any length are searched whole, a batch being cut into parts of about ``PART_WORDS`` words,
texts whole; rows that repeat have equal results, a row each; an empty table gives an empty one;
columns of the input named like a result are replaced, others are kept whatever they hold.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, let, modest_batches, words_of

PART_WORDS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd; spreads the hashes of neighbouring words
MIX_SHIFT = np.uint64(29)
FIELDS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)
RESULTS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("runs", FIELDS), T.StructField("collapsed", T.StringType())]
)


@dataclass(frozen=True)
class Runs:
    """Shortest run in words, and how often its period must fit (3 at least)."""

    min_length: int = 24
    min_exponent: int = 3

    def __post_init__(self) -> None:
        if self.min_exponent < 3:
            raise ValueError("a run repeats three times at least")

    def least_shared(self) -> int:
        """Words that the two places of any run's pair agree for at least."""
        times = self.min_exponent - 1
        return min(max(self.min_length - q, times * q) for q in range(1, max(2, self.min_length + 1)))


def repeating_texts(ids: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which some ``width`` consecutive words come twice."""
    size = len(ids)
    hashes = (ids.astype(np.uint64) + np.uint64(1)) * STEP
    hashes ^= hashes >> MIX_SHIFT
    total, have = np.zeros(size, np.uint64), 0
    power, span = hashes, 1
    # Hash of ``width`` words from those of 1, 2, 4, ... words.
    while span <= width:
        if width & span:
            total = total * STEP + np.append(power[have:], np.zeros(min(have, size), np.uint64))
            have += span
        shifted = np.append(power[span:], np.zeros(min(span, size), np.uint64))
        power = (power * STEP + shifted) * STEP
        power ^= power >> MIX_SHIFT
        span *= 2
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    full = np.arange(size) + width <= bounds[1:][owner]
    total = (total ^ (owner.astype(np.uint64) * STEP))[full]
    owner = owner[full]
    order = np.argsort(total)
    twice = np.flatnonzero(total[order][1:] == total[order][:-1])
    return np.unique(owner[order[twice]])


def suffix_ranks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For 1, 2, 4, ... words: a number per place that is equal where these words are, and ordered as they are.

    The last one orders all suffixes. Places whose words are found nowhere else keep their number.
    """
    size = len(ids)
    order = np.argsort(ids, kind="stable")
    firsts = np.append(True, ids[order][1:] != ids[order][:-1])
    starts = np.flatnonzero(firsts)
    rank = np.zeros(size + 1, np.int64)
    rank[order] = starts[np.cumsum(firsts) - 1]
    rank[size] = -1
    found, span = [rank[:-1].astype(np.int32)], 1
    while span < longest:
        counts = np.bincount(rank[:-1], minlength=size)
        alive = np.flatnonzero(counts[rank[:-1]] > 1)
        if not len(alive):
            break
        own = rank[alive]
        keys = own * (size + 2) + rank[np.minimum(alive + span, size)] + 1
        order = np.argsort(keys, kind="stable")
        keys, own, places = keys[order], own[order], alive[order]
        at = np.arange(len(keys))
        group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), at, 0))
        part = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), at, 0))
        rank = rank.copy()
        rank[places] = own + part - group
        found.append(rank[:-1].astype(np.int32))
        span *= 2
    return found


def shared_words(ranks: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For how many words the suffixes of two lists of places agree."""
    size = len(ranks[0])
    length = np.zeros(len(one), np.int64)
    for level in reversed(range(len(ranks))):
        a, b = one + length, two + length
        inside = (a < size) & (b < size)
        same = inside & (ranks[level][np.minimum(a, size - 1)] == ranks[level][np.minimum(b, size - 1)])
        length += same.astype(np.int64) << level
    return length


def put_in(held: list[int], more: list[int]) -> None:
    """Add places to an ordered list."""
    if len(more) * 8 > len(held):
        held.extend(more)
        held.sort()
    else:
        for place in more:
            insort(held, place)


def maximal_pairs(places: list[int], shared: list[int], before: list[int], runs: Runs, found: dict) -> None:
    """Walk the intervals of one stretch of the suffix list; ``found`` gets (start, length) -> period.

    ``shared[k]`` is what ``places[k]`` and the next one have in common, 0 after the last.
    """
    times, shortest = runs.min_exponent - 1, runs.min_length

    def put_together(one: tuple, two: tuple, lcp: int) -> tuple:
        (held, lists), (few, few_lists) = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
        reach = lcp // times
        for x in few:
            low, high = bisect_left(held, x - reach), bisect_right(held, x + reach)
            if low == high:
                continue
            own = before[x]
            for word in {before[held[low]], before[held[high - 1]]}:
                if word == own:
                    continue
                others = lists[word]
                for y in others[bisect_left(others, x - reach) : bisect_right(others, x + reach)]:
                    period = abs(x - y)
                    if lcp + period >= shortest:
                        stretch = (min(x, y), lcp + period)
                        found[stretch] = min(period, found.get(stretch, period))
        put_in(held, few)
        for word, some in few_lists.items():
            put_in(lists.setdefault(word, []), some)
        return held, lists

    stack: list[list] = []
    for place, below in zip(places, shared, strict=True):
        node = ([place], {before[place]: [place]})
        while stack and stack[-1][0] > below:
            lcp, held = stack.pop()
            node = put_together(held, node, lcp)
        if stack and stack[-1][0] == below:
            stack[-1][1] = put_together(stack[-1][1], node, below)
        elif below:
            stack.append([below, node])


def runs_of(ids: np.ndarray, bounds: np.ndarray, runs: Runs) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of the texts that have any, ordered by start and period.

    ``ids`` are the words of all texts, equal where the words are, one text after the other.
    """
    least = runs.least_shared()
    chosen = repeating_texts(ids, bounds, least) if len(ids) else ids
    if not len(chosen):
        return {}
    # Texts that may have runs, each with a mark of its own behind it, which no word equals.
    top = int(ids.max()) + 1
    parts = [np.append(ids[bounds[t] : bounds[t + 1]], top + k) for k, t in enumerate(chosen)]
    sizes = np.array([len(p) for p in parts])
    starts = np.append(0, np.cumsum(sizes))
    joined = np.concatenate(parts)
    ranks = suffix_ranks(joined, int(sizes.max()))

    # Neighbours in suffix order that agree long enough; the rest cannot be a pair of any run.
    level = min(len(ranks), least.bit_length()) - 1
    counts = np.bincount(ranks[level], minlength=len(joined))
    places = np.flatnonzero(counts[ranks[level]] > 1)
    places = places[np.argsort(ranks[-1][places], kind="stable")]
    shared = np.append(shared_words(ranks, places[:-1], places[1:]), 0)
    shared[shared < least] = 0
    group = np.cumsum(np.append(0, shared[:-1] == 0))

    # Stretches of the list without two places within reach of each other are left out.
    by_place = np.lexsort((places, group))
    gaps = np.diff(places[by_place])
    gaps[np.diff(group[by_place]) != 0] = len(joined)
    edges = np.flatnonzero(np.append(True, np.diff(group) != 0))
    nearest = np.minimum.reduceat(np.append(gaps, len(joined)), edges)
    longest = np.maximum.reduceat(shared, edges)
    worth = np.flatnonzero(nearest * (runs.min_exponent - 1) <= longest)
    ends = np.append(edges[1:], len(places))

    before = np.append(-1, joined[:-1])
    before[starts[:-1]] = -1
    before_list = before.tolist()
    found: dict[tuple[int, int], int] = {}
    for g in worth.tolist():
        cut = slice(edges[g], ends[g])
        maximal_pairs(places[cut].tolist(), shared[cut].tolist(), before_list, runs, found)

    result: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), period in sorted(found.items(), key=lambda f: (f[0][0], f[1])):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        result.setdefault(int(chosen[k]), []).append((start - int(starts[k]), length, period))
    return result


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without what a run repeats after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, over in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not over]


def parts_of(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The words of texts, in parts of about ``PART_WORDS`` words."""
    pattern, part, size = re.compile(WORD), [], 0
    for text in texts:
        words = pattern.findall(text or "")
        part.append(words)
        size += len(words)
        if size >= PART_WORDS:
            yield part
            part, size = [], 0
    yield part


def search(texts: list[str | None], runs: Runs) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs, and collapsed text of every text."""
    for part in parts_of(texts):
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for words in part for w in words], dtype=np.int64)
        bounds = np.cumsum([0, *[len(words) for words in part]])
        found = runs_of(ids, bounds, runs)
        for number, words in enumerate(part):
            held = found.get(number, [])
            yield len(words), held, " ".join(collapse(words, held) if held else words)


def find_runs(df: DataFrame, runs: Runs, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df``, or all, with ``n_words``, ``runs`` and ``collapsed``."""
    names = [f.name for f in RESULTS.fields]
    read = F.col(f"`{text}`")
    kept = [c for c in (df.columns if columns is None else columns) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], read.alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *RESULTS.fields])
    types = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(search(batch.column("_text").to_pylist(), runs))
            numbers, lists, texts = ([r[i] for r in rows] for i in range(3))
            lists = [[dict(zip(("start", "length", "period"), f, strict=True)) for f in held] for held in lists]
            made = [pa.array(v, t) for v, t in zip((numbers, lists, texts), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.fieldNames())

    searched = modest_batches(source).mapInArrow(run, schema)
    return searched.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], *names)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of equal ones the first."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def with_planted_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one text in ten, by the checksum of its key, made periodic from some word on.

    Rows without a key keep their text.
    """
    check = F.crc32(F.col(f"`{key}`").cast("string"))
    turn = F.floor(check / 10).cast("long")

    def periodic(words: Column) -> Column:
        count = F.size(words)
        first = (turn % count).cast("int")
        period = F.lit(1) + F.floor((count - first) / (F.lit(3) + turn % 8)).cast("int")
        source = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        return F.array_join(F.transform(words, lambda _, i: F.get(words, source(i))), " ")

    chosen = F.coalesce(check % 10 == 0, F.lit(False)) & F.regexp_like(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD))
    planted = F.when(chosen, let(words_of(F.col(f"`{text}`")), periodic)).otherwise(F.col(f"`{text}`"))
    return df.withColumn(text, planted)
