"""N-gram Jaccard self-join by parity sketches.

A document's set of word shingles is folded into a bit sketch: a shingle flips one bit, so two
sketches differ in at most as many bits as the sets have shingles that only one of them holds. Sets
that reach the wanted similarity differ in at most D shingles, D following from their sizes. Sizes
are cut into bands. A band's sketch has D + 1 words; with at most D differing bits, one word at
least is equal in both (pigeonhole), and going round the words there is such a place whose next
word differs in one bit at most, and the two next ones in two. Words are sparse and very wide, so
they are kept as the XOR of a hash per set bit, and as a short form of 8 parity bits. A document puts
the words of its own band, and of the band above if partners may lie there, into one shuffle, keyed
by band, place and word, with the short forms of the next six words. Going round the words there is
also a place after which the first t words differ in t bits at most, for every t; so equal keys whose
next words' short forms differ in one, two, ... six bits at most are candidates, and their sets are
compared. Of unrelated sets one pair in tens of millions passes that. Sets that are somewhat alike pass
more often, so every set has one more sketch, of the whole, some bits per shingle by which it may differ
from a similar one. The distance of these is part of the last join's condition, and many pairs of earlier
turns are joined to them as well. So next to no sets are shipped in vain.

Words without a shingle are common to many unrelated sets. Their key also holds the next word,
once as it is and once without each of its shingles; since next words differ in one shingle at
most, a pair still meets. Where what is left of the next word is as poor, the word after it joins
in the same way, without up to two.

Equal sets form a class by a 128-bit signature and are compared once. At first a class is compared
only to the class that comes first in most of its keys, which ties groups of near copies together in
as many comparisons as there are classes. After components are found, keys whose classes fall
into several components are taken up again. Those of few sets are done at once with every pair of
different components; the others star by star with changing centres as long as that finds links, at
last with every such pair as well. A pair above the similarity therefore always
ends up in one component, and no bucket, group or list of partners is cut. Keys of many sets are cut
into groups by the first of their short forms, which in a pair differs in one bit at most, and these
into parts that are paired with each other, so that no task holds a whole key.

Links themselves, pairs of classes and their number per row, are of another size than components:
``find_links`` and ``count_links`` compare every pair of classes that share a key.

Keys that a few hundred sets share are read apart by these short forms at once, so sets that
have only a common passage don't stay together to the next turns.

Memory: keys are read in sorted order; a few hundred lines of the current group are held, or its first one. Sets of
candidates are shuffled in pairs; those of at most ``ONE_TASK`` pairs are compared in one task. Nothing is gathered on the driver but counts.

Defined results: a null or blank text has no shingles, is its own component, and has size 0; a text
with fewer words than the width is one shingle; equal texts share a component; repeated rows and
repeated keys are rows of their own; a null key is ignored as a name of a component, which is null
only if all its keys are; an empty table gives an empty result; columns of the input named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import is_small
from ..session import stage
from .common import few_lines, modest_batches, without
from .components import stars
from .shingles import ODD, STEP, U, mix64, ranges, shingle_parts, signatures

SEEN_SETS = 1 << 18
STAR_ROUNDS = 2
PAIRS_PER_ROW = 16
KEY_SETS = 1000
NEAR_SETS = 256  # lines of a key that are compared with each other where keys are read
PART_LINES = 1 << 14
ONE_TASK = 20_000
SKETCH_WIDTH = 16  # bits of a whole set's sketch per shingle by which similar sets may differ
SKETCH_WORDS = 32  # 64-bit words of a sketch that goes with every key of its set
# Bits of a word's short form, how many words' forms go with a key, and how many of them inside the key.
FORM = 8
NEXT_WORDS = 6
INSIDE = U((1 << 2 * FORM) - 1)


@dataclass(frozen=True)
class Join:
    """Shingle width in words, similarity in hundredths, and how far a band's sizes reach."""

    width: int = 5
    percent: int = 80
    reach: float = 1.6

    def starts(self) -> list[int]:
        """First size of every band, up to sizes no text reaches."""
        found = [1]
        while found[-1] < 1 << 40:
            found.append(max(found[-1] + 1, int(found[-1] * self.reach)))
        return found

    def words(self, band: int, starts: list[int]) -> int:
        """One more than the shingles by which two sets may differ, the larger being in the band."""
        largest = starts[band + 1] - 1
        return (100 - self.percent) * 2 * largest // (100 + self.percent) + 1


    def may_differ(self, sizes: int) -> int:
        """By how many shingles two similar sets differ at most, given both sizes together."""
        return (100 - self.percent) * sizes // (100 + self.percent)


def whole_sketch(values: np.ndarray, join: Join) -> np.ndarray:
    """Parity sketch of a whole set in 64-bit words, wide enough that few of its differences cancel out.

    Widths are powers of two, so a sketch folds to the next smaller width by the XOR of its halves.
    """
    bits = 1 << max(6, (SKETCH_WIDTH * join.may_differ(2 * len(values))).bit_length())
    places = (mix64(values ^ STEP) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def digests(join: Join, keep: tuple[str, ...] = ("_key",)):
    """Task function: per row the columns to ``keep``, its shingle count, signature and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sketches = [], []
            for v, b in shingle_parts(batch.column("_text"), join.width):
                numbers.append((np.diff(b), *signatures(v, b)))
                ends = b.tolist()
                sketches += [whole_sketch(v[i:j], join) if j > i else None for i, j in zip(ends, ends[1:], strict=False)]
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*numbers, strict=True)]
            if columns:
                kept = [batch.column(c) for c in keep]
                columns.append(pa.array(sketches, pa.list_(pa.int64())))
                yield pa.record_batch([*kept, *columns], names=[*keep, "n_shingles", "sig", "sig2", "sketch"])

    return run


DIGEST = "n_shingles long, sig long, sig2 long, sketch array<bigint>"


def deleted(tokens: np.ndarray, errors: int) -> np.ndarray:
    """XOR of the tokens without any ``errors`` of them or fewer."""
    whole = np.bitwise_xor.reduce(tokens) if len(tokens) else U(0)
    gone = [out for n in range(min(errors, len(tokens)) + 1) for out in combinations(tokens.tolist(), n)]
    left = [whole ^ np.bitwise_xor.reduce(np.array(out, dtype=np.uint64)) if out else whole for out in gone]
    return np.array(left, dtype=np.uint64)


def sketch_keys(
    values: np.ndarray, bounds: np.ndarray, bands: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of many sketches at once, the short forms of the words after each, and whose they are.

    The next word's form has the lowest bits, the one after that the bits above. Sketch ``i`` holds the shingles between bounds ``i`` and ``i + 1`` in ``counts[i]`` words.
    """
    sizes = np.diff(bounds)
    base = np.cumsum(counts) - counts
    at = ((values >> U(32)) % np.repeat(counts.astype(np.uint64), sizes)).astype(np.int64) + np.repeat(base, sizes)
    total = int(counts.sum())
    order = np.argsort(at)
    tokens, held = mix64(values[order]), np.bincount(at, minlength=total)
    begin = np.cumsum(held) - held
    full = np.flatnonzero(held)
    words, parity = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)
    words[full] = np.bitwise_xor.reduceat(tokens, begin[full])
    parity[full] = np.bitwise_xor.reduceat(U(1) << (tokens & U(FORM - 1)), begin[full])
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(total) - base[owner]
    place = bands[owner].astype(np.uint64) * STEP + inside.astype(np.uint64) * ODD
    keys = mix64(words ^ mix64(place))
    after = np.where(inside + 1 < counts[owner], np.arange(total) + 1, base[owner])
    alone = counts[owner] == 1
    near, step = np.zeros(total, dtype=np.uint64), after
    for word in range(NEXT_WORDS):
        near |= np.where(counts[owner] > word + 1, parity[step], U(0)) << U(FORM * word)
        step = after[step]
    weak = np.flatnonzero((held == 0) & ~alone)
    if not len(weak):
        return keys, near, owner
    # The next word as it is, then without one of its shingles each.
    following = after[weak]
    many = held[following]
    source = np.repeat(np.arange(len(weak)), many)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
    forms = np.concatenate([words[following], words[following][source] ^ tokens[begin[following][source] + nth]])
    left = np.concatenate([many, many[source] - 1])
    source = np.concatenate([np.arange(len(weak)), source])
    long, whose = mix64(keys[weak][source] ^ mix64(forms + ODD)), weak[source]
    thin = np.flatnonzero((left == 0) & (counts[owner[whose]] > 2))
    more, more_whose = [], []
    for t in thin.tolist():  # rare: the word after the next joins the key as well
        j = int(after[after[whose[t]]])
        far = deleted(tokens[begin[j] : begin[j] + held[j]], 2)
        more.append(mix64(long[t] ^ mix64(far + STEP)))
        more_whose.append(np.full(len(far), whose[t]))
    strong = np.ones(len(long), dtype=bool)
    strong[thin] = False
    firm = (held > 0) | alone
    from_ = np.concatenate([np.flatnonzero(firm), whose[strong], *more_whose])
    return np.concatenate([keys[firm], long[strong], *more]), near[from_], owner[from_]


def key_rows(join: Join):
    """Task function: a row per key of every distinct set.

    The key's last 16 bits are the short forms of the next two words, ``far`` are those of the others.
    """
    starts = np.array(join.starts())
    words = np.array([join.words(b, starts.tolist()) for b in range(len(starts) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for values, bounds in shingle_parts(batch.column("_text"), join.width):
                sizes = np.diff(bounds)
                one, two = signatures(values, bounds)
                chosen = []
                for row, name in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    # Copies that this task has met send their keys once.
                    if sizes[row] and name not in seen:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(name)
                        chosen.append(row)
                rows = np.array(chosen, dtype=np.int64)
                low = np.searchsorted(starts, sizes[rows], side="right") - 1
                high = np.searchsorted(starts, sizes[rows] * 100 // join.percent, side="right") - 1
                again = high - low + 1
                rows, bands = np.repeat(rows, again), ranges(low, again)
                if not len(rows):
                    continue
                held = np.append(0, np.cumsum(sizes[rows]))
                keys, near, owner = sketch_keys(values[ranges(bounds[rows], sizes[rows])], held, bands, words[bands])
                packed = ((keys & ~INSIDE) | (near & INSIDE)).view(np.int64)
                far = (near >> U(2 * FORM)).astype(np.uint32).view(np.int32)
                columns = [pa.array(c) for c in (packed, one[rows][owner], far)]
                yield pa.record_batch(columns, names=["key", "sig", "far"])

    return run


def near_forms(differ: np.ndarray) -> np.ndarray:
    """Whether the first 1, 2, ... words' forms have as many bits at most, as ``near_words`` has it."""
    fit = np.ones(len(differ), dtype=bool)
    for words in range(1, NEXT_WORDS + 1):
        fit &= np.bitwise_count(differ & ((1 << FORM * words) - 1)) <= words
    return fit


def near_groups(key: np.ndarray, sig: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For every line of whole groups, sorted by key, the first line of those it is near to by any steps.

    Steps lead between different sets of one key.
    """
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(begin, len(key)))
    after = np.repeat(begin + sizes, sizes) - np.arange(len(key)) - 1
    edges, lag = [], 1
    one = np.flatnonzero(after >= lag)
    while len(one):
        fit = near_forms(near[one] ^ near[one + lag]) & (sig[one] != sig[one + lag])
        edges.append(np.stack([one[fit], one[fit] + lag]))
        lag += 1
        one = one[after[one] >= lag]
    label = np.arange(len(key))
    ends = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.int64)
    while True:
        least = np.minimum(label[ends[0]], label[ends[1]])
        lower = label.copy()
        np.minimum.at(lower, ends[0], least)
        np.minimum.at(lower, ends[1], least)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def line_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Key, sig and short forms of the lines of several batches at a time."""
    held, lines = [], 0
    for batch in batches:
        held.append([batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "sig", "far")])
        lines += batch.num_rows
        if lines >= PART_LINES:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, lines = [], 0
    if lines:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over rows sorted by (key, sig): rows of keys with two sets or more.

    Puts the short forms together as ``next`` and adds the first set of the key and its ``next``. Where
    a key has at most ``NEAR_SETS`` lines, these are told apart by their short forms: a set that is near
    to no other one goes, and those that lead to each other get a key of their own, which differs in the
    last 16 bits. No pair that the forms allow is lost by that. The lines of such a key, or the first line
    of a longer one, are held between batches. A set may come twice where a batch ends.
    """

    def output(key, sig, near, head, at):
        columns = [key[at] + (head[at] - begin_of(key)[at]), sig[head[at]], near[head[at]], sig[at], near[at]]
        return pa.record_batch([pa.array(x) for x in columns], names=["key", "first", "first_next", "sig", "next"])

    def begin_of(key):
        new = np.append(True, key[1:] != key[:-1])
        return np.flatnonzero(new)[np.cumsum(new) - 1]

    def near_lines(key, sig, near):
        head = near_groups(key, sig, near)
        at = np.flatnonzero(np.bincount(head, minlength=len(head))[head] > 1)
        return output(key, sig, near, head, at)

    held = [np.zeros(0, dtype=np.int64)] * 3  # lines of the open group: key, sig, next
    sent = False  # whether the open group is long, and its first line, the only one held, has been sent
    for packed, sig, far in line_parts(batches):
        low = packed & int(INSIDE)
        near = (far.view(np.uint32).astype(np.int64) << 2 * FORM) | low
        lines = [np.append(h, x) for h, x in zip(held, (packed - low, sig, near), strict=True)]
        same = (lines[0][1:] == lines[0][:-1]) & (lines[1][1:] == lines[1][:-1])
        key, sig, near = (x[np.append(True, ~same)] for x in lines)
        begin = begin_of(key)
        last = int(begin[-1])
        size = np.bincount(begin, minlength=len(key))[begin]
        long = size > NEAR_SETS
        long[begin == 0] |= sent
        closed = np.arange(len(key)) < last
        short = np.flatnonzero(closed & ~long)
        if len(short):
            yield near_lines(key[short], sig[short], near[short])
        out = long & (sig != sig[begin])
        out[begin[out]] = True
        if sent:
            out[0] = False
        at = np.flatnonzero(out)
        if len(at):
            yield output(key, sig, near, begin, at)
        sent = bool(long[last])
        held = [x[last : last + 1] if sent else x[last:] for x in (key, sig, near)]
    if len(held[0]) and not sent:
        yield near_lines(*held)


SHARED = "key long, first long, first_next long, sig long, next long"


def near_words(one: str, two: str) -> Column:
    """Whether the first 1, 2, ... of the words after two equal keys differ in as many bits at most."""
    differ = F.col(one).bitwiseXOR(F.col(two))
    cut = lambda words: F.bit_count(differ.bitwiseAND(F.lit((1 << FORM * words) - 1)))
    return reduce(lambda x, y: x & y, [cut(words) <= words for words in range(1, NEXT_WORDS + 1)])


def sizes_fit(join: Join, one: str, two: str) -> Column:
    return 100 * F.least(one, two) >= join.percent * F.greatest(one, two)


def fetch_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """(sig, set) for the classes in ``pairs``, computed from a text of each.

    Where pairs are few their sets are one part, and need no further shuffle.
    """
    few = few_lines(pairs, ONE_TASK)
    pairs = pairs.coalesce(1) if few else pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    spokes = classes.join(wanted, "sig", "left_semi").select("rep", F.col("sig").alias("_sig"))
    spokes = stage(spokes, "wanted")
    # Few enough lines, as counted, are sent to the texts; else the texts are brought to them.
    spokes = F.broadcast(spokes) if is_small(spokes) else spokes
    texts = docs.join(spokes, F.col("_key").eqNullSafe(F.col("rep"))).select("_text", "_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_sigs, at = batch.column("_sig").to_numpy(), 0
            for values, bounds in shingle_parts(batch.column("_text"), join.width):
                own = wanted_sigs[at : at + len(bounds) - 1]
                at += len(own)
                # A repeated key may also name other texts.
                same = np.flatnonzero(signatures(values, bounds)[0] == own)
                sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in same.tolist()]
                yield pa.record_batch([pa.array(own[same]), pa.array(sets, pa.binary())], names=["sig", "found"])

    rows = texts.mapInArrow(run, "sig long, found binary")
    rows = rows.repartition(1) if few else rows
    return stage(rows.dropDuplicates(["sig"]), "sets")


def sketches_fit(join: Join, one: str, two: str) -> Column:
    """Whether two whole sketches differ in no more bits than the sets may in shingles.

    ``one`` and ``two`` are prefixes of the columns ``n`` and ``sketch``. A difference flips one bit, so
    the distance is at most the difference, and no similar pair is refused. Similar sizes have sketches
    of one width, or of one and its double, which is folded.
    """
    a, b = F.col(f"{one}_sketch"), F.col(f"{two}_sketch")
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: xor(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)))
    differ = (
        F.when(F.size(a) == F.size(b), xor(a, b))
        .when(F.size(a) == 2 * F.size(b), xor(fold(a), b))
        .when(2 * F.size(a) == F.size(b), xor(a, fold(b)))
    )
    distance = F.aggregate(differ, F.lit(0), lambda total, word: total + F.bit_count(word))
    most = F.floor((F.col(f"{one}_n") + F.col(f"{two}_n")) * (100 - join.percent) / (100 + join.percent))
    return F.coalesce(distance <= most, F.lit(True))


def narrow_sketches(classes: DataFrame) -> DataFrame:
    """(sig, sketch): null for large sets, whose many keys would each carry a long sketch.

    Pairs of these are compared by their sketches afterwards, in ``refuse``.
    """
    return classes.select("sig", F.when(F.size("sketch") <= SKETCH_WORDS, F.col("sketch")).alias("sketch"))


def refuse(pairs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) but for those that their whole sketches rule out.

    A few pairs are left as they are, as their sets are soon compared.
    """
    if few_lines(pairs, ONE_TASK):
        return pairs
    for side in "ab":
        own = classes.select(F.col("sig").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "sketch")])
        pairs = pairs.join(own, side)
    return stage(pairs.where(sketches_fit(join, "a", "b")).select("a", "b"), "likely")


def compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets are similar enough: by their sketches, then by the sets."""
    likely = refuse(pairs, classes, join)
    return verify(likely, fetch_sets(docs, classes, likely, join), join)


def verify(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough; few of them in one task."""
    if few_lines(pairs, ONE_TASK):
        pairs, sets = pairs.coalesce(1), sets.coalesce(1)
    left = sets.select(F.col("sig").alias("a"), F.col("found").alias("one"))
    right = sets.select(F.col("sig").alias("b"), F.col("found").alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x = np.frombuffer(one.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(two.as_buffer(), dtype=np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * shared >= join.percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "one", "two")
    return both.mapInArrow(run, "a long, b long")


def open_members(shared: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, sig, next, n, root) of the keys whose sets are not all in one component yet.

    Components only grow, so after the first turn ``shared`` may be what the turn before left open.
    """
    named = (
        shared.select("key", "sig", "next")
        .join(roots, F.col("sig") == F.col("node"), "left")
        .select("key", "sig", "next", F.coalesce("root", "sig").alias("root"))
    )
    named = stage(named, "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return named.join(mixed.select("key"), "key", "left_semi").distinct().join(sizes, "sig")


def star_pairs(members: DataFrame, join: Join, turn: int) -> DataFrame:
    """Every set with one centre of each of its keys, another one each turn, unless they share a component."""
    sides = [members.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("sig", "next", "root", "n")]) for side in "ab"]
    centre = F.min_by(F.struct("b_sig", "b_next", "b_root", "b_n"), F.xxhash64("b_sig", F.lit(turn)))
    centres = sides[1].groupBy("key").agg(centre.alias("c")).select("key", "c.*")
    return fitting(sides[0].join(centres, "key").where("a_root <> b_root"), join)


def fitting(both: DataFrame, join: Join) -> DataFrame:
    """The distinct pairs (a, b) whose short forms, sizes and, where given, sketches allow the similarity."""
    fit = near_words("a_next", "b_next") & sizes_fit(join, "a_n", "b_n")
    if "a_sketch" in both.columns:
        fit = fit & sketches_fit(join, "a", "b")
    fit = both.where(fit)
    return fit.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct()


def first_pairs(shared: DataFrame, sizes: DataFrame, join: Join) -> DataFrame:
    """Every set with that set which comes first in most of its keys."""
    near = shared.where(F.col("first") != F.col("sig")).where(near_words("first_next", "next"))
    counted = near.groupBy("sig", "first").agg(F.count(F.lit(1)).alias("c"))
    sized = counted.join(sizes, "sig").join(
        sizes.select(F.col("sig").alias("first"), F.col("n").alias("first_n")), "first"
    )
    fitting = sized.where(sizes_fit(join, "n", "first_n"))
    best = fitting.groupBy("sig").agg(F.max(F.struct("c", "first"))["first"].alias("first"))
    return best.select(F.least("first", "sig").alias("a"), F.greatest("first", "sig").alias("b")).distinct()


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return modest_batches(df).select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))


def digest_of(docs: DataFrame, join: Join) -> DataFrame:
    return stage(docs.mapInArrow(digests(join), f"_key long, {DIGEST}"), "digests")


def classes_of(digest: DataFrame) -> DataFrame:
    """(sig, sig2, n, rep, copies, sketch): every class of equal sets, its smallest key, and its rows."""
    groups = digest.where("n_shingles > 0").groupBy("sig", "sig2", F.col("n_shingles").alias("n"))
    found = groups.agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    return stage(found, "classes")


def find_shared(docs: DataFrame, join: Join) -> DataFrame:
    keys = docs.mapInArrow(key_rows(join), "key long, sig long, far int")
    dealt = keys.repartition(F.col("key").bitwiseAND(F.lit(~int(INSIDE)))).sortWithinPartitions("key", "sig")
    return stage(dealt.mapInArrow(shared_keys, SHARED), "shared")


def all_pairs(members: DataFrame, join: Join) -> DataFrame:
    """All pairs of sets (key, sig, next, n, root, sketch) that share a key and no root, in groups of bounded size.

    A key of more than ``KEY_SETS`` sets is cut by the short form of the next word: a set stands in the
    group of its own form as one side of a pair, and in the groups of all forms that differ in one bit
    at most as the other side. The sets of a key are also dealt into parts, and a group is a pair of
    parts. Every pair is found in one group at least, whatever the sizes. The join itself compares sketches,
    so of a group of sets that are not similar enough next to no pair comes out of it.
    """
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    form = F.col("next").bitwiseAND((1 << FORM) - 1)
    dealt = (
        members.join(counts, "key")
        .withColumn("parts", F.ceil(F.col("c") / (KEY_SETS * 16)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
        .withColumn("form", F.when(F.col("c") > KEY_SETS, form).otherwise(-1))
    )
    others = F.array(*[F.col("form").bitwiseXOR(F.lit(bit)) for bit in [0, *[1 << b for b in range(FORM)]]])
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("sig", "next", "n", "root", "sketch")]
    one = dealt.select("key", "form", F.col("part").alias("low"), F.explode(F.expr("sequence(part, parts - 1)")).alias("high"), *side("a"))
    two = dealt.select("key", "part", F.explode(F.when(F.col("form") < 0, F.array("form")).otherwise(others)).alias("form"), *side("b"))
    two = two.withColumn("high", F.col("part")).withColumn("low", F.explode(F.expr("sequence(0, part)")))
    both = one.join(two, ["key", "form", "low", "high"])
    return fitting(both.where("a_sig <> b_sig and a_root <> b_root and (low < high or a_sig < b_sig)"), join)


def link_classes(docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(a, b): every pair of classes whose sets are similar enough, once."""
    members = find_shared(docs, join).select("key", "sig", "next").distinct().join(classes.select("sig", "n"), "sig")
    members = members.join(narrow_sketches(classes), "sig")
    pairs = stage(all_pairs(members.withColumn("root", F.col("sig")), join), "pairs")
    return compare(docs, classes, pairs, join)


def find_links(df: DataFrame, join: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(class_a, class_b, key_a, key_b): every link between different sets, once.

    A class holds the rows of equal sets and is named by a hash of its set; a key is the smallest one
    of the class. Links between equal sets are those inside a class and are not spelled out.
    """
    docs = texts_of(df, key, text)
    classes = classes_of(digest_of(docs, join))
    named = [classes.select(F.col("sig").alias(f"class_{s}"), F.col("rep").alias(f"key_{s}")) for s in "ab"]
    links = link_classes(docs, classes, join).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    return links.join(named[0], "class_a").join(named[1], "class_b").select("class_a", "class_b", "key_a", "key_b")


def count_links(df: DataFrame, join: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, n_shingles, class_id, n_links), a row per row of ``df``: how many other rows are similar to it.

    Counted from the links of classes and their sizes. Rows without shingles have no class and no links.
    """
    docs = texts_of(df, key, text)
    digest = digest_of(docs, join)
    classes = classes_of(digest)
    links = stage(link_classes(docs, classes, join), "links")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ways.join(classes.select(F.col("sig").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("outside"))
    counted = classes.join(outside, F.col("sig") == F.col("a"), "left").select(
        "sig", "sig2", F.col("n").alias("n_shingles"), (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links")
    )
    return digest.join(counted, ["sig", "sig2", "n_shingles"], "left").select(
        "_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sig")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def find_classes(docs: DataFrame, digest: DataFrame, join: Join) -> DataFrame:
    """(sig, sig2, n, rep, root): every class of equal sets, its smallest key, and the name of its component."""
    classes = classes_of(digest)
    shared = find_shared(docs, join)
    sizes = classes.select("sig", "n")
    tested = stage(first_pairs(shared, sizes, join), "pairs")
    links = stage(compare(docs, classes, tested, join), "links")
    roots = stage(stars(links), "roots")
    found = True
    for turn in range(1, STAR_ROUNDS + 2):
        members = stage(open_members(shared, roots, sizes), "open")
        groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        many = groups.agg(F.sum("c").alias("rows"), F.sum(F.expr("c * (c - 1) div 2")).alias("pairs")).first()
        if not many["rows"]:
            break
        # Where stars find nothing more, or pairs are few, all pairs are taken and it ends.
        last = turn > STAR_ROUNDS or not found or many["pairs"] <= PAIRS_PER_ROW * many["rows"]
        paired = members
        if not last:
            # Keys of few sets make no more pairs a row than that, and are done with; only larger ones are opened again.
            large = groups.where(F.col("c") > 2 * PAIRS_PER_ROW + 1).select("key")
            shared = stage(members.join(large, "key", "left_semi"), "large")
            paired = members.join(large, "key", "left_anti")
        pairs = all_pairs(paired.join(narrow_sketches(classes), "sig"), join)
        if not last:
            pairs = pairs.unionByName(star_pairs(shared, join, turn)).distinct()
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = stage(compare(docs, classes, pairs, join), "more")
        found = not more.isEmpty()
        if found:
            joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            roots = stage(stars(joined), "roots")
        if last:
            break
        tested = stage(tested.unionByName(pairs), "tested")
    named = classes.join(roots, F.col("sig") == F.col("node"), "left")
    return named.select("sig", "sig2", "n", "rep", F.coalesce("root", "sig").alias("root"))


def find_components(df: DataFrame, join: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, n_shingles, component_id), a row per row of ``df``."""
    docs = texts_of(df, key, text)
    digest = digest_of(docs, join)
    named = find_classes(docs, digest, join)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "root").select("sig", "sig2", F.col("n").alias("n_shingles"), "component_id")
    return digest.join(found, ["sig", "sig2", "n_shingles"], "left").select(
        "_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_key")).alias("component_id")
    )


def one_of_each(df: DataFrame, join: Join, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of every component, of its smallest key; rows without shingles stay.

    A null key is the largest. Rows are told apart by key and text, so texts that share a key go or
    stay by themselves. Only rows that repeat the chosen key and text are brought together, to keep
    one of them.
    """
    name = ["_key", "_tag", "_tag2"]
    tags = F.xxhash64("_text").alias("_tag"), F.xxhash64(F.lit(1), "_text").alias("_tag2")
    docs = texts_of(df, key, text)
    tagged = docs.select("_key", *tags, "_text")
    digest = stage(
        tagged.mapInArrow(digests(join, tuple(name)), f"_key long, _tag long, _tag2 long, {DIGEST}"),
        "digests",
    )
    classes = find_classes(docs, digest, join).withColumnRenamed("n", "n_shingles").drop("rep")
    rows = digest.where("n_shingles > 0").join(classes, ["sig", "sig2", "n_shingles"])
    texts = stage(rows.groupBy("root", *name).agg(F.count(F.lit(1)).alias("n")), "rows")
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("_key").isNull().alias("unnamed"), *name)).alias("first"))
    chosen = texts.join(first, "root").withColumn("stays", F.struct(*name) == F.struct(*[f"first.{c}" for c in name]))
    chosen = stage(chosen.select(*name, "n", "stays"), "chosen")
    named = without(df, *name).withColumns({"_key": F.col(f"`{key}`").cast("long")})
    named = named.withColumns({"_tag": F.xxhash64(f"`{text}`"), "_tag2": F.xxhash64(F.lit(1), f"`{text}`")})

    def select(rows: DataFrame, lines: DataFrame, how: str) -> DataFrame:
        lines = lines.select(*[F.col(c).alias(f"{c}_") for c in name])
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in name]
        return rows.join(F.broadcast(lines) if is_small(lines) else lines, same, how)

    left = select(named, chosen.where(~F.col("stays")), "left_anti")
    again = chosen.where("stays and n > 1")
    if again.isEmpty():
        return left.drop(*name)
    columns = [f"`{c}`" for c in without(df, *name).columns]
    order = F.xxhash64(*[f"`{c}`" for c, kind in df.dtypes if "map<" not in kind])
    once = select(left, again, "left_semi").groupBy(*name).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return select(left, again, "left_anti").drop(*name).unionByName(once.select("row.*"))
