"""Merkle manifest of a dataset, with a proof per row, by rolling up nested structs.

A leaf is the hash of a row's fields; leaves of a group (a language) stand in the order of their
keys, every eight of them hash to a node, eight nodes to one of the next level, and so on up to one
node, the group's root; the groups' roots are leaves of one more tree, whose top is the root.

Rows are numbered within their group by a range partitioning of small rows (hash and key, never the
text). The number's octal digits are columns, and the digits are grouped away one after the other,
lowest first: the rows of a group become an array of structs, ordered by the digit, under the hash
of their digests. The arrays nest, so after ``DIGITS`` rounds one row holds a whole subtree of at
most 8 ** DIGITS leaves, a block. Rows are dealt to tasks by block once; the rounds need no further
shuffle. The blocks' digests are the leaves of the same roll-up one step higher, until a group is one
block. On the way back every level is turned into its children by a transform, that gives each child
the digests left and right of it, and an explode. So inside a block proofs come without a join; the
steps above a block, one line per 8 ** DIGITS leaves, are joined to the block once.

No task holds more than a block, whatever the size of a group. Rows equal in everything have equal
leaves, and it makes no difference which of them stands first.

Defined results: a null group is a group of its own and comes first; null keys come first in a group
and are never tampered with; equal keys are ordered by their leaves; a group of one row has that
leaf as its root, a dataset of one group that group's root; an empty table gives no rows; columns
beyond the named ones take no part, whatever their names. Nulls hash as ``-``, empty texts as
``0:``; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
DIGITS = 4
STEPS = "array<struct<before: string, after: string>>"
TAMPER_EVERY = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    key: str = "doc_id"
    group: str = "lang"
    text: str = "text"
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def field(value: Column) -> Column:
    """A field such that fields put together can be told apart."""
    content = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(content).cast("string"), F.lit(":"), content), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def tampered_text(manifest: Manifest) -> Column:
    """The text as found later: rows whose key's checksum is divisible by three were changed."""
    text, key = F.col(f"`{manifest.text}`"), F.col(f"`{manifest.key}`").cast("string")
    chosen = F.coalesce(F.crc32(key) % TAMPER_EVERY == 0, F.lit(False))
    return F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(text)


def leaves(df: DataFrame, manifest: Manifest, found: Column | None = None) -> DataFrame:
    """Group, key, leaf, and the leaf of the text as ``found`` (by default as stored) of every row."""
    text = F.col(f"`{manifest.text}`")
    seen = text if found is None else found
    fields = [F.col(f"`{f}`") for f in manifest.fields]
    again = [seen if f == manifest.text else F.col(f"`{f}`") for f in manifest.fields]
    same = text.eqNullSafe(seen)
    own = leaf(fields)
    return df.select(
        F.col(f"`{manifest.group}`").alias("tree"),
        F.col(f"`{manifest.key}`").alias("key"),
        own.alias("digest"),
        F.when(~same, leaf(again)).alias("other"),
    ).withColumn("other", F.coalesce("other", "digest"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``, a row's number in its tree from 0, and ``total``, the rows of the tree.

    Rows are sorted by ranges of (tree, order); a range is a task's share whatever the values, since
    the rows' numbers of arrival part equal ones. Numbers within a range are shifted by the counts of
    the tree's rows in earlier ranges, of which there is a line per range and tree in it.
    """
    sort = [F.col(c).asc_nulls_first() for c in ["tree", *order, "_arrival"]]
    ranged = (
        rows.withColumn("_arrival", F.monotonically_increasing_id())
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .drop("_arrival")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = stage(ranged, "ranged").withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.expr("sum(_n) over (partition by tree order by _range rows between unbounded preceding and 1 preceding)")
    shifts = counts.select(
        F.col("tree").alias("_tree"),
        F.col("_range").alias("_in"),
        (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.expr("sum(_n) over (partition by tree)").alias("total"),
    )
    match = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_in"))
    joined = ranged.join(shifts, match)
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "total")


def levels(total: str) -> Column:
    """How many times nodes are put together until one is left."""
    lines = F.col(total) - 1
    return F.when(lines == 0, 0).otherwise(F.ceil(F.length(F.conv(lines.cast("string"), 10, 2)) / FANOUT_BITS)).cast("int")


def roll_up(nodes: DataFrame, payload: list[str], done: int) -> DataFrame:
    """One row per block: its digest, and its subtree as nested arrays of structs.

    ``nodes`` has tree, depth, place and digest; ``done`` counts the levels below the nodes. Where the
    tree ends inside a block, the levels above only pass its one node on.
    """
    digits = [f"d{i}" for i in range(DIGITS)]
    octal = [F.shiftright("place", FANOUT_BITS * i).bitwiseAND(FANOUT - 1).cast("int").alias(d) for i, d in enumerate(digits)]
    block = F.shiftright("place", FANOUT_BITS * DIGITS).alias("block")
    rows = nodes.select("tree", "depth", block, *octal, "digest", *payload).repartition("tree", "block")
    held = payload
    for level, digit in enumerate(digits):
        kid = F.struct(digit, "digest", *held)
        rows = rows.groupBy("tree", "depth", "block", *digits[level + 1 :]).agg(
            F.array_sort(F.collect_list(kid)).alias(f"nodes{level}")
        )
        kids = F.col(f"nodes{level}")
        joined = digest(F.array_join(F.transform(kids, lambda k: k["digest"]), ""))
        rows = rows.withColumn("digest", F.when(F.col("depth") > done + level, joined).otherwise(kids[0]["digest"]))
        held = [f"nodes{level}"]
    return rows


def unfold(blocks: DataFrame, payload: list[str], carried: list[str], done: int) -> DataFrame:
    """The nodes of ``blocks`` again, their ``steps`` in front of those above their block."""
    fixed = ["tree", "depth", "block", *carried]
    rows = blocks
    for level in reversed(range(DIGITS)):
        inner = payload if level == 0 else [f"nodes{level - 1}"]
        rows = rows.select(*fixed, "steps", F.explode(with_siblings(F.col(f"nodes{level}"), inner)).alias("kid"))
        step = F.array(F.struct("kid.before", "kid.after"))
        steps = F.when(F.col("depth") > done + level, F.concat(step, "steps")).otherwise(F.col("steps"))
        rows = rows.select(*fixed, steps.alias("steps"), "kid.digest", *[f"kid.{c}" for c in inner])
    return rows


def with_siblings(kids: Column, inner: list[str]) -> Column:
    """Children with the digests of those before and after them."""
    digests = F.transform(kids, lambda k: k["digest"])

    def child(k: Column, i: Column) -> Column:
        before = F.array_join(F.slice(digests, F.lit(1), i), "")
        after = F.array_join(F.slice(digests, i + 2, F.lit(FANOUT)), "")
        return F.struct(k["digest"].alias("digest"), before.alias("before"), after.alias("after"), *[k[c].alias(c) for c in inner])

    return F.transform(kids, child)


Crown = Callable[[DataFrame], DataFrame]


def climb(nodes: DataFrame, payload: list[str], crown: Crown, carried: list[str], widest: int, done: int = 0) -> DataFrame:
    """Every node with its ``steps`` up to the root.

    ``crown`` takes the trees and their tops' digests and returns, per tree, the steps above it and the
    ``carried`` columns. ``widest`` is the number of nodes of the largest tree; it only decides how
    often blocks are put together.
    """
    blocks = stage(roll_up(nodes, payload, done), "blocks")
    if widest <= FANOUT**DIGITS:
        above = crown(blocks.select("tree", "digest")).withColumn("below", F.lit(0).cast("long"))
    else:
        heads = blocks.select("tree", "depth", F.col("block").alias("place"), "digest", F.col("block").alias("below"))
        above = climb(heads, ["below"], crown, carried, -(-widest // FANOUT**DIGITS), done + DIGITS)
    above = above.select(F.col("tree").alias("_tree"), F.col("below"), "steps", *carried)
    match = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("below"))
    return unfold(blocks.join(above, match), payload, carried, done)


def build(rows: DataFrame, order: list[str], payload: list[str], crown: Crown, carried: list[str]) -> DataFrame:
    """The rows (tree, digest, payload) with their steps; a tree's leaves are ordered by ``order``."""
    placed = stage(numbered(rows, order).withColumn("depth", levels("total")), "placed")
    last = placed.agg(F.max("place")).first()[0]
    return climb(placed, payload, crown, carried, 1 + (last or 0))


def join_groups(tops: DataFrame) -> DataFrame:
    """One more tree over the groups' roots, in the order of the groups' names."""
    named = stage(tops, "subroots").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest")
    alone = lambda top: top.select("tree", F.expr(f"cast(array() as {STEPS})").alias("steps"), F.col("digest").alias("root"))
    groups = build(named, ["name"], ["name"], alone, ["root"])
    return groups.select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")


def manifest_rows(df: DataFrame, manifest: Manifest, found: Column | None = None) -> DataFrame:
    """Every row's ``key`` with ``leaf``, ``subroot``, ``root``, ``other`` and ``steps``.

    ``steps`` are the digests left and right of the way from the leaf to the root, lowest first: the
    proof. ``other`` is the leaf of the row as ``found``, its text as met later; by default as it is.
    """
    small = stage(leaves(df, manifest, found), "leaves")
    rows = build(small, ["key", "digest"], ["key", "other"], join_groups, ["subroot", "root"])
    return rows.select(
        F.col("tree").alias("group"), "key", F.col("digest").alias("leaf"), "other", "subroot", "root", "steps"
    )


def fold(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the digests beside its way up."""
    return F.aggregate(steps, start, lambda found, s: digest(F.concat(s["before"], found, s["after"])))


def proof_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def check(rows: DataFrame) -> DataFrame:
    """Rows of a manifest with ``proof_sha256``, ``folded_root`` from the row as found, and ``verified``."""
    folded = rows.withColumn("proof_sha256", digest(proof_text(F.col("steps")))).withColumn(
        "folded_root", fold(F.col("other"), F.col("steps"))
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
