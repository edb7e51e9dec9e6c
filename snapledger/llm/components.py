"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import few_lines

MAX_ROUNDS = 100
ONE_TASK = 100_000


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over all links: the smallest node of every node's component."""
    above: dict[int, int] = {}

    def root_of(node: int) -> int:
        path = []
        while above.setdefault(node, node) != node:
            path.append(node)
            node = above[node]
        for passed in path:
            above[passed] = node
        return node

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            one, two = root_of(a), root_of(b)
            above[max(one, two)] = min(one, two)
    nodes = list(above)
    columns = [pa.array(nodes, pa.int64()), pa.array([root_of(n) for n in nodes], pa.int64())]
    yield pa.record_batch(columns, names=["node", "root"])


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node.

    Rounds of large-star and small-star steps: each node points its larger, then its smaller
    neighbours at the smallest of them. Every step is an aggregate with map-side combining and a
    join back, so a node with very many neighbours is never gathered, and the number of rounds is
    logarithmic in the nodes. At most ``ONE_TASK`` links are followed in one task instead, where rounds
    would spend their time on shuffles of next to nothing.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    if few_lines(edges, ONE_TASK):
        return edges.coalesce(1).mapInArrow(follow, "node long, root long")
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours of both kinds; larger ones move to the smallest.
        both = edges.unionByName(turned(edges))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct(), "large")
        # Small star: only smaller neighbours, and the node itself, move to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")
        )
        edges = stage(
            moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges"
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
