"""Counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DELETE, DUP_COPY, DUP_LINK, IMPORT


STATS = "measure string, files long, bytes long"
MEASURES = ["hashed", "copied", "linked", "deleted"]


def stat_columns(actions: DataFrame) -> list[Column]:
    """Two aggregates per measure, its files and its bytes, that can also be observed in another job.

    ``actions`` has ``action``, ``size`` and, where content was read, a true ``hashed``.
    """
    hashed = F.col("hashed") if "hashed" in actions.columns else F.lit(False)
    rules = {
        "hashed": hashed,
        "copied": F.col("action").isin(IMPORT, DUP_COPY),
        "linked": F.col("action") == DUP_LINK,
        "deleted": F.col("action") == DELETE,
    }
    found = []
    for name in MEASURES:
        found.append(F.count_if(rules[name]).alias(f"{name}_files"))
        found.append(F.coalesce(F.sum(F.when(rules[name], F.col("size"))), F.lit(0)).alias(f"{name}_bytes"))
    return found


def stat_lines(totals: dict[str, int]) -> list[tuple[str, int, int]]:
    """Lines of ``STATS`` from observed totals."""
    return [(name, totals[f"{name}_files"], totals[f"{name}_bytes"]) for name in MEASURES]


def action_stats(actions: DataFrame) -> DataFrame:
    """Files and bytes hashed, copied, linked and deleted, one line per measure."""
    totals = actions.agg(*stat_columns(actions))
    lines = [
        F.struct(
            F.lit(name).alias("measure"),
            F.col(f"{name}_files").alias("files"),
            F.col(f"{name}_bytes").alias("bytes"),
        )
        for name in MEASURES
    ]
    return totals.select(F.inline(F.array(*lines)))


def exclusion_stats(excluded: DataFrame) -> DataFrame:
    """Entries left out, by ``reason``."""
    return excluded.groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))


def event_counts(problems: DataFrame) -> DataFrame:
    """Warnings and errors per snapshot, and in total on the line with ``snapshot`` = '*'.

    The total is there even without any event.
    """
    events = {"warnings": "warning", "errors": "error"}
    per_snapshot = problems.groupBy("snapshot").agg(
        *[F.count_if(F.col("level") == level).alias(name) for name, level in events.items()]
    )
    total = per_snapshot.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in events])
    return per_snapshot.unionByName(total.withColumn("snapshot", F.lit("*")))
