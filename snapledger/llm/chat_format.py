"""Turns and roles of plain transcripts by a hidden Markov model, rendered in one canonical form.

A transcript is a sequence of lines. A hidden state is a role and whether the line begins a turn of
that role. A line shows a speaker marker or none, and its length class, whether it ends a sentence,
whether it asks, and whether it is the transcript's first. Chances of states and signs are counted
on labelled transcripts, smoothed; Viterbi finds the likeliest states. Turns are then written as
``<|im_start|>role``, the lines without the marker, and ``<|im_end|>``.

A transcript of any length is cut into blocks of turns. For each block a table holds the best score
from every state before it to every state at its end; a pass over these small tables fixes the
states between blocks, and blocks are then decoded side by side. This is the same path as decoding
in one go, and no task holds a whole long transcript.

Defined results: a null or empty text is one empty line; null transcripts' names form a transcript
of their own; null turn numbers come first; rows with equal turn numbers follow each other by
their text; an empty table gives an empty result; without labelled rows all chances are even.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

BLOCK_TURNS = 1024

# Roles, and names by which transcripts announce a speaker.
ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": "system|sys|instructions?|context",
    "user": "user|human|customer|client|question|q|prompt|me",
    "assistant": "assistant|ai|bot|agent|model|answer|a|response|gpt",
}
STATES = 2 * len(ROLES)  # role * 2, plus 1 for lines after a turn's first
MARKS = len(ROLES) + 1
LENGTHS = (20, 80, 200, 500)
SHAPES = (len(LENGTHS) + 1) * 2 * 2 * 2
SMOOTHING = 0.5


def marker_pattern(names: str) -> str:
    opening, closing = r"(?:\*\*|#{1,4}\s*|<\|?|\[/?)?", r"(?:\s*\*\*)?\s*(?::\**|\|?>|\]:?)"
    return rf"(?i)^\s*{opening}\s*(?:{names})\s*{closing}\s*"


def mark_of(line: str) -> Column:
    """0 without a marker, else 1 and the place of the role it names."""
    found = F.lit(0)
    for i, role in enumerate(ROLES):
        found = F.when(F.col(line).rlike(marker_pattern(MARKERS[role])), F.lit(i + 1)).otherwise(found)
    return found


def shape_of(line: str, first: Column) -> Column:
    size = F.length(line)
    length = sum(((size > edge).cast("int") for edge in LENGTHS), F.lit(0))
    asks = F.col(line).contains("?").cast("int")
    ends = F.col(line).rlike(r"[.!?…]\s*$").cast("int")
    return ((length * 2 + asks) * 2 + ends) * 2 + first.cast("int")


def lines_of(df: DataFrame, name: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per line: its transcript, block, place, and what it shows."""
    rows = df.select(
        F.col(f"`{name}`").alias("conv"),
        F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.xxhash64(f"`{text}`").alias("tie"),
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\r?\n").alias("lines"),
        *[F.col(f"`{c}`") for c in keep],
    )
    start = rows.groupBy(F.col("conv").alias("whose")).agg(F.min("turn").alias("start"))
    rows = rows.join(start, F.col("conv").eqNullSafe(F.col("whose"))).drop("whose")
    lines = rows.select(
        "conv", F.floor(F.col("turn") / BLOCK_TURNS).cast("long").alias("block"), "turn", "tie", "start", *keep,
        F.posexplode("lines").alias("at", "line"),
    )
    first = (F.col("turn") == F.col("start")) & (F.col("at") == 0)
    return lines.withColumn("mark", mark_of("line")).withColumn("shape", shape_of("line", first)).drop("start")


@dataclass(frozen=True)
class Model:
    """Logarithms of chances: of first states, of steps, and of signs by state."""

    start: np.ndarray
    step: np.ndarray
    marks: np.ndarray
    shapes: np.ndarray

    def seen(self, mark: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return self.marks[:, mark].T + self.shapes[:, shape].T


def shares(counts: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    smooth = counts + (SMOOTHING if allowed is None else SMOOTHING * allowed)
    with np.errstate(divide="ignore"):
        return np.log(smooth / smooth.sum(axis=-1, keepdims=True))


def fit(lines: DataFrame, role: str = "role") -> Model:
    """Count the model on lines whose role is known; only counts by state and sign are gathered."""
    place = sum((F.when(F.col(f"`{role}`") == r, F.lit(i)).otherwise(F.lit(0)) for i, r in enumerate(ROLES)), F.lit(0))
    known = lines.where(F.col(f"`{role}`").isin(*ROLES)).withColumn("state", place * 2 + (F.col("at") > 0).cast("int"))
    # Steps from line to line inside blocks, and from a block's last line to the first of the next.
    order = ("turn", "tie", "at", "state")
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    within = known.select("state", F.lead("state").over(inside).alias("next"))
    ends = known.groupBy("conv", "block").agg(
        F.min_by("state", F.struct(*order)).alias("opening"), F.max_by("state", F.struct(*order)).alias("state")
    )
    between = ends.select("state", F.lead("opening").over(Window.partitionBy("conv").orderBy("block")).alias("next"))
    steps = within.unionByName(between).where("next is not null").groupBy("state", "next").count().collect()
    signs = known.groupBy("state", "mark", "shape").agg(
        F.count(F.lit(1)).alias("count"), F.sum((F.col("shape") % 2).cast("long")).alias("firsts")
    ).collect()
    states = np.arange(STATES)
    begins = (states % 2 == 0).astype(float)
    marks, shapes, start = np.zeros((STATES, MARKS)), np.zeros((STATES, SHAPES)), np.zeros(STATES)
    for row in signs:
        marks[row["state"], row["mark"]] += row["count"]
        shapes[row["state"], row["shape"]] += row["count"]
        start[row["state"]] += row["firsts"]
    step = np.zeros((STATES, STATES))
    for row in steps:
        step[row["state"], row["next"]] += row["count"]
    allowed = np.ones((STATES, STATES))
    for i in range(len(ROLES)):
        allowed[:, 2 * i + 1] = 0
        allowed[[2 * i, 2 * i + 1], 2 * i + 1] = 1
    return Model(shares(start * begins, begins), shares(step * allowed, allowed), shares(marks), shares(shapes))


def best_through(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best score from every state before the lines, or from the start, to every state at their end."""
    table = np.vstack([model.step, model.start]) + seen[0]
    for row in seen[1:]:
        table = (table[:, :, None] + model.step[None, :, :]).max(axis=1) + row
    return table


def best_path(first: np.ndarray, step: np.ndarray, seen: np.ndarray, last: int) -> np.ndarray:
    """States of the lines, given the chances of the first and the state of the last."""
    back = np.zeros((len(seen), STATES), dtype=np.int64)
    score = first + seen[0]
    for t in range(1, len(seen)):
        ways = score[:, None] + step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + seen[t]
    path = np.zeros(len(seen), dtype=np.int64)
    path[-1] = last
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def states_between(tables: list[np.ndarray]) -> list[int]:
    """The state at the end of every block on the best path through all blocks."""
    score, back = tables[0][STATES], []
    for table in tables[1:]:
        ways = score[:, None] + table[:STATES]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    ends = [int(score.argmax())]
    for step in reversed(back):
        ends.append(int(step[ends[-1]]))
    return ends[::-1]


def in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("turn", "ascending"), ("tie", "ascending"), ("at", "ascending")])


LINE = "name string, conv string, block long, place int, line string, mark int, state int, local int"


def recover(lines: DataFrame, model: Model) -> DataFrame:
    """Every line with its state and ``turn_no``, the number of the turn it belongs to, from 0."""
    # Groups go by a name that is not null.
    name = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    named = lines.withColumn("name", name)

    def signs(rows: pa.Table) -> np.ndarray:
        return model.seen(rows["mark"].to_numpy(), rows["shape"].to_numpy())

    def summarise(rows: pa.Table) -> pa.Table:
        table = best_through(model, signs(in_order(rows)))
        head = rows.slice(0, 1).select(["name", "block"])
        return head.append_column("best", pa.array([table.ravel().tolist()], pa.list_(pa.float64())))

    def connect(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending")])
        ends = states_between([np.array(t).reshape(STATES + 1, STATES) for t in rows["best"].to_pylist()])
        out = rows.select(["name", "block"]).append_column("entry", pa.array([STATES, *ends[:-1]], pa.int32()))
        return out.append_column("ending", pa.array(ends, pa.int32()))

    def decode(rows: pa.Table) -> pa.Table:
        rows = in_order(rows)
        first = np.vstack([model.step, model.start])[rows["entry"][0].as_py()]
        path = best_path(first, model.step, signs(rows), rows["ending"][0].as_py())
        columns = {c: rows[c] for c in ("name", "conv", "block", "line", "mark")}
        columns["place"] = pa.array(np.arange(len(path), dtype=np.int32))
        columns["state"] = pa.array(path.astype(np.int32))
        columns["local"] = pa.array(np.cumsum(path % 2 == 0).astype(np.int32))
        return pa.table(columns).select([c.split()[0] for c in LINE.split(", ")])

    few = named.select("name", "block", "turn", "tie", "at", "mark", "shape")
    best = few.groupBy("name", "block").applyInArrow(summarise, "name string, block long, best array<double>")
    joints = best.groupBy("name").applyInArrow(connect, "name string, block long, entry int, ending int")
    placed = named.withColumn("conv", F.col("conv").cast("string")).join(joints, ["name", "block"])
    decoded = stage(placed.groupBy("name", "block").applyInArrow(decode, LINE), "turns")
    earlier = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        decoded.groupBy("name", "block")
        .agg(F.max("local").alias("n"))
        .select("name", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    number = (F.col("shift") + F.col("local") - 1).cast("long")
    return decoded.join(shift, ["name", "block"]).withColumn("turn_no", number).drop("shift", "local")


def render(recovered: DataFrame) -> DataFrame:
    """A row per turn: transcript, number, role, lines, and the canonical text."""
    begins = F.col("state") % 2 == 0
    place = F.floor(F.col("state") / 2).cast("int")
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), place)
    bare = F.col("line")
    for i, r in enumerate(ROLES):
        own = begins & (F.col("mark") == i + 1) & (place == i)
        bare = F.when(own, F.regexp_replace("line", marker_pattern(MARKERS[r]), "")).otherwise(bare)
    turns = recovered.withColumn("bare", bare).withColumn("role", role).groupBy("name", "turn_no").agg(
        F.first("conv").alias("conv"),
        F.first("role").alias("role"),
        F.array_sort(F.collect_list(F.struct("block", "place", "bare"))).alias("lines"),
    )
    body = F.array_join(F.transform("lines", lambda x: x["bare"]), "\n")
    text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), body, F.lit("<|im_end|>"))
    return turns.select("conv", "turn_no", "role", F.size("lines").alias("n_lines"), text.alias("rendered"))


def as_transcripts(turns: DataFrame, unmarked: int = 8) -> DataFrame:
    """Plain transcripts of labelled turns: ``text`` with the speaker's marker before it.

    The style depends on the conversation; one turn in ``unmarked`` has no marker.
    """
    styles = (("User: ", "Assistant: ", "System: "), ("### Human: ", "### AI: ", "### Instruction: "), ("Q: ", "A: ", "Context: "), ("**Customer:** ", "**Agent:** ", "**System:** "))
    pick = lambda i: F.get(F.array(*[F.lit(s[i]) for s in styles]), F.pmod(F.xxhash64("conv_id"), F.lit(len(styles))).cast("int"))
    marker = F.when(F.col("role") == "user", pick(0)).when(F.col("role") == "assistant", pick(1)).when(F.col("role") == "system", pick(2))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0
    said = F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", "role", said.alias("text"))
