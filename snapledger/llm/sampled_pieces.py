"""Sampled SentencePiece segmentation and lossless decoding.

All ways to cut a text into pieces of a given vocabulary form a lattice. A piece weighs
``(place in the vocabulary + SHIFT) ** -sharpness``, as the vocabulary is ordered by frequency; a
way weighs the product of its pieces. Forward filtering sums the weights of all ways up to every
byte; backward sampling draws pieces from the end, each with its part of the sum, so a way is drawn
in proportion to its weight. Draws are hashes of seed, row key and place, so a row is cut alike in
every run, on any number of tasks.

Pieces don't cross from a word into the space before the next one, so the lattice falls apart
into segments at those places. Equal segments of a batch share their forward sums; draws for all
segments of a batch advance together in numpy.

A byte that is no piece by itself has a byte piece of far smaller weight, so any text can be cut. A space stands for
the vocabulary's space mark and one is put before each text; the mark itself, where a text holds it,
becomes byte pieces. Decoding joins the pieces' bytes and takes the first space off again, so it
gives back exactly the text.

Memory holds the arrays of ``BATCH_BYTES`` of text at a time, in both directions, a longer text alone.
They are many times as large, and an executor runs two workers per task, one each way.

Defined results: a null text has null pieces and decodes to null; an empty text has none and decodes
to the empty text; null keys count as key 0; repeated rows are cut alike; an empty table gives an
empty result; columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, spare, without
from .shingles import ODD, STEP, U, mix64, powers, ranges, segment_sums, text_parts

SHIFT = 10
BATCH_BYTES = 1 << 19
BYTE_WEIGHT = -25.0
MARK = "▁"
SPACE = 0x20
PLAIN_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * STEP)


@dataclass(frozen=True)
class Pieces:
    """The vocabulary's file, how strongly frequent pieces are preferred, and the seed."""

    model: str
    sharpness: float = 1.0
    seed: int = 3


@dataclass(frozen=True)
class Trie:
    """Steps from a node by a byte in an open-addressed table, and the piece ending at a node (-1: none)."""

    slots: np.ndarray
    nodes: np.ndarray
    piece: np.ndarray
    one_byte: np.ndarray
    weights: np.ndarray
    content: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        wanted = node * 256 + byte
        at = slot_of(wanted, len(self.slots))
        found = self.slots[at]
        off = np.flatnonzero((found != wanted) & (found >= 0))
        while len(off):
            at[off] = (at[off] + 1) % len(self.slots)
            other = self.slots[at[off]]
            off = off[(other != wanted[off]) & (other >= 0)]
        return np.where(self.slots[at] == wanted, self.nodes[at], -1)


def slot_of(wanted: np.ndarray, size: int) -> np.ndarray:
    return ((wanted.astype(np.uint64) * ODD) >> U(65 - size.bit_length())).astype(np.int64)


@lru_cache(maxsize=2)
def load(pieces: Pieces) -> Trie:
    """Read the vocabulary once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model)
    count = model.get_piece_size()
    contents: list[bytes] = [b""] * count
    byte_piece = np.full(256, -1, dtype=np.int64)
    moves: dict[int, int] = {}
    ends = [-1]
    for i in range(count):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_piece[int(text[3:5], 16)] = i
            contents[i] = bytes([int(text[3:5], 16)])
            continue
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in text.lstrip(MARK):
            continue
        contents[i] = text.replace(MARK, " ").encode()
        node = 0
        for byte in contents[i]:
            following = moves.setdefault(node * 256 + byte, len(ends))
            if following == len(ends):
                ends.append(-1)
            node = following
        ends[node] = i
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary has no piece for every byte")
    size = 1 << (4 * len(moves)).bit_length()
    slots, nodes = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for key, at in zip(moves, slot_of(np.array(list(moves)), size).tolist(), strict=True):
        while slots[at] >= 0:
            at = (at + 1) % size
        slots[at], nodes[at] = key, moves[key]
    weights = -pieces.sharpness * np.log(np.arange(count) + SHIFT)
    weights[byte_piece] = BYTE_WEIGHT
    one_byte = byte_piece.copy()
    for i, content in enumerate(contents):
        if len(content) == 1 and not model.is_byte(i):
            one_byte[content[0]] = i
    lengths = np.array([len(c) for c in contents], dtype=np.int64)
    return Trie(
        slots,
        nodes,
        np.array(ends, dtype=np.int64),
        one_byte,
        weights,
        np.frombuffer(b"".join(contents), dtype=np.uint8),
        np.cumsum(lengths) - lengths,
        lengths,
    )


def lattice(trie: Trie, data: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges over ``data`` by length from 1 on: starts and pieces; ``left`` is what a segment still has."""
    found = [(np.arange(len(data)), trie.one_byte[data])]
    node, alive, depth = np.zeros(len(data), dtype=np.int64), np.arange(len(data)), 0
    while len(alive):
        node = trie.step(node, data[alive + depth])
        depth += 1
        here = node >= 0
        node, alive = node[here], alive[here]
        piece = trie.piece[node]
        if depth > 1:
            hit = piece >= 0
            found.append((alive[hit], piece[hit]))
        more = left[alive] > depth
        node, alive = node[more], alive[more]
    return found


@dataclass(frozen=True)
class Filtered:
    """Edges in the order of their ends, with the running share of every end's sum."""

    first: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    share: np.ndarray


def forward(trie: Trie, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Filtered:
    """Forward filtering over segments laid out in ``data``, one place in all segments at a time.

    Node ``i`` is the place after byte ``i``. Nodes are ranked by their place in the segment; each
    length gives a node one edge at most, so edges are dealt to their nodes without sorting.
    """
    size = len(data)
    inside = (np.arange(size) - np.repeat(begins, lengths)).astype(np.int32)
    left = np.repeat(lengths, lengths) - inside
    edges = lattice(trie, data, left)
    degree = np.zeros(size, dtype=np.int64)
    for reach, (start, _) in enumerate(edges):
        degree[start + reach] += 1
    order = np.argsort(inside, kind="stable")
    ranked = np.cumsum(degree[order])
    total_edges = int(ranked[-1])
    heads = np.append(ranked - degree[order], total_edges)
    first = np.empty(size, dtype=np.int64)
    first[order] = heads[:-1]
    fill = first.copy()
    starts = np.empty(total_edges, dtype=np.int32)
    pieces = np.empty(total_edges, dtype=np.int32)
    for reach, (start, piece) in enumerate(edges):
        node = start + reach
        at = fill[node]
        starts[at], pieces[at] = start, piece
        fill[node] += 1
    weight = trie.weights[pieces]
    before = np.zeros(size + 1)
    value = np.empty(total_edges)
    cuts = np.append(0, np.cumsum(np.bincount(inside)))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = int(heads[low]), int(heads[high])
        head = heads[low:high] - a
        counts = np.diff(heads[low : high + 1])
        sums = before[starts[a:b]] + weight[a:b]
        top = np.maximum.reduceat(sums, head)
        parts = np.exp(sums - np.repeat(top, counts))
        whole = np.add.reduceat(parts, head)
        value[a:b] = parts / np.repeat(whole, counts)
        node = order[low:high]
        # What follows a segment's last byte is the next segment's begin, whose sum is 0.
        before[node + 1] = np.where(left[node] == 1, 0.0, top + np.log(whole))
    share = np.cumsum(value)
    share -= np.repeat(share[heads[:-1]] - value[heads[:-1]], np.diff(heads))
    share[heads[1:] - 1] = 2.0
    return Filtered(first, starts, pieces, share)


def draw(
    filtered: Filtered, begin: np.ndarray, last: np.ndarray, rows: np.ndarray, places: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling for all segments at once: their pieces in order, and how many each has.

    ``begin`` and ``last`` are the first and last byte of the segment's copy in the lattice;
    ``rows`` and ``places`` tell draws of different rows and places apart.
    """
    active = np.arange(len(begin))
    at = last.copy()
    counts = np.zeros(len(begin), dtype=np.int64)
    drawn = []
    while len(active):
        u = (mix64(rows[active] ^ mix64(places[active] * STEP + counts[active].astype(np.uint64) * ODD)) >> U(11)) * 2.0**-53
        edge = filtered.first[at[active]]
        behind = np.flatnonzero(filtered.share[edge] <= u)
        while len(behind):
            edge[behind] += 1
            behind = behind[filtered.share[edge[behind]] <= u[behind]]
        drawn.append((active, filtered.piece[edge]))
        counts[active] += 1
        at[active] = filtered.start[edge] - 1
        active = active[filtered.start[edge] > begin[active]]
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for back, (which, piece) in enumerate(drawn):
        ids[ends[which] - 1 - back] = piece
    return ids, counts


def segments(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where segments begin: at texts, and at spaces that follow something else."""
    start = np.zeros(len(data), dtype=bool)
    start[1:] = (data[1:] == SPACE) & (data[:-1] != SPACE)
    start[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    return np.flatnonzero(start)


def encode_part(
    trie: Trie, pieces: Pieces, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of consecutive texts, and the number of pieces before each bound."""
    sizes = np.diff(bounds)
    full = sizes > 0
    data = np.insert(data, bounds[:-1][full], SPACE)
    bounds = np.append(0, np.cumsum(sizes + full))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    begin = segments(data, bounds)
    length = np.diff(np.append(begin, len(data)))
    inside = np.arange(len(data)) - np.repeat(begin, length)
    hashes = mix64(np.add.reduceat(PLAIN_BYTES[data] * powers(int(length.max()))[inside], begin) + length.astype(np.uint64))
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    own_length = length[sample]
    own_begin = np.cumsum(own_length) - own_length
    filtered = forward(trie, data[ranges(begin[sample], own_length)], own_begin, own_length)
    row = np.searchsorted(bounds, begin, side="right") - 1
    seeds = mix64(keys.astype(np.int64).view(np.uint64) * ODD + U(pieces.seed))
    places = (begin - bounds[row]).astype(np.uint64)
    ids, counts = draw(filtered, own_begin[which], own_begin[which] + own_length[which] - 1, seeds[row], places)
    before = np.append(0, np.cumsum(counts))
    return ids, before[np.searchsorted(begin, bounds)]


def list_column(parts: list[tuple[np.ndarray, np.ndarray]], null: np.ndarray) -> pa.Array:
    """Lists of whole numbers from (values, bounds) of consecutive rows."""
    values = [np.zeros(0, np.int32)]
    offsets, base = [np.zeros(1, np.int64)], 0
    for ids, before in parts:
        values.append(ids)
        offsets.append(before[1:] + base)
        base += len(ids)
    places = np.concatenate(offsets).astype(np.int32)
    mask = pa.array(null) if null.any() else None
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(values)), mask=mask)


def encode_column(trie: Trie, pieces: Pieces, column: pa.Array, keys: np.ndarray) -> pa.Array:
    """The pieces of every text of a column, part by part."""
    parts = [
        encode_part(trie, pieces, data, bounds, keys[first : first + len(bounds) - 1])
        for data, bounds, first in text_parts(column, BATCH_BYTES)
    ]
    return list_column(parts, column.is_null().to_numpy(zero_copy_only=False))


def decode_column(trie: Trie, lists: pa.Array) -> pa.Array:
    """The text that every list of pieces of a column stands for, part by part."""
    bounds = np.asarray(lists.offsets).astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    before = np.append(0, np.cumsum(segment_sums(trie.lengths[ids], bounds)))
    parts, first = [np.zeros(0, np.uint8)], 0
    while first < len(lists):
        end = int(np.searchsorted(before, before[first] + BATCH_BYTES))
        end = min(max(end, first + 1), len(lists))
        own = ids[bounds[first] : bounds[end]]
        data = trie.content[ranges(trie.begins[own], trie.lengths[own])]
        keep = np.ones(len(data), dtype=bool)
        full = before[first:end] < before[first + 1 : end + 1]
        keep[before[first:end][full] - before[first]] = False
        parts.append(data[keep])
        first = end
    ends = np.append(0, np.cumsum(np.maximum(np.diff(before) - 1, 0)))
    raw = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts)))
    texts = raw.cast(pa.string())
    if lists.null_count:
        import pyarrow.compute as pc

        texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
    return texts


def encode(df: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``pieces``, the sampled piece numbers of every text."""
    df = without(df, "pieces")
    order = spare(df, "row_key")
    schema = T.StructType([*df.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(pieces)
        for batch in batches:
            keys = batch.column(order).to_numpy(zero_copy_only=False)
            column = batch.column(text)
            found = encode_column(trie, pieces, column, keys)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], found], names=[*names, "pieces"])

    number = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long"))
    return modest_batches(df).withColumn(order, number).mapInArrow(run, schema)


def decode(df: DataFrame, pieces: Pieces, column: str = "pieces", result: str = "decoded") -> DataFrame:
    """``df`` with the text that every list of pieces stands for."""
    df = without(df, result)
    schema = T.StructType([*df.schema.fields, T.StructField(result, T.StringType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(pieces)
        for batch in batches:
            texts = decode_column(trie, batch.column(column))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, result])

    return modest_batches(df).mapInArrow(run, schema)
