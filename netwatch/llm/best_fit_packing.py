"""Packing of documents into sequences of a fixed number of tokens, as few as possible, by linear grouping.

Lengths of pieces lie between 1 and the capacity, so a histogram of them has a fixed size, however many documents there are. On it
the driver works out a plan of fixed size, and Spark carries the plan out on the pieces:

1. Pieces longer than an eighth of the capacity are large. In descending order they are cut into groups of equal cardinality, and each
   length is rounded up to the largest of its group. That leaves few sizes.
2. For those the best mix of configurations (which sizes share a sequence) is a linear programme over all fitting configurations,
   solved by column generation: a knapsack finds the configuration that improves the mix most, until none does. Whole numbers of each
   configuration are used, and what they leave over (fewer pieces than sizes in a sequence times sizes) is put best-fit, longest first.
3. Real pieces take the slots of their group. They are at most as long, so they fit; their true lengths give the room left.
4. Small pieces go best-fit, longest first, into that room, then into new sequences. As equal lengths and equal rooms are
   handled together, this too is a plan over histograms.

A piece's place in the order is its number within its length. Numbers are given inside the task that writes the piece and shifted by
what other tasks hold of that length, so a length that a third of all pieces have is never ordered in one task.

Defined results: a null text is empty, so it is the end id alone; rows without doc_id and rows that repeat one are packed like
all others; an empty table has no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.word_ids import word_ids
from netwatch.session import written

CAPACITY, SIZES, LARGE = 4096, 64, 8
#: Open sequences are numbered in stretches of this many, so that no task orders all of a room.
_STRETCH = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """A row for each piece; ``nth`` numbers the pieces of one length within the task."""
    encoder, end = word_ids(vocabulary.value), end_id.to_bytes(4, "little")
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
    names = [field.split()[0] for field in PIECES.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some, rows = batch.slice(at, 128), []
            texts = [t or "" for t in some.column(1).to_pylist()]
            for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(texts)):
                ids += end
                for number, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[begin:begin + 4 * capacity]
                    length = len(own) // 4
                    rows.append((doc, number, begin // 4, length, zlib.crc32(own), part, seen[length], *[own] * with_ids))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def document_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id",
                    text: str = "text", with_ids: bool = False) -> DataFrame:
    """Texts as ids with the end id behind, cut only where they are longer than the capacity. ``with_ids`` adds the piece's ids as
    little-endian 32-bit integers."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        partial(_pieces, vocabulary=vocabulary, end_id=end_id, capacity=capacity, with_ids=with_ids),
        PIECES + ", ids binary" * with_ids)


def _fullest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest price: an unbounded knapsack, one layer of values for each piece it may hold."""
    best = np.zeros(capacity + 1)
    layers = []
    for _ in range(capacity // int(sizes.min())):
        value, pick = best.copy(), np.full(capacity + 1, -1)
        for j in np.flatnonzero(prices > 0):
            held = best[:-sizes[j]] + prices[j]
            better = held > value[sizes[j]:] + 1e-12
            value[sizes[j]:][better] = held[better]
            pick[sizes[j]:][better] = j
        layers.append(pick)
        best = value
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(layers):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, number of such sequences) that hold the demand exactly."""
    found: list[tuple[np.ndarray, int]] = []
    if not len(sizes):
        return found
    columns = np.diag(capacity // sizes).astype(float)  # to begin with, sequences of one size
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        times = np.maximum(inverse @ demand, 0)
        prices = inverse.sum(axis=0)
        fullest = _fullest(sizes, prices, capacity)
        if prices @ fullest <= 1 + 1e-7:
            break
        step = inverse @ fullest
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, ratio.argmin()] = fullest
    left = demand.copy()
    whole = np.floor(np.maximum(np.linalg.solve(columns, demand), 0) + 1e-9).astype(np.int64)
    for counts, number in zip(columns.T.round().astype(np.int64), whole):
        fits = counts > 0
        number = min(int(number), int((left[fits] // counts[fits]).min())) if fits.any() else 0
        if number:
            found.append((counts, number))
            left -= counts * number
    open_: list[list] = []  # room, counts
    for j in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[j])):
            fitting = [o for o in open_ if o[0] >= sizes[j]]
            slot = min(fitting, key=lambda o: o[0]) if fitting else [capacity, np.zeros(len(sizes), np.int64)]
            if not fitting:
                open_.append(slot)
            slot[0] -= sizes[j]
            slot[1][j] += 1
    return found + [(counts, 1) for _, counts in open_]


class Plan:
    """Stretches of the order of pieces and the sequences they go to: pieces ``first[i]`` on go to sequence ``to[i]`` on,
    ``each[i]`` to one."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def add(self, first: int, to: int, each: int) -> None:
        self.rows.append((first, to, each))

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.rows) or [(0, 0, 1)], np.int64).T


def plan_large(lengths: np.ndarray, counts: np.ndarray, capacity: int, sizes: int = SIZES) -> tuple[Plan, int]:
    """Slots of large pieces, numbered by descending length, and the number of sequences."""
    total, plan = int(counts.sum()), Plan()
    if not total:
        return plan, 0
    order = np.argsort(-lengths)
    lengths, ends = lengths[order], np.cumsum(counts[order])
    share = -(-total // sizes)
    starts = np.arange(0, total, share)
    rounded = lengths[np.searchsorted(ends, starts, side="right")]
    distinct, group = np.unique(-rounded, return_inverse=True)  # groups of one rounded length are one
    first = np.array([starts[group == g].min() for g in range(len(distinct))])
    demand = np.diff(np.append(first, total))
    place, used = first.copy(), 0
    for each, number in configurations(-distinct, demand, capacity):
        for g in np.flatnonzero(each):
            plan.add(int(place[g]), used, int(each[g]))
            place[g] += each[g] * number
        used += number
    return plan, used


def plan_small(rooms: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Best fit of small pieces, numbered by descending length. ``rooms[r]`` sequences have room r; sequences are
    numbered by ascending room, and new ones go on from there."""
    plan = Plan()
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # of each room: (first sequence, number)
    filled = 0  # bit r: some sequence has room r
    used = 0
    for room, number in enumerate(rooms.tolist()):
        if number:
            open_[room].append((used, number))
            filled |= 1 << room
        used += number
    at = 0
    for i in np.argsort(-lengths):
        length, left = int(lengths[i]), int(counts[i])
        while left:
            fits = filled >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
            else:
                room, number = capacity, -(-left // (capacity // length))
                open_[room].append((used, number))
                filled |= 1 << room
                used += number
            start, number = open_[room].pop()
            each = min(room // length, left)
            take = min(number, left // each)
            plan.add(at, start, each)
            at += take * each
            left -= take * each
            if number > take:
                open_[room].append((start + take, number - take))
            if not open_[room]:
                filled &= ~(1 << room)
            rest = room - take * each * length // take
            open_[rest].append((start, take))
            filled |= 1 << rest
    return plan


def _assign(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """Replaces ``place``, a number in the plan's order, by the sequence that the plan sends it to."""
    first, to, each = plan.value
    for batch in batches:
        place = batch.column("place").to_numpy()
        i = np.searchsorted(first, place, side="right") - 1
        sequence = to[i] + (place - first[i]) // each[i]
        yield batch.set_column(batch.schema.get_field_index("place"), "place", pa.array(sequence, pa.int64()))


def _numbered(rows: DataFrame, what: str, part: str, nth: str) -> DataFrame:
    """``place``: numbers from 0 within each value of ``what``, from numbers within (value, part)."""
    sizes = rows.groupBy(what, part).agg((F.max(nth) + 1).alias("_n"))
    before = Window.partitionBy(what).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(what, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(base, [what, part]).withColumn("place", F.col("_base") + F.col(nth)).drop("_base")


def _placed(rows: DataFrame, value: str, starts: np.ndarray, plan: Plan | None) -> DataFrame:
    """Adds the start of the row's value to ``place``, and sends the sum through the plan."""
    context = rows.sparkSession.sparkContext
    table = F.array(*[F.lit(int(s)) for s in starts])
    moved = rows.withColumn("place", F.get(table, F.col(value).cast("int")).cast("long") + F.col("place"))
    if plan is None:
        return moved
    return moved.mapInArrow(partial(_assign, plan=context.broadcast(plan.arrays())), moved.schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, sizes: int = SIZES) -> DataFrame:
    """``pieces`` (a written table, see ``document_pieces``) with sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    lengths = np.arange(capacity + 1)
    large = (lengths > capacity // LARGE) & (counts > 0)
    small = ~large & (counts > 0)
    numbered = _numbered(pieces, "length", "part", "nth")
    longer = lambda kind: np.where(kind, np.where(kind, counts, 0)[::-1].cumsum()[::-1] - counts, 0)

    plan, used = plan_large(lengths[large], counts[large], capacity, sizes)
    slots = written(_placed(numbered.where(F.col("length") > capacity // LARGE), "length", longer(large), plan), "slots")
    # Sequences in the order of the room that the real lengths leave, each room numbered in stretches.
    rooms = slots.groupBy("place").agg((F.lit(capacity) - F.sum("length")).alias("room")).withColumn(
        "stretch", F.floor(F.col("place") / _STRETCH))
    rooms = written(rooms.withColumn("nth", (F.row_number().over(
        Window.partitionBy("room", "stretch").orderBy("place")) - 1).cast("long")).withColumnRenamed("place", "slot"), "rooms")
    left = np.zeros(capacity + 1, np.int64)
    for row in rooms.groupBy("room").count().collect():  # at most ``capacity`` rows
        left[row["room"]] = row["count"]
    order = _placed(_numbered(rooms, "room", "stretch", "nth"), "room", left.cumsum() - left, None)
    full = slots.withColumnRenamed("place", "slot").join(order.select("slot", "place"), "slot").drop("slot")
    rest = _placed(numbered.where(F.col("length") <= capacity // LARGE), "length", longer(small),
                   plan_small(left, lengths[small], counts[small], capacity))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "nth").rowsBetween(
        Window.unboundedPreceding, -1)
    return (full.unionByName(rest).withColumnRenamed("place", "sequence_id")
            .withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))
            .drop("part", "nth"))


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, sizes: int = SIZES, end_id: int = 1,
                   doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset: where each piece of each document goes."""
    pieces = written(document_pieces(docs, vocabulary_path, capacity, end_id, doc_id, text, with_ids), "pieces")
    return pack_pieces(pieces, capacity, sizes)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, starts, ids) of pieces packed with their ids: what a trainer reads. Starts are the places
    where documents begin; a sequence holds ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"),
                    F.unhex(F.array_join("parts.ids", "")).alias("ids")))
