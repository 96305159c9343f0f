"""Token-id files in Simple-8b: 64-bit words whose selector says how many ids of which width they hold.

A file row is a segment: some whole documents in ascending order, their ids packed in blocks of 4,096 and the word offset of
each block, so that any block can be decoded on its own and all words of one selector at once. Ids of more than 60 bits follow an
escape word as they are. Segments are rows of a Parquet table, one Spark file per range of doc_id: Spark's writer commits whole files
or none, on any store, also when executors are lost.

Defined results: a null text is empty, so it has the end id alone; rows without doc_id come first; rows that repeat a doc_id are
ordered by text and all kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.word_ids import word_ids

BLOCK = 4096
SEGMENT = 1 << 16
#: Selector -> (ids in a word, bits of each). Selector 0 is the escape: one id, whole, in the next word.
MODES = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
         (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0
COUNTS = np.array([count for count, _ in MODES], np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit ids."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = (np.frexp(ids.astype(np.float64))[1] if ids.max() < 1 << 53 else
             np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), ids, side="right")).astype(np.uint8)
    # A row per block, with room behind it that takes no bits: a word may be short at a block's end.
    rows = np.zeros((-(-n // BLOCK), BLOCK + MODES[1][0]), np.uint8)
    rows[:, :BLOCK].flat[:n] = width
    widest, selector, ahead = rows[:, :BLOCK].copy(), np.zeros((len(rows), BLOCK), np.uint8), 1
    for mode in range(len(MODES) - 1, 0, -1):  # from few wide ids to many narrow ones, so the fullest word stays
        count, bits = MODES[mode]
        for i in range(ahead, count):
            np.maximum(widest, rows[:, i:i + BLOCK], out=widest)
        ahead, fits = count, widest <= bits
        if not fits.any():
            break
        selector[fits] = mode
    selector = selector.ravel()[:n]
    left = np.tile(np.minimum(np.arange(BLOCK, 0, -1), 255).astype(np.uint8), len(rows))[:n]
    last = n - (len(rows) - 1) * BLOCK
    left[n - last:] = np.minimum(np.arange(last, 0, -1), 255)
    take = np.minimum(COUNTS[selector], left).tobytes()
    starts, at = [], 0
    while at < n:  # a jump per word; everything else is vectorised
        starts.append(at)
        at += take[at]
    starts = np.array(starts)
    chosen = selector[starts]
    slots = np.cumsum(np.where(chosen == ESCAPE, 2, 1))
    place = np.concatenate([[0], slots[:-1]])
    words = np.zeros(slots[-1], np.uint64)
    for mode in np.unique(chosen):
        count, bits = MODES[mode]
        own = starts[chosen == mode]
        if mode == ESCAPE:
            words[place[chosen == mode] + 1] = ids[own]
            continue
        word = np.full(len(own), int(mode) << 60, np.uint64)
        if bits:
            size = np.frombuffer(take, np.uint8)[own]
            full = size.min() == count
            for i in range(count):
                inside = slice(None) if full else i < size
                word[inside] |= ids[own[inside] + i] << np.uint64(i * bits)
        words[place[chosen == mode]] = word
    return words, place[np.searchsorted(starts, np.arange(0, n, BLOCK))]


def unpack(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The ids: all words of a selector are decoded together, each to the place that its block's words before it give."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE):  # an escape's payload is no word of its own; escapes are rare
        raw[at + 1] |= not raw[at]
    heads = np.flatnonzero(~raw)
    counts = np.array([c for c, _ in MODES])[selector[heads]]
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    block = np.searchsorted(blocks, heads, side="right") - 1
    first = np.searchsorted(heads, blocks)
    place = block * BLOCK + before - before[first][block]
    limit = np.minimum((block + 1) * BLOCK, n)
    for mode in np.unique(selector[heads]):
        count, bits = MODES[mode]
        own = selector[heads] == mode
        if mode == ESCAPE:
            out[place[own]] = words[heads[own] + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for i in range(count):
                inside = place[own] + i < limit[own]
                out[place[own][inside] + i] = (words[heads[own][inside]] >> np.uint64(i * bits)) & mask
    return out


def _write(batches: Iterator[pa.RecordBatch], vocabulary, end_id: int) -> Iterator[pa.RecordBatch]:
    known, end = word_ids(vocabulary.value), end_id.to_bytes(4, "little")
    part, start = TaskContext.get().partitionId(), 0
    docs, sizes, ids, held = [], [], [], 0

    def segment() -> pa.RecordBatch:
        words, blocks = pack(np.frombuffer(b"".join(ids), "<u4").astype(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()),
             pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([blocks.tolist()], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary())],
            ["part", "start", "n_ids", "doc_ids", "sizes", "blocks", "words"])

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            for doc, found in zip(some.column(0).to_pylist(), known.encode([t or "" for t in some.column(1).to_pylist()])):
                docs.append(doc)
                sizes.append(len(found) // 4 + 1)
                ids += found, end
                held += sizes[-1]
                if held >= SEGMENT:
                    yield segment()
                    start += held
                    docs, sizes, ids, held = [], [], [], 0
    if held:
        yield segment()


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int = 1, doc_id: str = "doc_id",
                      text: str = "text") -> None:
    """Encodes the texts with the tokenizer file and writes segments in ascending doc_id order under ``folder``."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(
        partial(_write, vocabulary=vocabulary, end_id=end_id),
        "part int, start long, n_ids long, doc_ids array<long>, sizes array<long>, blocks array<long>, words binary"
    ).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            sizes = one.column("sizes")[0].values.to_numpy()
            ids = unpack(np.frombuffer(one.column("words")[0].as_buffer(), np.uint64),
                         one.column("blocks")[0].values.to_numpy(), one.column("n_ids")[0].as_py())
            begins = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [one.column("doc_ids")[0].values, pa.array(begins + one.column("start")[0].as_py() + one.column("base")[0].as_py()),
                 pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(np.append(begins, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64)))],
                ["doc_id", "start", "n_tokens", "ids"])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _read(batches):
        flat, ends = batch.column("ids").values.to_numpy().astype("<u4"), batch.column("ids").offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the number of ids in the files before theirs (one total per file is summed up)."""
    rows = spark.read.parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "part").select(
        "start", "base", "n_ids", "doc_ids", "sizes", "blocks", "words")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document."""
    return _segments(spark, folder).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids array<long>")


def token_file_checks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): ids are checked where they are decoded and don't travel."""
    return _segments(spark, folder).mapInArrow(_checks, "doc_id long, start long, n_tokens long, ids_crc32 long")
