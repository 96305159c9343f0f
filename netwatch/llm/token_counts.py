"""Token counts of flat, unindexed token files by a separator scan.

A flat file is nothing but ids as little-endian unsigned integers (16 or 32 bits), each document closed by the end id; nothing
says where documents begin. Files are cut into blocks of fixed size without regard to documents. Each block is searched for the end id
as one vector operation, which gives the lengths of the documents that begin and end inside it, and where its first and last
separators stand. A prefix scan over the blocks of a file (one row a block) then carries the last separator and the number of
documents across block borders, so that documents that span blocks are counted whole; a second one over files numbers them.

Files are written by Spark's text writer with the end id as line separator: a row is a document's ids, and the
bytes between are exactly the flat format, committed file by file on any store. Ids 0 and 1 are reserved (padding, end), so a vocabulary's
ids are shifted by two.

Defined results: a null text is empty; an empty document counts one token, its end id; ids after the last separator of a file form an unfinished
document (``ended`` false); empty files have no documents; a trailing partial id is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.common import running_totals
from netwatch.llm.word_ids import word_ids

END_ID, RESERVED = 1, 2
BLOCK_IDS = 1 << 19


def _flat(batches: Iterator[pa.RecordBatch], vocabulary, width: int) -> Iterator[pa.RecordBatch]:
    """Each text's shifted ids as bytes, without the end id."""
    known, most = word_ids(vocabulary.value), (1 << 8 * width) - 1 - RESERVED
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            ids = []
            for found in known.encode([t or "" for t in batch.column(0).slice(at, 128).to_pylist()]):
                x = np.frombuffer(found, "<u4")
                if x.max(initial=0) > most:
                    raise ValueError(f"id {x.max()} does not fit {width} bytes; pass width=4")
                ids.append((x + np.uint32(RESERVED)).astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])


def write_flat_tokens(docs: DataFrame, folder: str, vocabulary_path: str, text: str = "text", width: int = 2) -> None:
    """Flat files of ``width`` bytes an id under ``folder``, in the order of the table's partitions; nothing is shuffled."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    ids = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_flat, vocabulary=vocabulary, width=width), "ids binary")
    ids.select(F.col("ids").cast("string")).write.option("lineSep", END_ID.to_bytes(width, "little").decode()).text(folder)


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids, separators, first and last separator in the file (null without one), and the lengths
    of the documents between separators of the block."""
    for batch in batches:
        rows = []
        for file, block, payload in zip(*(batch.column(i) for i in range(3))):
            data = payload.as_py()
            ids = np.frombuffer(data, f"<u{width}", len(data) // width)
            ends = np.flatnonzero(ids == END_ID) + block.as_py() * BLOCK_IDS
            rows.append((file.as_py(), block.as_py(), len(ids), len(ends), int(ends[0]) if len(ends) else None,
                         int(ends[-1]) if len(ends) else None, np.diff(ends)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())))],
            ["file", "block", "n_ids", "n_ends", "first", "last", "inner"])


def count_flat_tokens(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(file_no, doc_no, start, n_tokens, ended): the documents of all files in order of their names, numbered from 0; start
    counts the ids of all documents before, and n_tokens includes the end id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    step = BLOCK_IDS * width
    starts = F.when(F.col("length") >= width, F.sequence(F.lit(0), ((F.col("length") - 1) / step).cast("int")))
    blocks = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.explode(starts).alias("block")).select(
        "file", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("payload"))
    scanned = blocks.mapInArrow(partial(_scan, width=width), (
        "file string, block long, n_ids long, n_ends long, first long, last long, inner array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.withColumns({
        "previous": F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")),
        "docs_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0).cast("long")),
        "closing": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()})
    open_tail = (F.col("block") * BLOCK_IDS + F.col("n_ids") - 1) - F.coalesce("last", "previous")
    lengths = F.concat(
        F.when(F.col("n_ends") > 0, F.concat(F.array(F.struct((F.col("first") - F.col("previous")).alias("n"), F.lit(True).alias("ended"))),
                                             F.transform("inner", lambda n: F.struct(n.alias("n"), F.lit(True).alias("ended")))))
        .otherwise(F.array().cast("array<struct<n:bigint,ended:boolean>>")),
        F.when(F.col("closing") & (open_tail > 0), F.array(F.struct(open_tail.alias("n"), F.lit(False).alias("ended"))))
        .otherwise(F.array().cast("array<struct<n:bigint,ended:boolean>>")))
    counted = stitched.select("file", "block", "docs_before", F.col("previous").alias("base"), lengths.alias("docs"))
    # One row a file: how many documents and ids stand before it.
    totals = counted.groupBy("file").agg(
        F.sum(F.size("docs")).alias("n_docs"),
        F.sum(F.aggregate("docs", F.lit(0).cast("bigint"), lambda a, d: a + d["n"])).alias("n_ids"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "file", (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"),
        F.coalesce(F.sum("n_docs").over(earlier), F.lit(0)).alias("docs_offset"),
        F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("ids_offset"))
    along = running_totals(F.transform("docs", lambda d: d["n"]))
    return (counted.join(offsets, "file")
            .select("file_no", "docs_offset", "docs_before", (F.col("ids_offset") + F.col("base") + 1).alias("base"), "docs",
                    along.alias("along"))
            .select("file_no", "docs_offset", "docs_before", "base",
                    F.posexplode(F.arrays_zip(F.col("docs").alias("doc"), F.col("along").alias("at"))).alias("i", "x"))
            .select(F.col("file_no").cast("long"), (F.col("docs_offset") + F.col("docs_before") + F.col("i")).alias("doc_no"),
                    (F.col("base") + F.col("x.at")).alias("start"), F.col("x.doc.n").alias("n_tokens"),
                    F.col("x.doc.ended").alias("ended")))
