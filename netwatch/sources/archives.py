"""Labelled tables from CSV files, compressed CSV files and (nested) zip archives."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import os
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted names and how deep archives may be nested.
CSV_SUFFIXES = (".csv", ".csv.gz", ".csv.bz2", ".csv.xz")
MAX_DEPTH = 3
ROWS_PER_BATCH = 20000


def is_supported_filename(name: str) -> bool:
    return name.lower().endswith((*CSV_SUFFIXES, ".zip"))


def _open_source(path: str, content: bytes | None):
    if content is not None:
        return io.BytesIO(content)
    return open(unquote(urlparse(path).path), "rb")


def _members(archive: zipfile.ZipFile, chain: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    if len(chain) > MAX_DEPTH:
        raise ValueError("archive nesting is too deep")
    for info in archive.infolist():
        name = info.filename.lower()
        if info.is_dir() or not is_supported_filename(name):
            continue
        if info.flag_bits & 1:
            raise ValueError("password-protected archives are not supported")
        if name.endswith(".zip"):
            with archive.open(info) as inner, zipfile.ZipFile(inner) as nested:
                yield from _members(nested, (*chain, info.filename))
        else:
            yield (*chain, info.filename)


def _stream(handle, chain: Sequence[str], name: str):
    """An open text stream of the innermost file; nothing is unpacked to disk."""
    for member in chain:
        handle = zipfile.ZipFile(handle).open(member)
        name = member
    name = name.lower()
    if name.endswith(".gz"):
        handle = gzip.open(handle)
    elif name.endswith(".bz2"):
        handle = bz2.open(handle)
    elif name.endswith(".xz"):
        handle = lzma.open(handle)
    return io.TextIOWrapper(handle, encoding="utf-8", newline="")


def read_archives(spark: SparkSession, paths: str | Sequence[str], most: int | None = None) -> DataFrame:
    """``(source, row_no, cells)`` of every CSV inside zip or xz files; row 0 is the header. ``most`` stops after that many rows of
    each, so that headers alone can be read without unpacking the rest.

    A first small job lists the members; then each member is its own task and is streamed in
    batches. Where the folder is mounted on the workers only paths travel, no file contents.
    """
    files = spark.read.format("binaryFile").load(paths)
    first = files.select("path").head()
    mounted = first is None or urlparse(first["path"]).scheme in ("", "file")
    columns = ["path"] if mounted else ["path", "content"]

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                content = getattr(row, "content", None)
                if not row.path.lower().endswith(".zip"):
                    found.append((row.path, [], os.path.basename(row.path)))
                    continue
                with _open_source(row.path, content) as handle, zipfile.ZipFile(handle) as archive:
                    found += [(row.path, list(chain), "!".join(chain)) for chain in _members(archive)]
            yield pd.DataFrame(found, columns=["path", "chain", "source"])

    members = files.select(*columns).mapInPandas(
        list_members, "path string, chain array<string>, source string")
    if not mounted:
        members = members.join(files.select("path", "content"), "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                with _open_source(row.path, getattr(row, "content", None)) as handle:
                    chunk = []
                    for number, cells in enumerate(
                            islice(csv.reader(_stream(handle, list(row.chain), row.path)), most)):
                        chunk.append((row.source, number, cells))
                        if len(chunk) == ROWS_PER_BATCH:
                            yield pd.DataFrame(chunk, columns=["source", "row_no", "cells"])
                            chunk = []
                    if chunk:
                        yield pd.DataFrame(chunk, columns=["source", "row_no", "cells"])

    return members.repartition("source").mapInPandas(
        read, "source string, row_no long, cells array<string>")


def _checked(columns: Sequence[Sequence[str]]) -> list[str]:
    first = [c.strip() for c in columns[0]]
    for other in columns[1:]:
        if [c.strip() for c in other] != first:
            raise ValueError(f"feature schema differs between files: {first} / {other}")
    return first


def read_labelled_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All rows of the labelled files as text columns plus ``source``.

    Plain, gzip and bzip2 files go through Spark's CSV reader; xz and zip files through
    ``read_archives``. Column names are trimmed and must agree across files. Inside a folder every file's own
    header is held against the first one's, letter for letter, when its rows are read; a file that differs ends the job with an error
    instead of putting cells into other columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        if not is_supported_filename(path):
            raise ValueError(f"unsupported file name: {path}")
    special = [p for p in paths if p.lower().endswith((".zip", ".xz"))]
    frames, headers = [], []
    for path in (p for p in paths if p not in special):
        frame = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
        headers.append(frame.columns)
        frames.append(frame.toDF(*[c.strip() for c in frame.columns]).withColumn(
            "source", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    if special:
        found = [r["cells"] for r in read_archives(spark, special, 1).select("cells").distinct().collect()]
        if not found:
            raise ValueError("the archives hold no CSV files")
        headers += found
        names, rows = _checked(found), read_archives(spark, special)
        frames.append(rows.where("row_no > 0").select(
            *[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], "source"))
    _checked(headers)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
