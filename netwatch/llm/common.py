"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_totals(values: Column, block: int = 512) -> Column:
    """For each element of an array of integers the sum of the elements before it, as longs.

    Appending to an array copies it, so a plain fold is quadratic. Totals are built in blocks: within
    blocks first, then over the block sums, which keeps an array of n elements near n * block steps.
    """
    zero = F.lit(0).cast("bigint")
    empty = F.array().cast("array<bigint>")

    def prefix(xs: Column) -> Column:
        start = F.struct(zero.alias("total"), empty.alias("out"))
        return F.aggregate(
            xs, start,
            lambda acc, x: F.struct((acc["total"] + x.cast("bigint")).alias("total"),
                                    F.concat(acc["out"], F.array(acc["total"])).alias("out")))

    def blocks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / F.lit(block)).cast("int"))
        return F.transform(starts, lambda b: prefix(F.slice(xs, b * block + 1, block)))

    def joined(parts: Column) -> Column:
        offsets = prefix(F.transform(parts, lambda p: p["total"]))["out"]
        return let(offsets, lambda off: F.flatten(F.transform(
            parts, lambda p, i: F.transform(p["out"], lambda x: x + off[i]))))

    return F.when(F.size(values) > 0, let(values, lambda xs: let(blocks(xs), joined))).otherwise(empty)


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, so that tables built by one task serve the next."""
    return sys.modules.setdefault("_worker_store", ModuleType("_worker_store")).__dict__
