"""Time-ordered helpers that never sort one key's whole history in one task.

A plain ``lag`` or running sum partitioned by sensor puts a sensor's full history into a single
task. These helpers cut time into blocks: the window function runs inside (key, block), one row per
block is summarised by a partial aggregation, and only those summaries are ordered across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_SECONDS = 3600


def with_block(df: DataFrame, seconds: Column, block_seconds: int, name: str = "_block") -> DataFrame:
    return df.withColumn(name, F.floor(seconds / block_seconds).cast("long"))


def lagged(
    df: DataFrame, keys: Sequence[str], seconds: str, ties: Sequence[str],
    values: Mapping[str, Column], block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Add each named value of the previous row (null on a key's first row).

    ``seconds`` orders the rows, ``ties`` makes the order total.
    """
    order = [seconds, *ties]
    at = [*keys, "_block"]
    rows = with_block(df, F.col(seconds), block_seconds).withColumn(
        "_lag_now", F.struct(*[c.alias(n) for n, c in values.items()]))
    inside = W.partitionBy(*at).orderBy(*order)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({
        "_lag_before": F.lag("_lag_now").over(inside),
        "_lag_first": F.lag(F.lit(True)).over(inside).isNull(),
        "_lag_end": F.last("_lag_now").over(whole)})
    # Only the first rows of blocks look further back, so only they are ordered per key; all other
    # rows stay where they are. Both parts read the shuffle into blocks, which is written once.
    across = W.partitionBy(*keys).orderBy("_block")
    first = rows.where("_lag_first").withColumn("_lag_prev", F.lag("_lag_end").over(across))
    other = rows.where("NOT _lag_first").withColumn("_lag_prev", F.col("_lag_before"))
    return (
        other.unionByName(first)
        .withColumns({n: F.col(f"_lag_prev.{n}") for n in values})
        .drop("_block", "_lag_now", "_lag_before", "_lag_first", "_lag_end", "_lag_prev")
    )


def running(
    df: DataFrame, keys: Sequence[str], seconds: str, ties: Sequence[str],
    sums: Mapping[str, Column] | None = None, maxes: Mapping[str, Column] | None = None,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Add running sums and running maxima from a key's first row up to the current row."""
    sums, maxes = dict(sums or {}), dict(maxes or {})
    at = [*keys, "_block"]
    rows = with_block(df, F.col(seconds), block_seconds).withColumns(
        {f"_v_{n}": c for n, c in (sums | maxes).items()})
    blocks = rows.groupBy(*at).agg(
        *[F.sum(f"_v_{n}").alias(n) for n in sums], *[F.max(f"_v_{n}").alias(n) for n in maxes])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(
        *at,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.max(n).over(earlier).alias(f"_c_{n}") for n in maxes])
    inside = W.partitionBy(*at).orderBy(seconds, *ties).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    added = {n: F.col(f"_c_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
    added |= {n: F.greatest(F.col(f"_c_{n}"), F.max(f"_v_{n}").over(inside)) for n in maxes}
    temporary = ["_block", *[f"_v_{n}" for n in added], *[f"_c_{n}" for n in added]]
    return rows.join(carry, at).withColumns(added).drop(*temporary)


def with_overlap(
    df: DataFrame, seconds: str, reach: int, block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Cut into blocks and repeat the last ``reach`` seconds of a block at the head of the next.

    Rows copied for look-back only have ``_own`` false; drop them after the window function.
    """
    block_seconds = max(block_seconds, reach)
    return (
        df.withColumn("_b", F.floor(F.col(seconds) / block_seconds).cast("long"))
        .withColumn("_block", F.explode(F.array_distinct(F.array(
            F.col("_b"), F.floor((F.col(seconds) + reach) / block_seconds).cast("long")))))
        .withColumn("_own", F.col("_b") == F.col("_block"))
        .drop("_b")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, for any ``n``, without ranking a whole key in one task.

    ``bucket`` is a coarse number that follows the order. Rows are counted per (key, bucket); buckets
    past the wanted rows are dropped before the shuffle that ranks, and each bucket is ranked on its
    own. (Spark's own early rank filter covers only small ``n``.)
    """
    at = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_m"))
    wanted = counts.select(
        *at, (F.lit(n) - F.coalesce(F.sum("_m").over(earlier), F.lit(0))).alias("_left")).where("_left > 0")
    rank = F.row_number().over(W.partitionBy(*at).orderBy(*order))
    return (rows.join(wanted, at).withColumn("_rank", rank).where("_rank <= _left")
            .drop("_bucket", "_left", "_rank"))
