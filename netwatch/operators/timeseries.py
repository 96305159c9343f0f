"""Baselines, trailing windows and sustained conditions over metric samples.

Samples carry ``sec`` (whole epoch seconds, bigint), a tie-breaking id and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .ordered import BLOCK_SECONDS, first_per_key, lagged, running, with_block, with_overlap
from .sequential import over_sorted_groups

# Observations kept by a baseline, fewest that allow a verdict, z limit.
BASELINE_LENGTH = 86400
MIN_OBSERVATIONS = 10
Z_LIMIT = 3.0


def _limbs(x: Column) -> dict[str, Column]:
    """A double as two whole numbers, in units of 2^-30 and 2^-60, whose sums are exact."""
    high = F.floor(x * 2.0**30)
    return {"h": F.coalesce(high, F.lit(0)), "l": F.coalesce(F.floor((x * 2.0**30 - high) * 2.0**30), F.lit(0))}


def _trailing(
    samples: DataFrame, keys: Sequence[str], ties: Sequence[str], length: int, prior: bool,
    block_seconds: int,
) -> DataFrame:
    """Mean and population deviation of the last ``length`` observations per row.

    A sliding frame of 86,400 rows would cost that many steps per row and one task per metric.
    Prefix sums make it one subtraction: each row meets the first row of its frame in a grouping by
    row number, which spreads evenly over tasks. Values are centred and scaled per key, so that their squares add up
    to the number of rows, and summed as exact whole numbers; neither the level of the values nor the length of
    the history (up to 2^32 rows a key) costs precision. A frame is flat if no value in it differs from the one before,
    which is counted, not estimated. All rows are shuffled by key and time block, then by key and row number; only one row
    a block is ordered across blocks.
    """
    keys = list(keys)
    at = [*keys, "_block"]
    v = F.col("value").cast("double")
    base = with_block(samples, F.col("sec"), block_seconds)
    whole = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    over_key = lambda c: F.sum(c).over(whole)
    scale = base.groupBy(*at).agg(F.count(v).alias("_n"), F.avg(v).alias("_avg"), F.var_pop(v).alias("_var"))
    scale = scale.withColumn("_centre", over_key(F.col("_n") * F.col("_avg")) / F.nullif(over_key(F.col("_n")), F.lit(0)))
    off = F.col("_avg") - F.col("_centre")
    unit = F.sqrt(over_key(F.col("_n") * (F.col("_var") + off * off)) / F.nullif(over_key(F.col("_n")), F.lit(0)))
    scale = scale.withColumn("_unit", unit).select(
        *at, "_centre", F.when(F.col("_unit") > 0, F.col("_unit")).otherwise(F.lit(1.0)).alias("_unit"))
    inside = W.partitionBy(*at).orderBy("sec", *ties)
    z = (v - F.col("_centre")) / F.col("_unit")
    rows = base.join(scale, at).withColumns({
        "_z": F.when(F.abs(z) < 2.0**16, z), "_last": F.lag(v).over(inside), "_first": F.row_number().over(inside) == 1})
    own = {f"_{n}{k}": c for n, x in (("s", F.col("_z")), ("q", F.col("_z") * F.col("_z"))) for k, c in _limbs(x).items()}
    rows = rows.withColumns(own | {"_rn": F.lit(1).cast("long"), "_turns": (v != F.col("_last")).cast("long")})
    sums = [*own, "_rn", "_turns"]
    # The first value of a block is compared with the last of the block before, among the blocks' summaries.
    blocks = rows.groupBy(*at).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums], F.max(v).alias("_top"), F.min(v).alias("_low"),
        F.max(F.struct("sec", *ties, v.alias("_v")))["_v"].alias("_end"), F.max(F.when(F.col("_first"), v)).alias("_start"))
    across = W.partitionBy(*keys).orderBy("_block")
    blocks = blocks.withColumn("_before", F.lag("_end").over(across)).withColumn(
        "_turns", F.col("_turns") + F.coalesce((F.col("_start") != F.col("_before")).cast("long"), F.lit(0)))
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(*at, "_before", F.sum("_rn").over(whole).alias("_all"),
                          *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c{n}") for n in sums],
                          F.max("_top").over(earlier).alias("_c_hi"), F.min("_low").over(earlier).alias("_c_lo"))
    rows = rows.join(carry, at).withColumns({
        "_last": F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_last"))}).withColumn(
        "_turn", F.coalesce((v != F.col("_last")).cast("long"), F.lit(0)))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = {n: F.col("_turn" if n == "_turns" else n) for n in sums}
    rows = rows.withColumns({f"_to{n}": F.col(f"_c{n}") + F.sum(c).over(upto) for n, c in step.items()} | {
        "_hi": F.greatest("_c_hi", F.max(v).over(upto)), "_lo": F.least("_c_lo", F.min(v).over(upto))})
    ended = F.struct(*[(F.col(f"_to{n}") - (step[n] if prior else F.lit(0))).alias(n) for n in sums])
    before = F.struct(*[(F.col(f"_to{n}") - (F.lit(0) if n == "_turns" else step[n])).alias(n) for n in sums])
    reach = length - (0 if prior else 1)
    full = F.struct(*samples.columns, "_centre", "_unit", "_last", "_hi", "_lo", ended.alias("_to"))
    # A row goes to its own number, and as the start of a frame to the number of the row whose frame it starts.
    place = F.array(F.struct(F.col("_to_rn").alias("at"), full.alias("row"), F.when(F.lit(False), before).alias("start")),
                    F.struct((F.col("_to_rn") + reach).alias("at"), F.when(F.lit(False), full).alias("row"), before.alias("start")))
    own_only = F.col("_to_rn") + reach > F.col("_all")
    place = F.when(own_only, F.slice(place, 1, 1)).otherwise(place)
    met = (rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(place).alias("_p"))
           .groupBy(*[f"_k{i}" for i in range(len(keys))], F.col("_p.at").alias("_at"))
           .agg(F.first("_p.row", True).alias("_row"), F.first("_p.start", True).alias("_start")))
    of = lambda n: F.col(f"_row._to.{n}") - F.coalesce(F.col(f"_start.{n}"), F.lit(0))
    number = lambda n: (of(f"_{n}h").cast("double") + of(f"_{n}l") / 2.0**30) / 2.0**30
    n = F.nullif(F.least(F.col("_row._to._rn"), F.lit(length)), F.lit(0))
    mean = number("s") / n
    spread = F.greatest(number("q") / n - mean * mean, F.lit(0.0))
    centre, unit, flat = F.col("_row._centre"), F.col("_row._unit"), of("_turns") == 0
    level = F.col("_row._last") if prior else F.col("_row.value").cast("double")
    some = n.isNotNull()
    return met.select(
        *[F.col(f"_row.{c}").alias(c) for c in samples.columns], F.col("_row._to._rn").alias("_rn"),
        F.col("_row._hi").alias("_hi"), F.col("_row._lo").alias("_lo"),
        F.when(some, F.when(flat, level).otherwise(centre + unit * mean)).alias("_mean"),
        F.when(some, F.when(flat, F.lit(0.0)).otherwise(unit * F.sqrt(spread))).alias("_std"))


def rolling_baseline(
    samples: DataFrame, keys: Sequence[str] = ("metric",), ties: Sequence[str] = ("sample_id",),
    length: int = BASELINE_LENGTH, block_seconds: int = BLOCK_SECONDS, digits: int = 4,
) -> DataFrame:
    """The baseline as it stands after each observation."""
    rows = _trailing(samples, keys, ties, length, False, block_seconds)
    return rows.select(
        *samples.columns, F.round("_mean", digits).alias("mean"), F.round("_std", digits).alias("std"),
        F.round("_lo", digits).alias("min"), F.round("_hi", digits).alias("max"),
        F.col("_rn").alias("count"))


def baseline_anomaly(
    samples: DataFrame, keys: Sequence[str] = ("metric",), ties: Sequence[str] = ("sample_id",),
    z_limit: float = Z_LIMIT, length: int = BASELINE_LENGTH, block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Compare each observation with the baseline before it."""
    rows = _trailing(samples, keys, ties, length, True, block_seconds)
    flat = F.col("_std") == 0
    z = F.when(flat | F.col("_std").isNull(), F.lit(0.0)).otherwise(
        (F.col("value") - F.col("_mean")) / F.col("_std"))
    off_mean = F.col("value") != F.col("_mean")
    return rows.select(
        *samples.columns, F.col("_rn").alias("prior_count"), z.alias("z_score"),
        F.when(F.col("_rn") < MIN_OBSERVATIONS, F.lit(False)).when(flat, off_mean)
        .otherwise(F.abs(z) > z_limit).alias("is_anomalous"))


def _profile(samples: DataFrame, keys: list[str], ties: Sequence[str], length: int) -> DataFrame:
    ever = samples.groupBy(*keys).agg(
        F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"),
        F.count(F.lit(1)).alias("count"))
    newest = [F.desc("sec"), *[F.desc(t) for t in ties]]
    hours_back = -F.floor(F.col("sec") / 3600)
    recent = (
        first_per_key(samples, keys, hours_back, newest, length)
        .groupBy(*keys).agg(F.round(F.avg("value"), 4).alias("mean"),
                            F.round(F.stddev_pop("value"), 4).alias("std")))
    return ever.join(recent, keys)


def baseline_snapshot(samples: DataFrame, keys: Sequence[str] = ("metric",),
                      ties: Sequence[str] = ("sample_id",), length: int = BASELINE_LENGTH) -> DataFrame:
    """Current baseline per key: recent mean and deviation, all-time extremes and count."""
    return _profile(samples, list(keys), ties, length)


def hourly_profile(samples: DataFrame, keys: Sequence[str] = ("metric",),
                   ties: Sequence[str] = ("sample_id",), length: int = BASELINE_LENGTH) -> DataFrame:
    """The same statistics per hour of day (UTC)."""
    by_hour = samples.withColumn("hour", F.expr("pmod(CAST(floor(sec / 3600) AS BIGINT), 24)"))
    return _profile(by_hour, [*keys, "hour"], ties, length)


def trailing_stats(
    samples: DataFrame, keys: Sequence[str], seconds: int = 300, block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Trailing mean and maximum over ``[t - seconds, t]`` for every second with a sample."""
    keys = list(keys)
    per_second = samples.groupBy(*keys, "sec").agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n"), F.max("value").alias("_m"))
    frame = W.partitionBy(*keys, "_block").orderBy("sec").rangeBetween(-seconds, 0)
    return (
        with_overlap(per_second, "sec", seconds, block_seconds)
        .withColumns({"avg_value": F.sum("_s").over(frame) / F.sum("_n").over(frame),
                      "max_value": F.max("_m").over(frame)})
        .where("_own").select(*keys, "sec", "avg_value", "max_value"))


def windowed_percentile(
    samples: DataFrame, keys: Sequence[str], q: float = 0.95, window: int = 300,
    slide: int | None = None,
) -> DataFrame:
    """Exact percentile per window; equal values are counted before they are ranked."""
    keys, slide = list(keys), slide or window
    pane = F.expr(f"sec - pmod(sec, {slide})")
    counted = samples.groupBy(*keys, pane.alias("_pane"), "value").agg(F.count(F.lit(1)).alias("n"))
    starts = F.explode(F.sequence(F.col("_pane") - (window - slide), F.col("_pane"), F.lit(slide)))
    return (
        counted.select(*keys, "value", "n", starts.alias("window_start"))
        .groupBy(*keys, "window_start", "value").agg(F.sum("n").alias("n"))
        .groupBy(*keys, "window_start")
        .agg(F.percentile("value", q, F.col("n")).alias("percentile"), F.sum("n").alias("samples")))


def _sliding_percentile(sec: np.ndarray, value: np.ndarray, n: np.ndarray, q: float, seconds: int) -> tuple[
        np.ndarray, np.ndarray, np.ndarray]:
    """(second, percentile, samples) for each second of rows in time order.

    Distinct values have a place each, in order, and places form cells of about a root of their number. A row adds its count to place and cell
    when it enters the window and takes it away when it leaves; running sums over cells and inside one cell find a rank.
    """
    levels, place = np.unique(value, return_inverse=True)
    width = max(1, int(len(levels) ** 0.5))
    counts = np.zeros((-(-len(levels) // width), width), np.int64)
    flat, cells = counts.reshape(-1), np.zeros(len(counts), np.int64)
    first = np.flatnonzero(np.append(True, sec[1:] != sec[:-1]))
    ends, at = np.append(first[1:], len(sec)), sec[first]
    gone = np.append(first, len(sec))[np.searchsorted(at, at - seconds)]
    out, samples, total, left = np.empty(len(first)), np.empty(len(first), np.int64), 0, 0

    def change(lo: int, hi: int, sign: int) -> int:
        np.add.at(flat, place[lo:hi], sign * n[lo:hi])
        np.add.at(cells, place[lo:hi] // width, sign * n[lo:hi])
        return sign * int(n[lo:hi].sum())

    def ranked(rank: int, sums: np.ndarray) -> float:
        cell = int(np.searchsorted(sums, rank, side="right"))
        inside = rank - (int(sums[cell - 1]) if cell else 0)
        return levels[cell * width + int(np.searchsorted(np.cumsum(counts[cell]), inside, side="right"))]

    for k, (lo, hi, keep) in enumerate(zip(first.tolist(), ends.tolist(), gone.tolist())):
        total += change(lo, hi, 1)
        if keep > left:
            total += change(left, keep, -1)
            left = keep
        rank, sums = q * (total - 1), np.cumsum(cells)
        low = ranked(int(rank), sums)
        part = rank - int(rank)
        out[k] = low + (ranked(int(rank) + 1, sums) - low) * part if part else low
        samples[k] = total
    return at, out, samples


def trailing_percentile(
    samples: DataFrame, keys: Sequence[str], q: float = 0.95, seconds: int = 300, block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Exact percentile over ``[t - seconds, t]`` for every second ``t`` with a sample, interpolated between ranks.

    Equal values of a second are counted first. Time blocks with overlap are independent, so one key's history spreads over tasks; a
    task holds the distinct (second, value) rows of one block of one key, and ``block_seconds`` bounds that. Null values and
    null seconds are no samples; null keys are a key of their own.
    """
    keys = list(keys)
    counted = samples.where(F.col("value").isNotNull() & F.col("sec").isNotNull()).groupBy(
        *keys, F.col("sec").cast("long").alias("sec"), F.col("value").cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = with_overlap(counted, "sec", seconds, block_seconds)
    schema = T.StructType([*[counted.schema[k] for k in keys], T.StructField("sec", T.LongType()),
                           T.StructField("percentile", T.DoubleType()), T.StructField("samples", T.LongType())])

    def slide(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """All groups on one line of time, too far apart to share a window."""
        sec = pdf["sec"].to_numpy()
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        begin = sec[starts][group]
        length = int((sec - begin).max(initial=0)) + seconds + 1
        line = group * length + (sec - begin)
        at, found, total = _sliding_percentile(line, pdf["value"].to_numpy(), pdf["n"].to_numpy(), q, seconds)
        where = np.searchsorted(line, at)
        own = pdf["_own"].to_numpy(dtype=bool)[where]
        where = where[own]
        return pdf.iloc[where][[*keys, "sec"]].assign(percentile=found[own], samples=total[own])

    return over_sorted_groups(rows, [*keys, "_block"], ["sec", "value"], slide, schema)


def sustained_condition(
    samples: DataFrame, condition: Column, hold_seconds: int, keys: Sequence[str],
    ties: Sequence[str] = ("sample_id",), block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Runs of consecutive samples for which the condition holds, and when each run fired.

    A run fires at its first sample at least ``hold_seconds`` after its start; ``fired_at`` is null
    for runs that ended earlier.
    """
    keys = list(keys)
    rows = samples.select(*keys, "sec", *ties, F.coalesce(condition, F.lit(False)).alias("_on"))
    rows = lagged(rows, keys, "sec", ties, {"_was": F.col("_on")}, block_seconds)
    starts = F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    # A start marker grows with time and tie id, so the latest start is a running maximum.
    rows = running(rows, keys, "sec", ties,
                   maxes={"_start": F.when(starts, F.struct("sec", *ties))},
                   block_seconds=block_seconds)
    held = F.col("sec") - F.col("_start.sec")
    return (
        rows.where("_on").groupBy(*keys, "_start")
        .agg(F.max("sec").alias("end_sec"), F.count(F.lit(1)).alias("samples"),
             F.min(F.when(held >= hold_seconds, F.col("sec"))).alias("fired_at"))
        .select(*keys, F.col("_start.sec").alias("start_sec"), "end_sec", "samples", "fired_at"))


def sustained_alerts(samples: DataFrame, keys: Sequence[str], ties: Sequence[str] = ("sample_id",),
                     rules=None, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Firing runs of every standing rule (name, metric, limit, seconds, severity)."""
    out = None
    for name, metric, limit, hold, severity in rules or K.SUSTAINED_RULES:
        runs = sustained_condition(
            samples.where(F.col("metric") == metric), F.col("value") > limit, hold, keys, ties,
            block_seconds)
        runs = runs.where("fired_at IS NOT NULL").withColumns(
            {"rule": F.lit(name), "severity": F.lit(severity)})
        out = runs if out is None else out.unionByName(runs)
    return out


def sla_status(samples: DataFrame, ties: Sequence[str] = ("sample_id",), last: int = 1000) -> DataFrame:
    """Mean of the last measurements of each service level against its target."""
    targets = samples.sparkSession.createDataFrame(
        K.SLA_TARGETS, "metric string, target double, lower_is_better boolean")
    newest = W.partitionBy("metric").orderBy(F.desc("sec"), *[F.desc(t) for t in ties])
    means = (
        samples.where(F.col("metric").isin([m for m, _, _ in K.SLA_TARGETS]))
        .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
        .groupBy("metric").agg(F.avg("value").alias("_mean")))
    mean = F.coalesce("_mean", F.lit(0.0))
    return targets.join(means, "metric", "left").select(
        "metric", "target", F.round(mean, 4).alias("current"),
        F.when(F.col("lower_is_better"), mean <= F.col("target")).otherwise(mean >= F.col("target"))
        .alias("met"))


def idle_periods(packets: DataFrame, idle_seconds: int = 10, keys: Sequence[str] = ("sensor_id",),
                 block_seconds: int = 86400) -> DataFrame:
    """Gaps of more than ``idle_seconds`` without a packet. Packets shrink to one row per second."""
    seconds = packets.groupBy(*keys, F.unix_seconds("ts").alias("sec")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    rows = lagged(seconds, keys, "sec", [], {"_before": F.col("_last")}, block_seconds)
    gap = F.unix_micros("_first") - F.unix_micros("_before")
    return rows.where(gap > idle_seconds * 1_000_000).select(
        *keys, F.col("_before").alias("idle_from"), F.col("_first").alias("idle_until"),
        (gap / 1e6).alias("idle_seconds"))


# --- keyed feature store as an append-only table ------------------------------------------------

def latest_features(entries: DataFrame, as_of: Column | int, ttl_seconds: float | None = None,
                    prefix: str = "", order: Sequence[str] = ("sec",)) -> DataFrame:
    """Newest unexpired row per key. An entry is expired when older than its time to live.

    If a key's newest entry is expired, so are all others; so expired rows go before the grouping, where the filter
    reaches the scan. ``order`` starts with the entry's second."""
    ttl = F.lit(float(ttl_seconds or 3600))
    rows = entries.where(F.col("key").startswith(prefix)) if prefix else entries
    others = [c for c in entries.columns if c != "key"]
    return (
        rows.where(as_of - F.col("sec") <= ttl)
        .groupBy("key").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_e"))
        .select("key", "_e.*"))


def feature_history(entries: DataFrame, limit: int = 60, kept: int = 100,
                    order: Sequence[str] = ("sec",)) -> DataFrame:
    """The last rows of each key; ``position`` counts from the oldest returned row."""
    newest = W.partitionBy("key").orderBy(*[F.desc(c) for c in order])
    rows = entries.withColumn("_rn", F.row_number().over(newest)).where(
        F.col("_rn") <= min(limit, kept))
    return rows.withColumn("position", F.row_number().over(
        W.partitionBy("key").orderBy(F.desc("_rn")))).drop("_rn")


def traffic_history(rows: DataFrame, order: Sequence[str] = ("sec",), limit: int = 120,
                    kept: int = 500) -> DataFrame:
    """The newest rows overall (a distributed top-k)."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(min(limit, kept))
