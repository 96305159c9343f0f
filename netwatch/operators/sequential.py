"""Order-dependent rules split into independent pieces.

Two tools:

* ``emissions``: "emit unless something was emitted less than ``gap`` seconds ago" per key. The rule
  is sequential, but its effect on one block of time is a small table from entry state to exit state
  (at most one entry per second of ``gap``). Blocks are summarised in parallel, the summaries are
  chained per key, and blocks are replayed in parallel. No task ever holds a key's whole history.
* ``fold_sessions``: rules whose state provably resets after a quiet period run per session, with
  rows streamed in order through constant-size state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import lagged, running


def over_sorted_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[str],
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: T.StructType,
) -> DataFrame:
    """Run ``fn(rows, starts)`` over batches of whole groups, sorted by group and order.

    ``starts`` holds the first row of each group, so ``fn`` can work on many small groups at once
    instead of paying one pandas call per group. Only the group cut by a batch edge is carried over.

    Rows are dealt by a hash of their own: a repartition by the same columns as a join below it is taken
    for redundant, and once that join is turned into a broadcast one, its shuffle is read locally and
    groups fall apart.
    """
    group = list(group)

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        fresh = np.zeros(len(pdf), dtype=bool)
        fresh[:1] = True
        for c in group:
            values = pdf[c].to_numpy(dtype=object)
            null = pd.isna(values)
            fresh[1:] |= (values[1:] != values[:-1]) & ~(null[1:] & null[:-1])
        return np.flatnonzero(fresh)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None or rest.empty else pd.concat([rest, pdf], ignore_index=True)
            starts = starts_of(pdf)
            if len(starts) < 2:
                rest = pdf
                continue
            cut = int(starts[-1])
            yield fn(pdf.iloc[:cut], starts[:-1])
            rest = pdf.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield fn(rest, starts_of(rest))

    return df.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def _next_free(t: np.ndarray, starts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the first event at least ``gap`` later in the same group (-1 if none), the group of
    each row, and times made increasing across groups."""
    of = np.zeros(len(t), dtype=np.int64)
    of[starts[1:]] = 1
    of = np.cumsum(of)
    line = of * (1 << 42) + t
    nxt = np.searchsorted(line, line + gap, side="left")
    ends = np.append(starts[1:], len(t))
    return np.where(nxt < ends[of], nxt, -1), of, line


def emissions(
    times: DataFrame, keys: Sequence[str], t: str = "t", gap: int = 300, block_seconds: int = 86400,
) -> DataFrame:
    """Seconds at which each key emits; ``times`` may hold duplicates, all at or after the epoch."""
    keys = list(keys)
    block_seconds = max(block_seconds, gap)
    field = {f.name: f for f in times.schema.fields}
    key_fields = [field[k] for k in keys]
    at = [*keys, "_block"]
    long = T.LongType()
    at_fields = [*key_fields, T.StructField("_block", long)]
    seconds = times.select(*keys, F.col(t).cast("long").alias("t")).distinct().withColumn(
        "_block", F.floor(F.col("t") / block_seconds).cast("long"))

    def summarise(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Per block: the last emission for every event an entry can begin at."""
        ts = pdf["t"].to_numpy()
        nxt, _, _ = _next_free(ts, starts, gap)
        reach = pdf["_block"].to_numpy() * block_seconds + gap
        entry = np.append(True, ts[:-1] < reach[1:])
        entry[starts] = True
        rows = np.flatnonzero(entry)
        last = rows.copy()
        while (ahead := nxt[last]).max() >= 0:
            last = np.where(ahead >= 0, ahead, last)
        return pdf.iloc[rows][at].assign(_entry=ts[rows], _exit=ts[last])

    summaries = over_sorted_groups(seconds, at, ["t"], summarise, T.StructType(
        [*at_fields, T.StructField("_entry", long), T.StructField("_exit", long)]))

    def chain(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Walk each key's blocks in order and note from when each block may emit."""
        block, entry, leave = (pdf[c].to_numpy() for c in ("_block", "_entry", "_exit"))
        first = np.append(True, block[1:] != block[:-1])
        first[starts] = True
        heads = np.flatnonzero(first)
        bounds = np.append(heads, len(pdf))
        opens, free_from, out = set(starts.tolist()), 0, []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if int(lo) in opens:
                free_from = 0
            out.append(free_from)
            i = lo + int(np.searchsorted(entry[lo:hi], free_from, side="left"))
            if i < hi:
                free_from = int(leave[i]) + gap
        return pdf.iloc[heads][at].assign(_free_from=np.asarray(out, dtype=np.int64))

    chained = over_sorted_groups(summaries, keys, ["_block", "_entry"], chain, T.StructType(
        [*at_fields, T.StructField("_free_from", long)]))

    def replay(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The first row of each block is its ``_free_from``, its seconds follow."""
        free_from = pdf["_at"].to_numpy()[starts]
        pdf = pdf[pdf["_second"].to_numpy()]
        ts, starts = pdf["_at"].to_numpy(), starts - np.arange(len(starts))
        nxt, of, line = _next_free(ts, starts, gap)
        begin = np.arange(len(starts)) * (1 << 42) + free_from
        now = np.searchsorted(line, begin, side="left")
        now = now[now < np.append(starts[1:], len(ts))]
        kept = np.zeros(len(ts), dtype=bool)
        while len(now):
            kept[now] = True
            now = nxt[now]
            now = now[now >= 0]
        return pdf.loc[kept, [*keys, "_at"]].rename(columns={"_at": "t"})

    both = seconds.select(*at, F.lit(True).alias("_second"), F.col("t").alias("_at")).unionByName(
        chained.select(*at, F.lit(False).alias("_second"), F.col("_free_from").alias("_at")))
    return over_sorted_groups(both, at, ["_second", "_at"], replay, T.StructType(
        [*key_fields, T.StructField("t", long)])).withColumnRenamed("t", t)


def with_sessions(df: DataFrame, keys: Sequence[str], seconds: str, ties: Sequence[str],
                  quiet: int) -> DataFrame:
    """Add ``_session``: the second at which the current run without a gap >= ``quiet`` began."""
    rows = lagged(df, keys, seconds, ties, {"_before": F.col(seconds)}, 86400)
    fresh = F.col("_before").isNull() | (F.col(seconds) - F.col("_before") >= quiet)
    return running(rows, keys, seconds, ties,
                   maxes={"_session": F.when(fresh, F.col(seconds))}, block_seconds=86400).drop("_before")


def fold_sessions(
    df: DataFrame, keys: Sequence[str], seconds: str, ties: Sequence[str], quiet: int,
    outputs: Sequence[T.StructField], start: Callable[[], object],
    step: Callable[[object, dict], tuple], inputs: Sequence[str],
) -> DataFrame:
    """Run ``step(state, row)`` over each session in time order and add its results as columns.

    A partition streams its sorted sessions batch by batch; only the current state is kept.
    """
    keys = list(keys)
    rows = with_sessions(df, keys, seconds, ties, quiet)
    ordered = rows.repartition(*keys, "_session").sortWithinPartitions(
        *keys, "_session", seconds, *ties)
    schema = T.StructType([f for f in ordered.schema.fields if f.name != "_session"] + list(outputs))
    names = [f.name for f in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            results = []
            for row in pdf[[*keys, "_session", *inputs]].itertuples(index=False, name=None):
                session = row[:len(keys) + 1]
                if session != current:
                    current, state = session, start()
                results.append(step(state, dict(zip(inputs, row[len(keys) + 1:]))))
            added = pd.DataFrame(results, columns=names, index=pdf.index)
            yield pd.concat([pdf.drop(columns="_session"), added], axis=1)

    return ordered.mapInPandas(run, schema)
