"""Packets to feature vectors.

A window's measures come from two aggregations over the same packets:

* additive measures, one partial-aggregated row per window;
* value counts of six dimensions (source, target, their ports, the address pair and ttl), one
  ``GROUPING SETS`` pass whose map-side combine collapses a flood to few rows, followed by
  distinct counts and entropies per window.

No ``count(DISTINCT ...)`` is used, so there is no extra expansion and no per-window set in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import FEATURE_ORDER, MEASURES

# TCP flag bits and size limits.
SYN, ACK, FIN, RST = 2, 16, 1, 4
SMALL_WINDOW, LARGE_PACKET = 4096, 1400

DIMENSIONS: dict[str, tuple[str, ...]] = {
    "src_ip": ("src_ip",),
    "dst_ip": ("dst_ip",),
    "src_port": ("src_port",),
    "dst_port": ("dst_port",),
    "pair": ("src_ip", "dst_ip"),
    "ttl": ("ttl",),
}
ENTROPY_DIMENSIONS = ("src_ip", "dst_ip", "src_port", "dst_port")
# Parts of a block's values in sliding windows, each the work of one task.
BLOCK_PARTS = 32
_DIM_COLUMNS = ("src_ip", "dst_ip", "src_port", "dst_port", "ttl")


# Packet properties as SQL, one parsed expression each.
PACKET_FLAGS = {
    "is_tcp": "protocol = 6",
    "is_udp": "protocol = 17",
    "is_icmp": "protocol IN (1, 58)",
    "is_dns": "protocol = 53 OR src_port = 53 OR dst_port = 53",
    "is_syn": f"flags & {SYN} <> 0 AND flags & {ACK} = 0",
    "is_syn_ack": f"flags = {SYN | ACK}",
    "is_ack": f"flags & {ACK} <> 0 AND flags & {SYN} = 0",
    "is_rst": f"flags & {RST} <> 0",
    "is_fin": f"flags & {FIN} <> 0",
    "is_zero_payload": "coalesce(payload_size, 0) = 0",
    "is_small_window": f"coalesce(window_size, 65535) < {SMALL_WINDOW}",
    "is_fragment": "coalesce(fragment_offset, 0) > 0",
    "is_large": f"packet_size > {LARGE_PACKET}",
}


def packet_flags(packets: DataFrame) -> DataFrame:
    """Packets with one boolean column per property (all JVM-side)."""
    return packets.selectExpr("*", *[f"({sql}) AS {name}" for name, sql in PACKET_FLAGS.items()])


# Integer sums from which every ratio and mean is computed with one division.
ADDITIVE = {
    "n": "count(1)",
    "bytes": "sum(CAST(packet_size AS BIGINT))",
    "bytes_sq": "sum(CAST(packet_size AS BIGINT) * packet_size)",
    "ttl_sum": "sum(ttl)",
    "payload_sum": "sum(coalesce(payload_size, 0))",
    "window_sum": "sum(coalesce(window_size, 65535))",
    "from_port_53": "count_if(src_port = 53)",
    "size_min": "min(packet_size)",
    "size_max": "max(packet_size)",
    **{name[3:] + "_n": f"count_if({sql})" for name, sql in PACKET_FLAGS.items()},
}


def value_counts(
    packets: DataFrame, group: Sequence[str], dims: Sequence[str] = tuple(DIMENSIONS),
) -> DataFrame:
    """Packets per value of each dimension and group; ``dim`` names the dimension."""
    sets = [[*group, *DIMENSIONS[d]] for d in dims]
    # One bit per dimension column that is absent from the grouping set; the first is the highest.
    masks = {
        name: sum(1 << (len(_DIM_COLUMNS) - 1 - i)
                  for i, c in enumerate(_DIM_COLUMNS) if c not in cols)
        for name, cols in DIMENSIONS.items() if name in dims
    }
    whens = " ".join(f"WHEN {mask} THEN '{name}'" for name, mask in masks.items())
    return (
        packets.select(*group, *_DIM_COLUMNS)
        .groupingSets(sets, *group, *_DIM_COLUMNS)
        .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("c"))
        .select(*group, F.expr(f"CASE _gid {whens} END AS dim"), *_DIM_COLUMNS, "c")
    )


def _c_log_c(c: str) -> str:
    return f"IF({c} > 0, {c} * log2({c}), 0.0D)"


def _spread_measures(distinct: str, c_log_c: str, dims: Sequence[str] = tuple(DIMENSIONS)) -> dict[str, str]:
    """Per dimension the sum of distinct values (``u_``) and of c*log2(c) (``g_``)."""
    out = {f"u_{d}": f"sum(IF(dim = '{d}', {distinct}, NULL))" for d in dims}
    out |= {f"g_{d}": f"sum(IF(dim = '{d}', {c_log_c}, NULL))" for d in ENTROPY_DIMENSIONS if d in dims}
    return out


def _named(measures: dict[str, str]) -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for name, sql in measures.items()]


def measure_columns(seconds: float | str) -> dict[str, str]:
    """SQL of the 36 measures from additive sums, distinct counts and sums of c*log2(c)."""
    some = "greatest(n, 1)"
    tcp, ack, dns = (f"greatest({c}, 1)" for c in ("tcp_n", "ack_n", "dns_n"))
    seconds = seconds if isinstance(seconds, str) else f"{float(seconds)}D"

    def entropy(dim: str) -> str:
        # Rounding noise around zero is not entropy.
        bits = f"(log2({some}) - g_{dim} / {some})"
        return f"IF({bits} > 1e-9, {bits}, 0.0D)"

    def product(a: str, b: str) -> str:
        return f"CAST({a} AS DECIMAL(19,0)) * CAST({b} AS DECIMAL(18,0))"

    return {
        "packet_count": "n",
        "byte_count": "bytes",
        "packet_rate": f"n / {seconds}",
        "byte_rate": f"bytes / {seconds}",
        **{f"{p}_ratio": f"{p}_n / {some}" for p in ("tcp", "udp", "icmp", "dns")},
        **{f"{p}_ratio": f"{p}_n / {tcp}" for p in ("syn", "syn_ack", "ack", "rst", "fin")},
        "syn_to_ack_ratio": f"syn_n / {ack}",
        **{f"{d}_entropy": entropy(d) for d in ENTROPY_DIMENSIONS},
        "avg_packet_size": f"bytes / {some}",
        "std_packet_size":
            f"sqrt(CAST({product('bytes_sq', 'n')} - {product('bytes', 'bytes')} AS DOUBLE)) / {some}",
        "min_packet_size": "size_min",
        "max_packet_size": "size_max",
        "unique_src_ips": "u_src_ip",
        "unique_dst_ips": "u_dst_ip",
        "unique_src_ports": "u_src_port",
        "unique_dst_ports": "u_dst_port",
        "unique_ip_pairs": "u_pair",
        "avg_ttl": f"ttl_sum / {some}",
        "ttl_diversity": "u_ttl",
        "avg_payload_size": f"payload_sum / {some}",
        "zero_payload_ratio": f"zero_payload_n / {some}",
        "avg_window_size": f"window_sum / {some}",
        "small_window_ratio": f"small_window_n / {some}",
        "fragmentation_ratio": f"fragment_n / {some}",
        "dns_response_ratio": f"from_port_53 / {dns}",
        "large_packet_ratio": f"large_n / {some}",
    }


def finish(sums: DataFrame, keys: Sequence[str], seconds: float | str,
           measures: Sequence[str] = MEASURES) -> DataFrame:
    """Measures from sums; without packets all of them are zero."""
    sql = measure_columns(seconds)
    return sums.selectExpr(*keys, *[f"coalesce({sql[m]}, 0) AS {m}" for m in measures])


# The dimension a measure needs counted; every other measure is additive.
_SPREAD_OF = {
    **{f"{d}_entropy": d for d in ENTROPY_DIMENSIONS},
    "unique_src_ips": "src_ip", "unique_dst_ips": "dst_ip", "unique_src_ports": "src_port",
    "unique_dst_ports": "dst_port", "unique_ip_pairs": "pair", "ttl_diversity": "ttl",
}


def _pane(seconds: int) -> Column:
    """Start of the tumbling window, in whole epoch seconds."""
    s = F.unix_seconds("ts")
    return s - F.pmod(s, F.lit(seconds)) if seconds > 1 else s


def _with_spread(sums: DataFrame, counts: DataFrame, group: Sequence[str],
                 dims: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """Additive sums and spread measures side by side. Both have at most one row per group and share
    its hash partitioning, so they meet without another shuffle."""
    steps = _spread_measures("1L", _c_log_c("c"), dims)
    spread = counts.groupBy(*group).agg(*_named(steps))
    return (
        sums.unionByName(spread, allowMissingColumns=True).groupBy(*group)
        .agg(*[F.expr(f"max({c}) AS {c}") for c in [*ADDITIVE, *steps]]))


def feature_vector(
    packets: DataFrame,
    window: int | None = 1,
    slide: int | None = None,
    keys: Sequence[str] = ("sensor_id",),
    duration: float = 1.0,
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """The 36 measures, or the named ones, per (keys, window).

    ``window=None`` treats the frame as one window of nominal length ``duration``; with no keys an
    empty frame then gives one zero row. Windows are ``[start, end)`` in event time, in seconds.
    """
    if window is not None and slide not in (None, window):
        return multi_window_features(packets, {f"{window}s": window}, slide, keys).select(
            *keys, "window_start", "window_end", *measures)
    group = list(keys)
    if window is not None:
        packets = packets.withColumn("window_start", _pane(window))
        group.append("window_start")
    sums = packets.groupBy(*group).agg(*_named(ADDITIVE))
    dims = [d for d in DIMENSIONS if any(_SPREAD_OF.get(m) == d for m in measures)]
    if dims:
        sums = _with_spread(sums, value_counts(packets, group, dims), group, dims)
    out = finish(sums, group, float(window or duration), measures)
    return out.withColumn("window_end", F.col("window_start") + window) if window else out


def _fresh(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Whether each row differs from the one above in any column; nulls are equal."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh) > 1:
        fresh[1:] = False
        for c in columns:
            for x in ([c, c.is_null()] if c.null_count else [c]):
                fresh[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), False).to_numpy()
    return fresh


def _changes(value: np.ndarray, p: np.ndarray, c: np.ndarray, w: int, begin: int, end: int,
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, second and the value's packets in the window before and after each change in ``[begin, end)``. Rows are
    sorted by value and pane; a block begins with nothing before."""
    base = begin - 2 * w - 2
    stride = end - base + w + 2
    inside = p > begin - w
    value, p, c = value[inside], p[inside], c[inside]
    line = value * stride + (p - base)
    upto = np.concatenate([[0], np.cumsum(c)])
    enter = p > begin
    leaving = p + w
    leave = (leaving > begin) & (leaving < end)
    after = line[leave] + w
    place = np.searchsorted(line, after)
    leave[leave] = line[np.minimum(place, len(line) - 1)] != after  # else a pane enters at that very time
    first = value[np.flatnonzero(np.diff(value, prepend=-1))]
    value = np.concatenate([first, value[enter], value[leave]])
    t = np.concatenate([np.full(len(first), begin), p[enter], leaving[leave]])
    at = value * stride + (t - base)

    def held(last: np.ndarray) -> np.ndarray:
        return upto[np.searchsorted(line, last, side="right")] - upto[np.searchsorted(line, last - w, side="right")]

    now, before = held(at), held(at - 1)
    before[:len(first)] = 0
    return value, t, before, now


def _steps(batches: Iterator[pa.RecordBatch], keys: int, spans: list[int], block: int, dims: list[str], entropies: list[str],
           rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Changes of the distinct values and of their sums of c*log2(c), per key, window length, block and second.

    Rows come sorted by key, block, value and pane. They are worked on some 200,000 at a time; the last value of a
    portion, at most one row a pane of its block, waits for the next. A block's changes are held as dense arrays.
    """
    number = {d: i for i, d in enumerate(dims)}
    state = {"at": None}

    def c_log_c(n: np.ndarray) -> np.ndarray:
        return n * np.log2(np.maximum(n, 1))

    def flush() -> Iterator[pa.RecordBatch]:
        if state["at"] is None:
            return
        *key, b = state["at"]
        for k, w in enumerate(spans):
            u, g = state["u"][k], state["g"][k]
            t = np.flatnonzero(u.any(axis=0) | g.any(axis=0))
            if len(t):
                whole = [pa.repeat(x, len(t)) for x in (*key, pa.scalar(w, pa.int64()), b)]
                columns = [pa.array(t + b.as_py() * block), *[pa.array(np.rint(u[i, t]).astype(np.int64)) for i in range(len(dims))],
                           *[pa.array(g[number[d], t]) for d in entropies]]
                names = [*key_names, "w", "b", "t", *[f"u_{d}" for d in dims], *[f"g_{d}" for d in entropies]]
                yield pa.RecordBatch.from_arrays([*whole, *columns], names)

    def add(table: pa.Table, b: int) -> None:
        value = np.cumsum(_fresh([table.column(i) for i in range(keys + 1, table.num_columns - 2)])) - 1
        p, c = table.column("p").to_numpy(), table.column("c").to_numpy()
        coded = table.column("dim").combine_chunks().dictionary_encode()
        names = np.array([number[d] for d in coded.dictionary.to_pylist()])
        dim = np.zeros(value[-1] + 1, dtype=np.int64)
        dim[value] = names[coded.indices.to_numpy()]
        for k, w in enumerate(spans):
            of, t, before, now = _changes(value, p, c, w, b * block, (b + 1) * block)
            place = dim[of] * block + (t - b * block)
            for name, change in (("u", (now > 0) * 1.0 - (before > 0)), ("g", c_log_c(now) - c_log_c(before))):
                state[name][k] += np.bincount(place, change, len(dims) * block).reshape(len(dims), block)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        starts = np.flatnonzero(_fresh([table.column(i) for i in range(keys + 1)]))
        for start, end in zip(starts, [*starts[1:], table.num_rows]):
            at = [table.column(i)[int(start)] for i in range(keys + 1)]
            if at != state["at"]:
                yield from flush()
                state.update(at=at, u=np.zeros((len(spans), len(dims), block)), g=np.zeros((len(spans), len(dims), block)))
            add(table.slice(int(start), int(end - start)), at[-1].as_py())

    held: list[pa.RecordBatch] = []
    key_names: list[str] = []
    for batch in batches:
        key_names = batch.schema.names[:keys]
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_fresh([table.column(i) for i in range(table.num_columns - 2)]))[-1])
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield from work(pa.Table.from_batches(held))
    yield from flush()


def multi_window_features(
    packets: DataFrame,
    windows: dict[str, int] | None = None,
    slide: int = 1,
    keys: Sequence[str] = ("sensor_id",),
    block: int = 3600,
) -> DataFrame:
    """Feature vectors of several sliding windows from one pass over the packets.

    Packets are first reduced to panes of ``slide`` seconds. A value's count in a window of W panes
    changes only when a pane enters or leaves it, so each pane contributes two change points instead
    of W copies. Tasks get the panes of a block sorted by value; differences of prefix sums give the count before and
    after each change point. Distinct and entropy totals are running sums of how each value's contribution changed.
    Work is cut into time blocks (a pane is repeated in the next block only while a window still covers it), and a
    block's values into parts, so nothing grows with the length of the history.
    """
    windows = windows or {"1s": 1, "5s": 5, "60s": 60}
    if any(size % slide for size in windows.values()):
        raise ValueError("window sizes must be multiples of the slide")
    keys = list(keys)
    block = max(block // slide, 4 * max(windows.values()) // slide)
    group = [*keys, "p"]
    panes = packets.withColumn("p", F.expr(f"CAST(floor(unix_seconds(ts) / {slide}) AS BIGINT)"))
    pane_sums = panes.groupBy(*group).agg(*_named(ADDITIVE))
    pane_values = value_counts(panes, group)
    out_keys = [*keys, "window_name", "window_start", "window_end"]

    frames = []
    for name, size in windows.items():
        if size == slide:  # a pane is a window
            frames.append(finish(
                _with_spread(pane_sums, pane_values, group).withColumns({
                    "window_name": F.lit(name), "window_start": F.col("p") * slide,
                    "window_end": (F.col("p") + 1) * slide}), out_keys, float(size)))
    sliding = {name: size // slide for name, size in windows.items() if size != slide}
    if not sliding:
        return reduce(DataFrame.unionByName, frames)

    spans = F.explode(F.expr("array(" + ", ".join(f"{w}L" for w in sorted(set(sliding.values()))) + ")"))
    longest = max(sliding.values())
    # Panes of a block by value, each row once for all window lengths. Sorted by a hash first: nearly every comparison is
    # decided by its eight bytes.
    values = (
        pane_values.withColumn("b", F.explode(F.expr(
            f"array_distinct(array(CAST(floor(p / {block}) AS BIGINT), "
            f"CAST(floor((p + {longest - 1}) / {block}) AS BIGINT)))")))
        .withColumn("_h", F.xxhash64("dim", *_DIM_COLUMNS))
        .select(*keys, "b", "_h", "dim", *_DIM_COLUMNS, "p", "c"))
    steps = _spread_measures("1L", "c")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in values.select(*keys).schema.fields]
    at = [*keys, "w", "b", "t"]
    stepped = (
        values.repartition(F.xxhash64(*keys, "b", F.pmod("_h", F.lit(BLOCK_PARTS))))
        .sortWithinPartitions(*keys, "b", "_h", "dim", *_DIM_COLUMNS, "p")
        .mapInArrow(partial(_steps, keys=len(keys), spans=sorted(set(sliding.values())), block=block, dims=list(DIMENSIONS),
                            entropies=list(ENTROPY_DIMENSIONS)),
                    ", ".join([*fields, "w long, b long, t long", *[
                        f"{c} {'long' if c.startswith('u_') else 'double'}" for c in steps]]))
        .groupBy(*at).agg(*_named({c: f"sum({c})" for c in steps})))

    # Additive measures: one row per pane, so plain expansion to its windows stays small.
    covered = (
        pane_sums.withColumn("w", spans)
        .withColumn("t", F.explode(F.expr("sequence(p, p + w - 1)")))
        .withColumn("b", F.expr(f"CAST(floor(t / {block}) AS BIGINT)")).drop("p")
    )
    totals = {c: f"sum({c})" for c in ADDITIVE} | {
        "size_min": "min(size_min)", "size_max": "max(size_max)"}
    merged = (
        covered.groupBy(*at).agg(*_named(totals))
        .unionByName(stepped, allowMissingColumns=True)
        .groupBy(*at).agg(*_named({c: f"max({c})" for c in [*totals, *steps]}))
    )
    running = W.partitionBy(*keys, "w", "b").orderBy("t").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    windowed = merged.withColumns({c: F.sum(c).over(running) for c in steps}).where("n IS NOT NULL")
    names = "map(" + ", ".join(f"{w}L, array({', '.join(repr(n) for n, x in sliding.items() if x == w)})"
                               for w in sorted(set(sliding.values()))) + ")"
    frames.append(finish(
        windowed.withColumns({
            "window_name": F.explode(F.expr(f"{names}[w]")),
            "window_end": F.expr(f"(t + 1) * {slide}"),
            "window_start": F.expr(f"(t + 1 - w) * {slide}")}),
        out_keys, f"CAST(w * {slide} AS DOUBLE)"))
    return reduce(DataFrame.unionByName, frames)


def with_model_array(features: DataFrame, name: str = "feature_array") -> DataFrame:
    """The 30 model inputs as one array in model order."""
    return features.withColumn(
        name, F.array(*[F.col(c).cast("double") for c in FEATURE_ORDER]))


def approximate_cardinality(
    packets: DataFrame, window: int = 1, keys: Sequence[str] = ("sensor_id",), rsd: float = 0.05,
) -> DataFrame:
    """Distinct counts by sketch: one shuffle, constant memory per window."""
    names = {"src_ip": "unique_src_ips", "dst_ip": "unique_dst_ips", "src_port": "unique_src_ports",
             "dst_port": "unique_dst_ports", "pair": "unique_ip_pairs", "ttl": "ttl_diversity"}
    return (
        packets.withColumn("window_start", _pane(window)).groupBy(*keys, "window_start")
        .agg(*[F.approx_count_distinct(F.struct(*DIMENSIONS[d]), rsd).alias(out)
               for d, out in names.items()])
    )
