"""Hard negatives of anchors by shared candidate lists of anchor clusters.

Scores are exact integer inner products of vectors whose components are ``floor(scale * x)``. Anchors are clustered by direction, and
all anchors of a cluster share one list of candidates, ordered once by an upper bound: a candidate at angle t from the cluster's centre
is at least t - r from every member, r being the angle of the cluster's farthest member, so its score with a member u is at most
``|u| |x| cos(t - r)``. Each member walks the list and stops where the bound falls below what it still needs; from there on nothing can
change its result.

Lists are not built whole. Candidates lie in blocks of one label and one centre, at most a megabyte each. A cluster and a block that its
bound lets through meet in one task, which sorts the block into the cluster's order and walks it. Blocks of a cluster's own
centre go first; what they give sets the needs with which all others are reached, or left out before any data move.

Two such searches run: the best rows of an anchor's own label (its positives), then for every positive the best rows of other labels
whose scores lie in a window below the positive's.

Centres are fitted by spherical k-means on at most ``SAMPLE`` anchors; they only order the work, results are exact and the same with
any centres. Rows whose directions have no structure leave little to prune, and then the walks are the stated comparison of all
anchors with all rows, block by block.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; the components that a shorter vector
lacks count as 0; rows that are equal in id, label and vector count once, rows that share only the id are rows of their own, and an anchor
never meets rows of its own id. Scores must fit a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.session import written

MEMBERS, SAMPLE, MOST_CENTRES = 256, 4096, 256
BLOCK_BYTES = 1 << 20
_LEAST = -(1 << 63)
#: Angles and bounds are widened by this much, far above rounding errors.
_SLACK = 1e-6
_GROUPED = "part int, nth long, centre int, angle double, norm double, key long, vec_id long, label long, v array<long>"
_BLOCKS = ("block string, centre int, label long, radius double, longest double, n int, dims int, ids binary, vectors binary")
_FOUND = "key long, target int, score long, vec_id long"


def quantised(rows: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v, key): usable rows with integer components; the key tells rows apart that share an id."""
    x = F.col(vector).cast("array<double>")
    usable = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() &
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return usable.select("vec_id", "label", v.alias("v")).withColumn("key", F.xxhash64("vec_id", "label", "v"))


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    return v / np.where(norms > 0, norms, 1)[:, None], norms


def _padded(lists: pa.ListArray, dims: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_centres(anchors: DataFrame, n_anchors: int, dims: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors, one for each ``MEMBERS`` anchors and at most ``MOST_CENTRES``, from at most ``SAMPLE`` anchors."""
    sample = anchors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    x, _ = _directions(_padded(sample, dims))
    count = min(max(1, -(-n_anchors // MEMBERS)), MOST_CENTRES, len(x))
    centres = x[:count].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        sizes = np.linalg.norm(sums, axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.where(sizes > 0, sizes, 1)[:, None], centres)
    return centres


def _located(batches: Iterator[pa.RecordBatch], centres) -> Iterator[pa.RecordBatch]:
    """Adds the nearest centre, the angle to it, and the length of the vector."""
    near = centres.value
    for batch in batches:
        x, norms = _directions(_padded(batch.column("v"), near.shape[1]))
        cosine = x @ near.T
        centre = cosine.argmax(axis=1)
        angle = np.where(norms > 0, np.arccos(np.clip(cosine[np.arange(len(x)), centre], -1, 1)), 0)
        yield pa.RecordBatch.from_arrays([pa.array(centre, pa.int32()), pa.array(angle), pa.array(norms), batch.column("key"),
                                          batch.column("vec_id"), batch.column("label"), batch.column("v")],
                                         ["centre", "angle", "norm", "key", "vec_id", "label", "v"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in groups of one centre: (part, nth) names the group."""
    part, nth, size, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        groups = []
        for centre in batch.column("centre").to_pylist():
            if centre != last or size == MEMBERS:
                nth, size, last = nth + 1, 0, centre
            size += 1
            groups.append(nth)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(groups), pa.int32()), pa.array(groups, pa.int64()), *[batch.column(c) for c in (
                "centre", "angle", "norm", "key", "vec_id", "label", "v")]],
            [f.split()[0] for f in _GROUPED.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of one label and centre."""
    part, number = TaskContext.get().partitionId(), 0
    most = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
    held: list[tuple] = []  # pieces of the open block: ids, vectors, angles, lengths
    now = None

    def block() -> pa.RecordBatch:
        nonlocal number
        ids, vectors, angles, norms = (np.concatenate(c) for c in zip(*held))
        held.clear()
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((f"{part}-{number}", pa.string()), (now[1], pa.int32()), (now[0], pa.int64()),
             (float(angles.max()), pa.float64()), (float(norms.max()), pa.float64()), (len(ids), pa.int32()),
             (dims, pa.int32()), (ids.astype("<i8").tobytes(), pa.binary()), (vectors.astype("<i8").tobytes(), pa.binary()))],
            [f.split()[0] for f in _BLOCKS.split(", ")])

    for batch in batches:
        label, centre = (batch.column(c).to_numpy() for c in ("label", "centre"))
        ids, angles, norms = (batch.column(c).to_numpy() for c in ("vec_id", "angle", "norm"))
        vectors = _padded(batch.column("v"), dims)
        cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(centre) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            while a < b:
                if held and (now != (int(label[a]), int(centre[a])) or sum(len(h[0]) for h in held) >= most):
                    yield block()
                now = int(label[a]), int(centre[a])
                stop = min(b, a + most - sum(len(h[0]) for h in held))
                held.append((ids[a:stop], vectors[a:stop], angles[a:stop], norms[a:stop]))
                a = stop
    if held:
        yield block()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: floats hold them exactly below 2**53, else Python's integers do it."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def walk(members: list[dict], ids: np.ndarray, vectors: np.ndarray, label: int, centre: np.ndarray, same: bool,
         most: int) -> list[tuple[int, int, int, int]]:
    """(key, target, score, vec_id) of up to ``most`` block rows for each target of each member, by the shared list.

    A target is (low, high, need): scores from low to high count, and only those of at least ``need`` can still matter.
    """
    members = [m for m in members if (m["label"] == label) == same and m["targets"]]
    if not members:
        return []
    u = np.array([m["v"] for m in members], np.int64).reshape(len(members), -1)
    u = np.pad(u, ((0, 0), (0, vectors.shape[1] - u.shape[1])))
    own_ids = np.array([m["vec_id"] for m in members])
    who = np.repeat(np.arange(len(members)), [len(m["targets"]) for m in members])  # the member of each target
    target = np.array([[t["target"], t["low"], t["high"], t["need"]] for m in members for t in m["targets"]], np.int64)
    need = target[:, 3].copy()
    by_member = np.append(np.flatnonzero(np.append(True, np.diff(who) > 0)), len(who))

    directions, lengths = _directions(u)
    reach = np.arccos(np.clip(directions @ centre, -1, 1)).max(initial=0, where=lengths > 0) + _SLACK
    x, norms = _directions(vectors)
    angle = np.where(norms > 0, np.arccos(np.clip(x @ centre, -1, 1)), 0)
    bound = norms * np.maximum(np.cos(np.maximum(angle - reach, 0)), 0) * (1 + _SLACK)
    order = np.argsort(-bound, kind="stable")  # the list, once for the whole cluster
    bound = bound[order]

    held = np.zeros((0, 3), np.int64)  # target number, score, id
    at, step = 0, 64
    while at < len(order):
        least = np.minimum.reduceat(need, by_member[:-1])
        active = np.flatnonzero(lengths * bound[at] + 1 >= least)
        if not len(active):
            break  # certified: no later candidate reaches what any member needs
        some = order[at:at + step]
        scores = products(u[active], vectors[some])
        fits = (scores >= least[active, None]) & (ids[some] != own_ids[active, None])
        row, column = np.nonzero(fits)
        score, found = scores[row, column], ids[some][column]
        # Each hit once for each target of its member.
        count = np.diff(by_member)[active[row]]
        number = np.repeat(by_member[active[row]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        score, found = np.repeat(score, count), np.repeat(found, count)
        good = (score >= np.maximum(target[number, 1], need[number])) & (score <= target[number, 2])
        held = np.concatenate([held, np.stack([number[good], score[good], found[good]], axis=1)])
        held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
        starts = np.flatnonzero(np.append(True, np.diff(held[:, 0]) > 0)) if len(held) else np.zeros(0, np.int64)
        nth = np.arange(len(held)) - np.repeat(starts, np.diff(np.append(starts, len(held))))
        held = held[nth < most]
        full = np.flatnonzero(nth[nth < most] == most - 1)
        need[held[full, 0]] = np.maximum(need[held[full, 0]], held[full, 1])
        at += step
        step = min(2 * step, 1024)
    keys = [m["key"] for m in members]
    return [(keys[who[n]], int(target[n, 0]), s, i) for n, s, i in held.tolist()]


def _walks(batches: Iterator[pa.RecordBatch], centres, same: bool, most: int) -> Iterator[pa.RecordBatch]:
    near = centres.value
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            get = lambda name: one.column(name)[0]  # noqa: E731, B023
            ids = np.frombuffer(get("ids").as_buffer(), "<i8")
            vectors = np.frombuffer(get("vectors").as_buffer(), "<i8").reshape(len(ids), get("dims").as_py())
            found = walk(get("members").as_py(), ids, vectors, get("label").as_py(), near[get("cluster").as_py()], same, most)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*found), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["key", "target", "score", "vec_id"])


def _best(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of each target, numbered."""
    order = Window.partitionBy("key", "target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(anchors: DataFrame, blocks: DataFrame, targets: DataFrame, centres: np.ndarray, same: bool, most: int) -> DataFrame:
    """(key, target, score, vec_id, rank): the best ``most`` rows for each target (key, target, low, high).

    ``anchors`` and ``blocks`` are written tables; ``same`` asks for rows of the anchor's label, else of other labels.
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    angles = np.arccos(np.clip(centres @ centres.T, -1, 1))
    n = len(centres)
    apart = spark.createDataFrame(  # at most MOST_CENTRES squared rows
        [(i, j, float(angles[i, j])) for i in range(n) for j in range(n) if i != j] or [(0, 0, 0.0)],
        "cluster int, centre int, between double")

    def wave(known: DataFrame | None, own: bool) -> DataFrame:
        needs = targets.withColumn("need", F.col("low"))
        if known is not None:
            last = known.where(F.col("rank") == most).select("key", "target", F.col("score").alias("_last"))
            needs = targets.join(last, ["key", "target"], "left").withColumn(
                "need", F.greatest("low", F.coalesce("_last", "low"))).drop("_last")
        asked = needs.groupBy("key").agg(F.collect_list(F.struct("target", "low", "high", "need")).alias("targets"),
                                         F.min("need").alias("need"))
        clusters = written(anchors.join(asked, "key").groupBy("part", "nth", F.col("centre").alias("cluster")).agg(
            F.max("angle").alias("reach"), F.max("norm").alias("length"), F.min("need").alias("need"),
            F.collect_set("label").alias("labels"),
            F.collect_list(F.struct("key", "vec_id", "label", "v", "targets")).alias("members")), "clusters")
        heads = clusters.drop("members")
        tails = blocks.select("block", "centre", "radius", "longest", F.col("label"))
        if own:
            pairs = heads.join(tails, F.col("cluster") == F.col("centre")).withColumn("between", F.lit(0.0))
        else:
            pairs = heads.join(apart, "cluster").join(tails, "centre")
        gap = F.greatest(F.col("between") - F.col("reach") - F.col("radius") - 2 * _SLACK, F.lit(0.0))
        bound = F.col("length") * F.col("longest") * F.greatest(F.cos(gap), F.lit(0.0)) * (1 + _SLACK) + 1
        labels = F.array_contains("labels", F.col("label")) if same else F.exists("labels", lambda x: x != F.col("label"))
        pairs = pairs.where((bound >= F.col("need")) & labels).select("part", "nth", "cluster", "block")
        met = pairs.join(clusters.select("part", "nth", "members"), ["part", "nth"]).join(
            blocks.select("block", "label", "dims", "ids", "vectors"), "block")
        found = met.select("cluster", "members", "label", "dims", "ids", "vectors").mapInArrow(
            partial(_walks, centres=shared, same=same, most=most), _FOUND)
        return written(_best(found if known is None else found.unionByName(known.drop("rank")), most), "found")

    first = wave(None, True)
    return wave(first, False) if n > 1 else first


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on column vec_id. An anchor's positives are its best ``positives`` rows of the same label; the negatives of a positive
    are the best ``negatives`` rows of other labels that score from ``low`` to ``high`` hundredths of the positive.
    """
    spark = rows.sparkSession
    clean = quantised(rows, scale, vec_id, vector, label).dropDuplicates(["key"])
    clean = written(clean, "vectors")
    stats = clean.agg(F.max(F.size("v")).alias("dims"), F.sum(F.when(is_anchor, 1).otherwise(0)).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not stats["anchors"]:
        return spark.createDataFrame([], schema)
    dims = max(stats["dims"], 1)
    centres = fit_centres(clean.where(is_anchor), stats["anchors"], dims)
    near = clean.mapInArrow(partial(_located, centres=spark.sparkContext.broadcast(centres)), _GROUPED.split(", ", 2)[2])
    order = ["label", "centre", "angle", "key"]
    blocks = written(near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        partial(_packed, dims=dims), _BLOCKS), "blocks")
    anchors = written(near.where(is_anchor).repartitionByRange("centre", "angle", "key").sortWithinPartitions("centre", "angle", "key")
                      .mapInArrow(_numbered, _GROUPED), "anchors")
    everything = anchors.select("key", F.lit(0).alias("target"), F.lit(_LEAST).alias("low"), F.lit(-_LEAST - 1).alias("high"))
    best = search(anchors, blocks, everything, centres, True, positives)
    best = written(anchors.select("key", F.col("vec_id").alias("anchor_id")).join(
        best.select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth")),
        "key"), "positives")
    # low * score <= 100 * x <= high * score in whole numbers; below 0 the window is empty. A target for each positive.
    windows = best.where("positive_score >= 0").select(
        "key", F.col("nth").cast("int").alias("target"), F.expr(f"({int(low)} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({int(high)} * positive_score) div 100").alias("high"))
    windows = windows.where("low <= high")
    found = search(anchors, blocks, windows, centres, False, negatives)
    return best.join(found.select("key", F.col("target").alias("nth"), "rank", F.col("vec_id").alias("negative_id"),
                                  F.col("score").alias("negative_score")), ["key", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
