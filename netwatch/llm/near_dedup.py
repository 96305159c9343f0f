"""MinHash near-duplicate groups with odd sketches.

1. Every text becomes its set of distinct 5-word shingles (64-bit hashes). Texts with equal sets form a class at
   once, by a fingerprint of the set; from there on a class is one node, however many copies it has.
2. Each set gets 250 MinHash samples. Bands of five samples are bucket keys; the samples are also folded into a
   2,048-bit parity bitmap (an odd sketch). The population count of the XOR of two sketches estimates a high
   similarity far more precisely than the few bands do, so it rejects false candidates before texts move.
3. In each bucket every member is a candidate of one lead, never of all others. The lead is the member that shares most
   buckets with others, which is near the middle of its group. The best candidate of each class is confirmed on the full
   sets, so that a large group costs its size, not its square.
4. Buckets that still span several components hold texts that share a passage, or the outskirts of a group. Their members
   meet once more in an exact prefix join: shingles are ordered from rare to frequent among these texts, and two sets
   of similarity 0.75 must share one of their first few. What many texts share comes last in that order, so frequent
   passages make no candidates; the place of a shared shingle bounds the overlap and drops most others.
5. Components of confirmed links come from alternating star contractions.

Links are confirmed exactly; a link is missed only if no band agrees, which at the limit similarity 0.75 has
probability (1 - 0.75^5)^50 = 1.3e-6 and less above. A candidate is rejected by its sketch only when the estimate is under
0.58, five standard deviations below the limit.

Defined results: a null or wordless text has an empty set, is linked with nothing and is its own component; a text of fewer
than five words is one shingle of all its words. A null doc_id gives a null component and is kept. Rows that
repeat a doc_id are one node and share its verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.components import connected_components
from netwatch.session import written

WIDTH = 5
BANDS, ROWS = 50, 5
SKETCH_BITS = 2048
FLOOR = 0.58

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles. bytes.lower and bytes.split touch ASCII only: A-Z, and the six
    white-space bytes that separate words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WIDTH:
        whole = sum((int(h) * int(p) for h, p in zip(hashes, _PLACE)), len(words)) % 2**64
        return _mix(np.array([whole], np.uint64))
    n = len(words) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        total += hashes[i:i + n] * _PLACE[i]
    return np.unique(_mix(total))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    k = BANDS * ROWS
    return (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 2**32, k, dtype=np.uint32))


def _samples(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash samples; the set goes through in slices, so memory is bounded for any text."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, (low[at:at + 1024, None] * a + b).min(axis=0), out=best)
    return best


def _summaries(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x BANDS) and odd sketches (documents x bytes) of MinHash samples."""
    wide = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    keys = _mix((wide * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.uint64(_MIX[0]))
    index = np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(_MIX[0])
    bits = (_mix(samples.astype(np.uint64) + index) % np.uint64(SKETCH_BITS)).astype(np.int64)
    rows = np.arange(len(samples))[:, None] * SKETCH_BITS
    counts = np.bincount((bits + rows).ravel(), minlength=len(samples) * SKETCH_BITS)
    return keys.view(np.int64), np.packbits((counts & 1).astype(bool).reshape(len(samples), SKETCH_BITS), axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _permutations()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py()) for t in part.column(1).cast("binary")]
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            keys = sketches = prints = None
            if len(some):
                keys, sketches = _summaries(np.array([_samples(sets[i], a, b) for i in some]))
            prints, bands, odd = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for j, i in enumerate(some):
                prints[i] = blake2b(sets[i].tobytes(), digest_size=16).digest()
                bands[i] = keys[j]
                odd[i] = sketches[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(prints, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())],
                ["doc_id", "n_shingles", "print", "bands", "sketch"])


def similarity_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of row pairs of sketches, from the odd-sketch relation between XOR bits and set difference."""
    ones = np.bitwise_count(a ^ b).sum(axis=1)
    rest = np.maximum(1 - 2 * ones / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(rest)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = SKETCH_BITS // 8
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width)
                for c in ("sketch_a", "sketch_b"))
        found = similarity_estimate(a, b)
        keep = found >= FLOOR
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(found[keep])],
            ["a", "b", "estimate"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full sets reach 0.75. Rows come sorted by a, so its set is made once."""
    last, left = None, None
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch.column("a"), batch.column("text_a").cast("binary"),
                             batch.column("text_b").cast("binary")):
            if last != (a, ta):
                last, left = (a, ta), shingle_set(ta.as_py())
            right = shingle_set(tb.as_py())
            both = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(100 * both >= 75 * (len(left) + len(right) - both) and both > 0)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"])


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a text: id, component, set size, shingle."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(t.as_py()) for t in part.column(2).cast("binary")]
            sizes = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in (0, 1)]
                + [pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                ["id", "component", "n", "shingle"])


def _prefixes(open_texts: DataFrame) -> DataFrame:
    """(shingle, id, component, n, place, slack): the first n/4 + 1 shingles of each text that other components share, rare ones first.

    A shingle of one component alone can't be shared with another; it only takes a place. The others are ordered by the pairs they
    would make across components. A text whose first shared shingle with another is at ``place`` shares at most n - place + 1 of
    them, so it can't be linked with a set larger than slack / 3."""
    rows = written(open_texts.mapInArrow(_explode_sets, "id long, component long, n long, shingle long"), "shingles")
    often = F.col("often").cast("decimal(38,0)")
    crossing = (rows.groupBy("shingle", "component").agg(F.count("*").alias("often"))
                .groupBy("shingle").agg(F.count("*").alias("sides"), F.sum("often").cast("decimal(18,0)").alias("all"),
                                        F.sum(often * often).alias("within"))
                .where("sides > 1").select("shingle", (F.col("all") * F.col("all") - F.col("within")).alias("cross")))
    own = Window.partitionBy("id")
    return written(
        rows.join(crossing, "shingle")
        .withColumn("place", F.row_number().over(own.orderBy("cross", "shingle")) + F.col("n") - F.count("*").over(own))
        .where("place <= n div 4 + 1").drop("cross")
        .withColumn("slack", F.expr("7 * (n - place + 1) - 3 * n")), "prefixes")


def _meetings(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of smaller sets with each component cy in which they may have a partner, rows of larger sets)."""
    small = prefixes.where("place <= n div 7 + 1 AND slack >= 3 * n").select(
        "shingle", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("slack").alias("sx"))
    large = prefixes.select(
        "shingle", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("slack").alias("sy"))
    sides_x = small.groupBy("shingle", "cx").agg(
        F.min("nx").alias("nx_low"), F.max("nx").alias("nx_high"), F.max("sx").alias("sx_most"))
    sides_y = large.groupBy("shingle", "cy").agg(
        F.min("ny").alias("ny_low"), F.max("ny").alias("ny_high"), F.max("sy").alias("sy_most"))
    meet = sides_x.join(sides_y, "shingle").where(
        "cx <> cy AND nx_low <= ny_high AND 4 * nx_high >= 3 * ny_low AND sx_most >= 3 * ny_low AND sy_most >= 3 * nx_low")
    return small.join(meet, ["shingle", "cx"]).where(
        "nx <= ny_high AND 4 * nx >= 3 * ny_low AND sx >= 3 * ny_low AND sy_most >= 3 * nx").select(
        "shingle", "x", "nx", "sx", "cy"), large


def _prefix_pairs(open_texts: DataFrame) -> DataFrame:
    """(a, b) of different components (id, component, text) that may reach the limit. No such pair is missed.

    With overlap o >= 3/7 (n + m) for sizes n <= m, the smaller set must share one of its first n/7 + 1 shingles with
    the first m/4 + 1 of the larger. A shingle's components meet first and only then their rows, so the rows of one component never
    meet each other, however many they are. Sizes and slacks are held against each other in every one of these joins: what many
    texts share is made into pairs only where it is nearly all of them."""
    small, large = _meetings(_prefixes(open_texts))
    return small.join(large, ["shingle", "cy"]).where(
        "(nx < ny OR (nx = ny AND x < y)) AND 4 * nx >= 3 * ny AND sx >= 3 * ny AND sy >= 3 * nx").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, estimate) of the pairs that their sketches don't rule out."""
    one, two = (classes.select(F.col("id").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(
        _estimate, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one, two = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    full = pairs.select("a", "b").join(one, "a").join(two, "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = written(texts.mapInArrow(
        _describe, "doc_id long, n_shingles long, print binary, bands array<long>, sketch binary"), "sets")
    classes = written(described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    members = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(buckets, ["band", "key"]), "buckets")
    middle = shared.groupBy("id").agg(F.sum(F.log2("n")).alias("middle"))
    leads = shared.join(middle, "id").groupBy("band", "key").agg(
        F.max_by("id", F.struct("middle", -F.col("id"))).alias("lead"))
    stars = (shared.join(leads, ["band", "key"]).where("id <> lead")
             .select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"), "id", "lead").distinct())
    near = _likely(stars.select("a", "b").distinct(), classes)
    best = (stars.join(near, ["a", "b"]).groupBy("id")
            .agg(F.max_by("lead", F.struct("estimate", -F.col("lead"))).alias("lead"))
            .select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct())
    first = written(_confirmed(best, texts), "links")
    component = connected_components(first)
    placed = shared.join(component, shared["id"] == component["node"], "left").select(
        "band", "key", "id", F.coalesce("component", "id").alias("component"))
    split = (placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("band", "key"))
    open_ids = written(placed.join(split, ["band", "key"]).select("id", "component").distinct(), "open")
    open_texts = texts.join(open_ids, texts["doc_id"] == open_ids["id"]).select("id", "component", "text")
    second = written(_confirmed(written(_likely(_prefix_pairs(open_texts), classes), "likely"), texts), "links")
    copies = (described.where("n_shingles > 0 AND doc_id IS NOT NULL")
              .join(classes.select("print", "id"), "print").where("doc_id <> id")
              .select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    whole = connected_components(first.union(second))
    # A copy takes the component of its class; classes of repeated ids meet in the same node.
    rooted = copies.join(whole, copies["v"] == whole["node"], "left").select(
        F.col("u").alias("node"), F.coalesce("component", "v").alias("component")).union(whole)
    least = rooted.groupBy("node").agg(F.min("component").alias("component"))
    out = described.join(least, described["doc_id"] == least["node"], "left")
    root = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which one stands for each group, with all their columns."""
    gone = near_duplicates(docs, doc_id, text).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("_id"))
    return whole.join(gone.distinct(), whole["_id"] == gone["_gone"], "left_anti").select("doc.*")
