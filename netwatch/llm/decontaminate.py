"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words) and units turn into typed placeholders, all other
words are case-folded without outer punctuation. Windows of eight template words are hashed and
hash-joined with those of the benchmark. Windows that count together on one diagonal (same shift between a text and an
item) fill their slots consistently: one benchmark filler always meets the same document filler, and two names stay two
(numbers and units may become equal). Literal words take no part in this. So a question with other numbers and names is
caught, and a text that only shares a phrase pattern is not. Where fillers clash, those that more than half of a filler's
places agree on hold, and only windows with others are dropped; windows without any changed filler always count.

A pair (document, item) is reported when consistent windows cover at least 13 words of the item, or the whole item if it
is shorter. Placeholders need five literal words of eight, so runs of them match nothing; a window with fewer literals is
exact: it is hashed with its fillers, and matches its copies only. Items of fewer than eight words
are one window of their own length.

Capitals tell names from literals, so templates alone miss copies in another case. With ``any_case`` each window is hashed
once more with its names as literals and all words case-folded; the query and the pipeline do so.

The scan of all documents drops nearly all windows early: a bitmap of fixed size (8 MB) holds the hashes of the
benchmark windows. It only saves work: what passes is joined exactly, at any benchmark size.

Defined results: null texts and null items have no words; rows without doc_id or item_id can't be named and are not
reported; repeated rows of a document or item count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwatch.session import written

WIDTH = 8
LITERALS = 5
COVERED = 13
BITMAP_BITS = 1 << 26

#: Units of measure that become a placeholder.
UNITS = frozenset("""
mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ounce ounces pound pounds lb
lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks
month months year years dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh
watt watts volt volts meter meters metre metres
""".split())
LITERAL, NUMBER, NAME, UNIT = range(4)
_NUMBER = re.compile(r"[+\-]?[$€£¥]?\d")
_EDGE = re.compile(r"^[^\w$€£¥+\-]+|[^\w%]+$")
_EXACT = 0x2545F4914F6CDD1D
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                   0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0876A9A47], np.uint64)


def canonical(word: str) -> tuple[int, str]:
    """(kind, form) of a word: kind LITERAL with its case-folded form, or a slot kind with its filler."""
    core = _EDGE.sub("", word) or word
    if _NUMBER.match(core):
        return NUMBER, core.casefold()
    if core.casefold() in UNITS:
        return UNIT, core.casefold()
    if core[:1].isupper():
        return NAME, core.casefold()
    return LITERAL, core.casefold()


class Templates(dict):
    """Word (bytes) -> hash of its form with the kind in its two lowest bits; emptied at a fixed size."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        kind, form = canonical(word.decode("utf-8", "replace"))
        value = (xxhash.xxh3_64_intdigest(form) & ~3) | kind
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value


def _rolled(values: np.ndarray, width: int, n: int) -> np.ndarray:
    total = np.full(n, width, np.uint64)
    for i in range(width):
        part = values[i:i + n] * _PLACE[i]
        total += part ^ (part >> np.uint64(32))
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    total[total == 0] = 1
    return total


def windows(forms: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words, given by the hashes of their forms: of its template, or of its forms where
    it has too few literal words."""
    n = len(forms) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    kinds = forms & np.uint64(3)
    literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
    total = _rolled(np.where(kinds == LITERAL, forms, kinds), width, n)
    weak = np.flatnonzero((literal[width:] - literal[:-width]) * WIDTH < LITERALS * width)
    if len(weak):
        total[weak] = _rolled(forms, width, n)[weak] ^ np.uint64(_EXACT)
    return total


def _fillers(words: list[bytes]) -> list[int]:
    """Hash of each word's form, with its kind in the two lowest bits."""
    forms = [canonical(w.decode("utf-8", "replace")) for w in words]
    return [((xxhash.xxh3_64_intdigest(form) & ~3) | kind) - 2**63 for kind, form in forms]


def consistent_places(found: dict[int, tuple[list[int], list[int]]]) -> dict[int, int]:
    """Covered place of the item -> 1 where its filler is changed, for the windows of one diagonal (place of the window ->
    fillers of the item and of the text)."""
    met: dict[int, tuple[int, int, int]] = {}  # place -> kind, filler of the item, filler of the text
    for at, (theirs, ours) in found.items():
        met.update((at + i, (a & 3, a >> 2, b >> 2)) for i, (a, b) in enumerate(zip(theirs, ours)))
    slots = [m for m in met.values() if m[0] != LITERAL]
    pairs, one_way = Counter(slots), Counter(m[:2] for m in slots)
    back = Counter(m[2] for m in slots if m[0] == NAME)
    agreed = {m for m, n in pairs.items() if 2 * n > one_way[m[:2]] and (m[0] != NAME or 2 * n > back[m[2]])}
    out = {}
    for at, (theirs, _) in found.items():
        own = [met[at + i] for i in range(len(theirs))]
        if all(a == b for _, a, b in own) or all(m[0] == LITERAL or m in agreed for m in own):
            out.update((at + i, int(a != b)) for i, (_, a, b) in enumerate(own))
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = pa.list_(pa.struct([("place", pa.int64()), ("changed", pa.int64())]))
    for batch in batches:
        places = []
        for diagonal in batch.column(3):
            own = consistent_places({w["item_at"]: (w["theirs"], w["ours"]) for w in diagonal.as_py()})
            places.append([{"place": p, "changed": c} for p, c in own.items()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, kept)],
                                         ["doc_id", "item_id", "n_item_words", "places"])


def _scan(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...], bitmap=None, any_case: bool = False) -> Iterator[pa.RecordBatch]:
    """(id, copy, at, hash, fillers, n_words) of the windows, or of those that the bitmap may hold; ``copy`` is the text's hash."""
    known = Templates()
    bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
    schema = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("at", pa.int64()), ("hash", pa.int64()),
                        ("fillers", pa.list_(pa.int64())), ("n_words", pa.int64())])
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary")):
            if key is None or not text.is_valid:
                continue
            whole = text.as_py()
            words, copy = whole.split(), xxhash.xxh3_64_intdigest(whole) - 2**63
            forms = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            names = (forms & np.uint64(3) == NAME) & any_case
            for width in widths:
                if bits is None and width != min(WIDTH, len(words)):
                    continue
                typed = windows(forms, width)
                folded = windows(np.where(names, forms & ~np.uint64(3), forms), width) if names.any() else typed
                for hashes in (typed, folded):
                    found = np.ones(len(hashes), bool) if hashes is typed else folded != typed
                    if bits is not None:
                        place = hashes % np.uint64(BITMAP_BITS)
                        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    for at in np.flatnonzero(found).tolist():
                        rows.append((key, copy, at, int(hashes[at].view(np.int64)), _fillers(words[at:at + width]),
                                     len(words)))
                    if folded is typed:
                        break
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ROW = "id long, copy long, at long, hash long, fillers array<long>, n_words long"


def _bitmap(hashes: DataFrame) -> bytes:
    """Bitmap of the hashes modulo its fixed size; the driver gets at most its 8 MB."""
    place = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    parts = hashes.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in parts.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at:at + 4096] = row["bits"]
    return bytes(out)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", any_case: bool = False) -> DataFrame:
    """(doc_id, item_id, n_covered, n_item_words, n_changed): covered words of the item, and how many of its slot
    fillers the document has replaced (0: a verbatim copy up to punctuation, and with ``any_case`` up to case)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string"))
    every = tuple(range(1, WIDTH + 1))
    asked = written(items.mapInArrow(partial(_scan, widths=every, any_case=any_case), _ROW).select(
        F.col("id").alias("item_id"), F.col("copy").alias("item_copy"), F.col("at").alias("item_at"), "hash", F.col("fillers").alias("item_fillers"),
        F.col("n_words").alias("n_item_words")).distinct(), "asked")
    widths = tuple(r[0] for r in asked.select(F.size("item_fillers")).distinct().collect())  # WIDTH values at most
    bitmap = spark.sparkContext.broadcast(_bitmap(asked))
    found = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        partial(_scan, widths=widths, bitmap=bitmap, any_case=any_case), _ROW)
    line = ["doc_id", "copy", "item_id", "item_copy", "shift", "n_item_words"]
    matched = found.select(F.col("id").alias("doc_id"), "copy", "at", "hash", "fillers").join(asked, "hash").select(
        "doc_id", "copy", "item_id", "item_copy", (F.col("at") - F.col("item_at")).alias("shift"), "n_item_words", "item_at",
        F.col("item_fillers").alias("theirs"), F.col("fillers").alias("ours")).distinct()
    diagonals = matched.groupBy(*line).agg(F.collect_list(F.struct("item_at", "theirs", "ours")).alias("found"))
    consistent = diagonals.select("doc_id", "item_id", "n_item_words", "found").mapInArrow(
        _judge, "doc_id long, item_id long, n_item_words long, places array<struct<place:long,changed:long>>")
    return (consistent.select("doc_id", "item_id", "n_item_words", F.explode("places").alias("x"))
            .groupBy("doc_id", "item_id", "n_item_words", F.col("x.place").alias("place"))
            .agg(F.min("x.changed").alias("changed"))
            .groupBy("doc_id", "item_id").agg(
                F.count("*").alias("n_covered"), F.max("n_item_words").alias("n_item_words"),
                F.sum("changed").alias("n_changed"))
            .where(F.col("n_covered") >= F.least(F.lit(COVERED), F.col("n_item_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", any_case: bool = True) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    pairs = contaminated_pairs(docs, benchmark, doc_id, text, item_id, item_text, any_case)
    gone = written(pairs.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    whole = docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("long").alias("_id"))
    return whole.join(gone, whole["_id"] == gone["_gone"], "left_anti").select("doc.*")
