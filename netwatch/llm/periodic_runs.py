"""Periodic runs of words by branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period p that no neighbouring word extends. Its last square (twice p words that repeat after
p) is where two suffixes p apart agree on exactly p words: a branching tandem repeat. So the search goes over the intervals of the
suffix array whose suffixes share exactly ``depth`` words. The array of common prefix lengths alone gives them: each of its entries is a border
between two children, which reach to the next smaller entries on both sides. For every suffix i of the smaller child the inverse
suffix array tells whether i + depth or i - depth stands in the other child. Each suffix is in the smaller child of at most log n
borders; there are no tree nodes. Squares are then rotated to the left while the words before stay equal, and
squares that a run of a shorter period covers are no runs of their own.

Words that a text holds fewer than three times are in no run of exponent 3, so they cut the text into stretches, and stretches shorter
than the least run are left out. The stretches of many texts share one suffix array, each with an alphabet of its own. Memory is
proportional to a batch of texts, or to the longest text.

Defined results: null and empty texts have no words and no runs. Repeated rows each have their result; a row without doc_id keeps its id null.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwatch.llm.common import WORD

_WORDS = re.compile(WORD)
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words of stretches that share a suffix array; a longer text has one of its own.
BATCH = 1 << 17
#: Suffixes of smaller children that are tested at once.
_AT_ONCE = 1 << 20


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, inverse, ranks by the first 1, 2, 4, ... symbols) by prefix doubling; only suffixes that are not yet
    told apart are sorted again. Symbols are ranks themselves: equal symbols share the place of their first suffix."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks, step, levels = text.astype(np.int64), 1, []
    open_ = None
    while True:
        levels.append(ranks.astype(np.int32))
        sorted_ranks = ranks[order]
        same = np.append(sorted_ranks[1:] == sorted_ranks[:-1], False)
        open_ = np.flatnonzero(same | np.append(False, same[:-1]))  # places in groups of more than one
        if not len(open_):
            break
        suffixes = order[open_]
        ahead = suffixes + step
        second = np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, 0)
        first = ranks[suffixes]
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[open_] = suffixes[by]
        key = key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        # A rank is the place of the group's first suffix, so groups only ever split.
        places = np.maximum.accumulate(np.where(fresh, open_, -1))
        ranks = ranks.copy()
        ranks[order[open_]] = places
        step *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order (0 for the first)."""
    n = len(order)
    left, right, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        inside = np.maximum(left, right) < n
        equal = np.zeros(n - 1, bool)
        equal[inside] = ranks[left[inside]] == ranks[right[inside]]
        shared[1:] += equal.astype(np.int64) << level
        left += equal.astype(np.int64) << level
        right += equal.astype(np.int64) << level
    return shared


def _reaches(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each border the first suffix of its left child and the last of its right child: up to the next entry that is
    smaller (to the left: not greater), so that borders of one interval split it one after the other."""
    n = len(shared)
    left, right, stack = [0] * n, [n - 1] * n, []
    values = shared.tolist()
    for k in range(1, n):
        value = values[k]
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = k - 1
        left[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(left), np.array(right)


def branching_squares(order: np.ndarray, inverse: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, depth) of every square whose next word breaks the period, by the smaller children's suffixes."""
    n = len(order)
    left, right = _reaches(shared)
    borders = np.flatnonzero(shared > 0)
    sizes = np.minimum(borders - left[borders], right[borders] - borders + 1)
    starts, depths = [], []
    ends = np.cumsum(sizes)
    at = 0
    while at < len(borders):
        base = ends[at] - sizes[at]
        stop = max(int(np.searchsorted(ends, base + _AT_ONCE, side="right")), at + 1)
        own, size = borders[at:stop], sizes[at:stop]
        lower = own - left[own] <= right[own] - own + 1  # the left child is the smaller one
        begin = np.where(lower, left[own], own)
        border = np.repeat(own, size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        suffix, depth, low = order[place], shared[border], np.repeat(lower, size)
        for sign in (1, -1):
            other = suffix + sign * depth
            fits = (other >= 0) & (other < n)
            where = inverse[np.where(fits, other, 0)]
            # The other child: right of the border if the smaller one is left of it.
            fits &= np.where(low, (where >= border) & (where <= right[border]), (where < border) & (where >= left[border]))
            starts.append(np.minimum(suffix, other)[fits])
            depths.append(depth[fits])
        at = stop
    return (np.concatenate(starts), np.concatenate(depths)) if starts else (np.zeros(0, np.int64),) * 2


def runs_of(text: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> np.ndarray:
    """(start, end, period) of all runs of a text of symbols below its length, with length >= max(least, exponent * period)."""
    none = np.zeros((0, 3), np.int64)
    if len(text) < max(least, 2):
        return none
    order, inverse, levels = suffix_array(text)
    start, period = branching_squares(order, inverse, common_prefixes(order, levels))
    end = start + 2 * period
    sort = np.lexsort((period, end))
    start, period, end = start[sort], period[sort], end[sort]
    found = []
    while len(start):
        head = np.append(True, end[1:] != end[:-1])  # the shortest period of each end is a run's
        s, p, e = start[head], period[head], end[head]
        first = s.copy()
        moving = np.arange(len(s))
        reach = 1
        while len(moving):  # rotate to the left, in steps that grow while all of their words agree
            back = first[moving, None] - 1 - np.arange(reach)
            inside = back >= 0
            back = np.maximum(back, 0)
            agree = inside & (text[back] == text[back + p[moving, None]])
            moved = np.where(agree.all(axis=1), reach, agree.argmin(axis=1))
            first[moving] -= moved
            moving = moving[moved == reach]
            reach = min(2 * reach, max(1, _AT_ONCE // max(len(moving), 1)))
        found.append(np.stack([first, e, p], axis=1))
        # Longer periods of the same end that this run covers are multiples of its period.
        number = np.cumsum(head) - 1
        keep = ~head & (first[number] > start)
        start, period, end = start[keep], period[keep], end[keep]
    runs = np.concatenate(found) if found else none
    return runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, exponent * runs[:, 2])]


def _stretches(words: list[str], exponent: int, least: int) -> list[tuple[int, list[str]]]:
    """(first word, words) of what runs can lie in."""
    if len(words) < least:
        return []
    rare = {w for w, n in Counter(words).items() if n < exponent}
    if not rare:
        return [(0, words)]
    cuts = [-1, *[i for i, w in enumerate(words) if w in rare], len(words)]
    return [(a + 1, words[a + 1:b]) for a, b in zip(cuts, cuts[1:]) if b - a > least]


def texts_runs(texts: list[list[str]], exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, list[str]]] = []
    size = 0

    def search() -> None:
        """All held stretches in one text, each closed by a symbol of its own and with symbols of its own."""
        symbols, bounds, used = [], [], 0
        for _, _, words in held:
            codes: dict[str, int] = {}
            bounds.append(len(symbols))
            symbols += [codes.setdefault(w, used + len(codes)) for w in words]
            used += len(codes)
            symbols.append(used)
            used += 1
        text, bounds = np.array(symbols), np.array(bounds)
        # Symbols become places of their first suffix in sorted order.
        counts = np.bincount(text, minlength=used)
        text = (np.cumsum(counts) - counts)[text]
        runs = runs_of(text, exponent, least)
        for start, end, period in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist():
            number = int(np.searchsorted(bounds, start, side="right")) - 1
            which, first, _ = held[number]
            out[which].append((start - int(bounds[number]) + first, end - start, period))
        held.clear()

    for which, words in enumerate(texts):
        for first, some in _stretches(words, exponent, least):
            held.append((which, first, some))
            size += len(some)
            if size >= BATCH:
                search()
                size = 0
    if held:
        search()
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words with one period left of each run."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The query's texts: of ids whose checksum ends in 0, the words from a place on repeat with a period."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head, unit = words[:a], words[a:a + p]
    return head + (unit * (-(-(n - a) // p)))[:n - a]


OUT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
       "collapsed_sha256 string")
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _documents(batches: Iterator[pa.RecordBatch], change: Callable, exponent: int,
               least: int) -> Iterator[tuple[list, list[list[str]], list]]:
    for batch in batches:
        at, size, sizes = 0, 0, batch.column(1).fill_null("").cast(pa.large_binary())
        for row, text in enumerate(sizes):  # texts of some million bytes at once
            size += len(text.as_buffer() or b"")
            if size >= BATCH * 16 or row == batch.num_rows - 1:
                some = batch.slice(at, row + 1 - at)
                ids = some.column(0).to_pylist()
                texts = [_WORDS.findall(t or "") for t in some.column(1).to_pylist()]
                texts = [change(i, w) for i, w in zip(ids, texts)] if change else texts
                yield ids, texts, texts_runs(texts, exponent, least)
                at, size = row + 1, 0


def _digests(batches: Iterator[pa.RecordBatch], change: Callable, exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    nothing = sha256().hexdigest()
    names = [f.split()[0] for f in OUT.split(", ")]
    for ids, texts, found in _documents(batches, change, exponent, least):
        rows = []
        for doc, words, runs in zip(ids, texts, found):
            longest = (None,) * 4
            if runs:
                start, length, period = runs[0]
                for run in runs[1:]:  # exact fractions; earlier starts and periods come first
                    if run[1] * period > length * run[2]:
                        start, length, period = run
                longest = start, length, period, 1000 * length // period
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            rows.append((doc, len(runs), *longest, sha256(listed.encode()).hexdigest() if runs else nothing,
                         sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.string()] * 2)], names)


def _collapse(batches: Iterator[pa.RecordBatch], exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    for ids, texts, found in _documents(batches, None, exponent, least):
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        kept = [" ".join(collapsed(words, runs)) for words, runs in zip(texts, found)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())],
                                         ["doc_id", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text by start and period, and its words with one period left of each run, joined
    by spaces. Texts stay where they are, nothing is shuffled."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_collapse, exponent=exponent, least=least), RUNS)


def run_digests(docs: DataFrame, change: Callable[[int | None, list[str]], list[str]] | None = planted, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of all runs and of the collapsed text, after ``change`` of the words."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_digests, change=change, exponent=LEAST_EXPONENT, least=LEAST_LENGTH), OUT)
