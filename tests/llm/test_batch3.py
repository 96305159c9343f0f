"""Packing, periodic runs and hard negatives against brute force: nulls, odd texts, ties, repeated rows, empty tables, extra columns."""

import bisect
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netwatch.llm import best_fit_packing, hard_negatives, periodic_runs
from netwatch.llm.word_ids import WordIds

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, length string, place string, part string, words string"


def content():
    with open(VOCABULARY, "rb") as file:
        return file.read()


# ---- word ids

#: Characters that composition, lower-casing, splitting and white space treat in ways of their own.
ODD = ([chr(c) for c in range(0x20, 0x250)] + list("\x1c\x1f\x85\xa0 ᠎   　​́̀̇İΣσςſªéÅ가가٣५日\U0001f600ǅﬁ\t\n  aBZ1,.")
       + ["é", "'s", "'ll", "<|endoftext|>", "İ,", "word, ", "Word. "])


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer
    rng, whole, words = random.Random(5), Tokenizer.from_file(VOCABULARY), WordIds(content(), 500)
    assert words.by_words
    for _ in range(60):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(50)] + ["", "x" * 3000 + " ab,"]
        for text, ids in zip(texts, words.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer
    stated = json.loads(content())
    stated["normalizer"] = None
    other = json.dumps(stated)
    words, whole = WordIds(other.encode()), Tokenizer.from_str(other)
    assert not words.by_words
    texts = ["Alpha beta, gamma", "", "É é"]
    assert [np.frombuffer(i, "<u4").tolist() for i in words.encode(texts)] == [
        whole.encode(t, add_special_tokens=False).ids for t in texts]


# ---- packing

def best_fit_decreasing(lengths, capacity):
    """Sequences that plain best fit takes, longest first, piece by piece."""
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, used = capacity, used + 1
        bisect.insort(rooms, room - n)
    return used


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta Eta, theta. iota".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [None, "", " \n", "one", "é İ, 日本 <|endoftext|>", prose(9000)] + [prose(rng.choice([3, 40, 200, 700, 1500])) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(rows)] + [(4, "one"), (4, "one"), (None, "two words")]
    rows += [(1000 + i, "equal length") for i in range(60)]
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def test_packing(spark, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(VOCABULARY)
    for capacity in (4096, 500):
        packed = best_fit_packing.pack_documents(texts.repartition(5), VOCABULARY, capacity, with_ids=True)
        rows = packed.collect()
        want = []
        for r in texts.collect():
            ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
            want += [(r.doc_id, n, a, len(ids[a:a + capacity]), zlib.crc32(np.array(ids[a:a + capacity], "<u4").tobytes()))
                     for n, a in enumerate(range(0, len(ids), capacity))]
        key = lambda x: tuple(-9 if v is None else v for v in x)
        got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
        assert sorted(got, key=key) == sorted(want, key=key)
        held = {}
        for r in rows:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(held) <= best_fit_decreasing([r.length for r in rows], capacity) + 1
        sequences = best_fit_packing.packed_sequences(packed).collect()
        assert {r.sequence_id: r.length for r in sequences} == {s: sum(n for _, n in p) for s, p in held.items()}
        assert all(len(r.ids) == 4 * r.length for r in sequences)


def test_packing_of_nothing(spark):
    assert best_fit_packing.pack_documents(spark.createDataFrame([], DOCS), VOCABULARY).collect() == []


@pytest.mark.parametrize("case", ["mixed", "one length", "halves", "only large", "only small", "whole"])
def test_plans_fill_sequences(case):
    """Plans on histograms alone: every piece has one place, no sequence overflows, few more than the bound are used."""
    rng, capacity = np.random.default_rng(3), 4096
    lengths = {"mixed": np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, capacity), "one length": np.full(5000, 1700),
               "halves": rng.choice([2048, 2049, 2047], 3000), "only large": rng.integers(600, 4097, 4000),
               "only small": rng.integers(1, 500, 9000), "whole": np.full(77, capacity)}[case]
    counts, every = np.bincount(lengths, minlength=capacity + 1), np.arange(capacity + 1)
    large = (every > capacity // 8) & (counts > 0)
    plan, used = best_fit_packing.plan_large(every[large], counts[large], capacity)
    load = np.zeros(used + len(lengths), np.int64)

    def put(plan, pieces, order):
        if len(pieces):
            first, to, each = plan.arrays()
            place = np.arange(len(pieces))
            i = np.searchsorted(first, place, side="right") - 1
            np.add.at(load, order[to[i] + (place - first[i]) // each[i]], pieces)
    put(plan, np.sort(lengths[lengths > capacity // 8])[::-1], np.arange(len(load)))
    assert (load[:used] > 0).all() and load.max() <= capacity
    small = ~large & (counts > 0)
    order = np.concatenate([np.argsort(capacity - load[:used], kind="stable"), np.arange(used, len(load))])
    put(best_fit_packing.plan_small(np.bincount(capacity - load[:used], minlength=capacity + 1), every[small], counts[small], capacity),
        np.sort(lengths[lengths <= capacity // 8])[::-1], order)
    assert load.max() <= capacity and load.sum() == lengths.sum()
    assert np.count_nonzero(load) <= best_fit_decreasing(lengths.tolist(), capacity) * (1.02 if case == "only large" else 1.002) + 1


# ---- periodic runs

def runs_by_comparing(words, exponent=3, least=24):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and not any(
                    all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    k, n = rng.choice([1, 2, 3, 5, 30]), rng.randrange(130)
    words = [str(rng.randrange(k)) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 30:
            p, s = rng.randrange(1, 14), rng.randrange(n - 25)
            unit = words[s:s + p]
            for i in range(s, min(n, s + rng.randrange(24, 90))):
                words[i] = unit[(i - s) % len(unit)]
    return words


@pytest.mark.parametrize("exponent, least", [(3, 24), (2, 2), (3, 6)])
def test_runs(exponent, least, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH", 200)  # several texts share an array
    monkeypatch.setattr(periodic_runs, "_AT_ONCE", 64)
    rng = random.Random(exponent + least)
    for _ in range(40):
        texts = [periodic(rng) for _ in range(5)]
        assert periodic_runs.texts_runs(texts, exponent, least) == [runs_by_comparing(w, exponent, least) for w in texts]


def test_runs_of_very_long_texts():
    assert periodic_runs.texts_runs([["a"] * 200_000, [str(i % 7) for i in range(100_001)]]) == [[(0, 200_000, 1)], [(0, 100_001, 7)]]
    a, b = ["a"], ["b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert all(n >= 3 * p for _, n, p in periodic_runs.texts_runs([b])[0])


def test_run_digests(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a " * 100, "x" * 100_000, "İ é " * 40] + [" ".join(periodic(rng)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a " * 100), (None, "b " * 50)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)
    got = periodic_runs.run_digests(docs.repartition(3)).collect()
    want, changed = [], 0
    for doc, text in rows:
        import re
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
            g, n = zlib.crc32(str(doc).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = runs_by_comparing(words) if len(words) < 1000 else []
        keep = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(keep).encode()).hexdigest()))
    assert changed > 5 and any(w[1] > 1 for w in want)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert periodic_runs.run_digests(docs.limit(0)).collect() == []
    out = {r.doc_id: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert out[4].collapsed == "a" and [tuple(x) for x in out[4].runs] == [(0, 100, 1)]


# ---- hard negatives

def negatives_by_scores(rows, divisor, scale=256):
    rows = {(i, tuple(x), c) for i, x, c in rows if None not in (i, x, c) and all(v is not None and np.isfinite(v) for v in x)}
    rows = [(i, [int(np.floor(scale * v)) for v in x], c) for i, x, c in rows]
    rows = [(i, list(v), c) for i, v, c in {(i, tuple(v), c) for i, v, c in rows}]
    out = []
    for i, x, c in rows:
        if i % divisor:
            continue
        score = lambda y: sum(a * b for a, b in zip(x, y))  # noqa: E731, B023
        others = sorted((-score(y), j, d) for j, y, d in rows if j != i)
        for s, j, _ in [o for o in others if o[2] == c][:5]:
            for rank, (t, k, _) in enumerate([o for o in others if o[2] != c and 50 * s >= 100 * o[0] >= 95 * s][:3], 1):
                out.append((i, j, rank, k, -s, -t))
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, key string, v string, centre string, score string"


def vectors(seed, n, clusters):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(clusters, 6))
    rows = [[i, (around[i % clusters] + rng.normal(size=6) * 0.4).astype(np.float32).tolist(), int(rng.integers(4))] for i in range(n)]
    for i in range(0, n, 9):  # ties and copies
        rows[i][1] = rows[0][1]
    rows += [[n, None, 1], [n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1], [n + 2, [float("nan")] * 6, 1], [n + 3, [float("inf")] + [0.0] * 5, 2],
             [n + 4, [0.5] * 6, None], [None, [0.5] * 6, 1], [n + 6, [], 2], [n + 7, [3.0], 3], [n + 8, [0.0] * 6, 0], [-14, [0.7] * 6, 3],
             rows[3], rows[3], [rows[0][0], [0.1] * 6, 2]]
    return rows


@pytest.mark.parametrize("seed, n, clusters, members", [(1, 240, 3, 4), (2, 200, 1, 256), (3, 150, 40, 2)])
def test_hard_negatives(spark, monkeypatch, seed, n, clusters, members):
    monkeypatch.setattr(hard_negatives, "MEMBERS", members)  # several clusters and blocks
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 600)
    rows = vectors(seed, n, clusters)
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(table, F.expr("vec_id % 7 = 0")).collect()
    want = negatives_by_scores(rows, 7)
    assert want and sorted(map(tuple, got)) == want


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, F.expr("vec_id % 50 = 0")).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 2.0], 1, "", "", "", "")], VECTORS)
    assert hard_negatives.hard_negatives(alone, F.expr("vec_id % 50 = 0")).collect() == []


def test_walks_stop_early():
    """With directions that cluster, a member leaves most of the list unread."""
    rng = np.random.default_rng(0)
    centre = np.eye(8)[0]
    far = (rng.normal(size=(4000, 8)) * 20 - 300 * centre).astype(np.int64)
    near = (rng.normal(size=(64, 8)) * 20 + 300 * centre).astype(np.int64)
    read = []
    exact = hard_negatives.products
    hard_negatives.products = lambda a, b: read.append(len(b)) or exact(a, b)
    try:
        member = {"key": 1, "vec_id": -1, "label": 0, "v": near[0].tolist(),
                  "targets": [{"target": 0, "low": -(1 << 63), "high": (1 << 63) - 1, "need": -(1 << 63)}]}
        every = np.concatenate([far, near])
        found = hard_negatives.walk([member], np.arange(len(every)), every, 0, centre, True, 5)
    finally:
        hard_negatives.products = exact
    scores = every @ near[0]
    best = np.lexsort((np.arange(len(every)), -scores))[:5]
    assert sorted(found) == sorted((1, 0, int(scores[i]), int(i)) for i in best)
    assert sum(read) < len(every) / 10


def test_products_are_exact_for_large_components():
    a = np.array([[3_000_000_000, -1]]), np.array([[3_000_000_001, 7]])
    assert hard_negatives.products(*a).tolist() == [[3_000_000_000 * 3_000_000_001 - 7]]


# ---- secret scan: the battery's tests

def battery(token, encoding):
    from netwatch.llm import secret_scan
    letters, shared = secret_scan._ALPHABETS[encoding], (10, 16, 32, 62, 62)[encoding]
    token = token.rstrip("=")
    token = token.lower() if encoding == 1 else token.replace("-", "+").replace("_", "/")
    x = np.array([letters.index(c) for c in token], float)
    n, freedom = len(x), 7
    cells = lambda v: np.bincount(np.minimum(8 * np.asarray(v) // shared, 7).astype(int), minlength=8)
    expected = n * cells(np.arange(len(letters))) / len(letters)
    chi = ((((cells(x) - expected) ** 2 / expected).sum() / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    x = np.minimum(4 * x // shared, 3)
    high = x >= 2
    mean = 2 * high.sum() * (~high).sum() / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (high[1:] != high[:-1]).sum()
    by_runs = (runs - mean) ** 2 / spread if spread > 0 else 100
    d = x - x.mean()
    serial = n * ((d[1:] * d[:-1]).sum() / (d ** 2).sum() + 1 / n) ** 2 if (d ** 2).sum() > 1e-6 else 100
    return max(chi, 0) ** 2 + by_runs + serial


def test_three_tests_against_numpy(spark):
    from netwatch.llm import secret_scan
    rng, rows = random.Random(2), []
    for encoding, letters in enumerate(secret_scan._ALPHABETS):
        for n in (20, 21, 40, 80, 300):
            for some in (letters, letters[:3], letters[:1]):
                rows.append((encoding, "".join(rng.choice(some) for _ in range(n)) + rng.choice(["", "==", "="])))
    rows += [(1, "0123456789ABCDEFABCD"), (4, "ab-_" * 10)]
    table = spark.createDataFrame(rows, "e int, t string")
    got = table.select("e", "t", secret_scan._battery(F.col("t"), F.col("e")).alias("score")).collect()
    for r in got:
        assert r.score == pytest.approx(battery(r.t, r.e), rel=1e-9, abs=1e-9), r


def test_each_encoding_has_its_own_ordinary_text(spark):
    """Runs of digits are everywhere here and look random: they are no findings, hex and base 62 strings are."""
    rng = random.Random(9)
    words = "the ing ion ent her tha ere ati ter hat face bead cafe".split()
    text = lambda: " ".join("".join(rng.choice(words) for _ in range(2)) + (
        f" {rng.randrange(10 ** 9)}" if rng.random() < 0.3 else "") for _ in range(300))
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, text()) for i in range(120)] + [(1000 + i, f"number {pick('0123456789', 40)} end") for i in range(20)]
    rows += [(2000 + i, f"value {pick(letters, 44)} end") for i in range(20)]
    from netwatch.llm import secret_scan
    found = {r.doc_id: r.spans for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc.doc_id", F.filter("spans", lambda s: s["kind"] == 3).alias("spans")).collect()}
    assert sum(bool(found[1000 + i]) for i in range(20)) <= 2
    assert sum(bool(found[2000 + i]) for i in range(20)) >= 17
    assert sum(bool(found[i]) for i in range(120)) <= 3


# ---- byte-level BPE of long pre-tokens

def test_long_pre_tokens_take_linear_time():
    import time

    import tiktoken

    from netwatch.llm import byte_bpe
    content = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = byte_bpe.parse_ranks(content)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(30_000))
    small = byte_bpe.Transducer(ranks, states=2_000)  # emptied many times inside the word
    assert list(small.encode(word.encode())) == known.encode_ordinary(word)
    begin = time.perf_counter()
    long = byte_bpe.Transducer(ranks).encode((word * 34).encode())
    assert time.perf_counter() - begin < 60
    assert len(long) > 300_000


def test_ids_that_share_a_character_decode_in_slices():
    from netwatch.llm import byte_bpe
    table = {0: b"a", 1: "\u20ac".encode()[:2], 2: "\u20ac".encode()[2:], 3: b"bc", 4: b"\xff"}
    decoder = byte_bpe.StreamDecoder(table)
    assert decoder.feed([0, 3, 1]) + decoder.feed([2, 0]) + decoder.feed([4, 3]) + decoder.close() == "abc\u20aca\ufffdbc"
