"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

Encoding. A tokenisation is the BPE result of its bytes exactly if every token is the BPE result of its own bytes and
every adjacent pair that of the pair's bytes. So the last token of each prefix follows from the last tokens of shorter
prefixes, and encoding is a left-to-right automaton. A state is (last emitted token, bytes read since); its transitions are
worked out on first use and kept. A token is emitted as soon as every start that a vocabulary entry could still
extend lies on the far side of it: the lookahead is bounded by the longest entry.

Decoding. Ids come in any slices. The decoder's state is the unfinished UTF-8 sequence (at most three bytes). A slice that holds
only complete characters besides is decoded at once, any other by a byte automaton. Malformed bytes become U+FFFD in the text;
the bytes themselves are returned as they are.

Texts are cut at white-space runs first, where the pre-tokeniser pattern can never span, and each
piece is looked up in a table of bounded size before the transducer runs.

Defined results: null and empty texts have no ids and decode to nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwatch.llm.common import worker_store

#: States a worker keeps by default; a worker needs about 1.2 KB a state with the other tables.
TABLES = 450_000
#: The characters that the pattern's \s matches.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def read_ranks(path: str) -> bytes:
    """The rank file's content; it is read on the driver, so executors need no copy of it."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Transducer:
    """Deterministic byte transducer over the ranks. ``states`` bounds the transitions kept; beyond it the table is
    emptied and built anew."""

    def __init__(self, ranks: dict[bytes, int], states: int = 450_000):
        self.ranks, self.limit = ranks, states
        self.bytes = {r: t for t, r in ranks.items()}
        # The entries as a tree: node << 8 | byte -> child, the entry a node spells (-1: none), whether any goes on from it.
        self.tree: dict[int, int] = {}
        self.spelt, self.inner = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                child = self.tree.setdefault(node << 8 | byte, len(self.spelt))
                if child == len(self.spelt):
                    self.spelt.append(-1)
                    self.inner.append(0)
                node = child
            self.spelt[node] = rank
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self, keep: tuple[int, bytes, tuple] | None = None) -> int:
        """Empties the tables. A state to go on from is kept; its new number is returned."""
        self.ids: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        # Last emitted token, bytes since, and (start, tokens up to it, place in the tree) of each start that can still be used.
        self.nodes: list[tuple[int, bytes, tuple]] = [(-1, b"", ((0, (), 0),))]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        if keep is None or keep[:2] == (-1, b""):
            return 0
        self.ids[keep[:2]] = 1
        self.nodes.append(keep)
        return 1

    def merged(self, text: bytes, least: int = 1) -> list[bytes]:
        """BPE by definition, down to ``least`` parts: join the pair of lowest rank, leftmost first. Only ever called on a token."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one; none for a single byte."""
        text = self.bytes[token]
        if len(text) == 1:
            return None
        if token not in self.halves:
            left, right = self.merged(text, 2)
            self.halves[token] = self.ranks[left], self.ranks[right]
        return self.halves[token]

    def reachable(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = len(self.merged(self.bytes[token])) == 1
        return self.whole[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side in the BPE result of their bytes; left is negative at the start of a text."""
        if len(self.pairs) > 4 * self.limit:
            self.pairs.clear()
        fits = self.reachable(right)
        if fits and left >= 0:
            fits = self.apart(left, right)
        self.pairs[left, right] = fits
        return fits

    def apart(self, left: int, right: int) -> bool:
        """Whether no join crosses the border of two tokens that BPE makes of their own bytes. Their joins are undone, latest first;
        what then touches the border would have been joined before the join just undone if its rank is lower, or equal and
        further left."""
        ranks, spell = self.ranks, self.bytes
        before = 1 << 40  # a join across the border with a lower rank comes before the one just undone
        while True:
            if ranks.get(spell[left] + spell[right], 1 << 40) < before:
                return False
            of_left, of_right = self.split(left), self.split(right)
            if of_left is None and of_right is None:
                return True
            # At equal ranks the left one is joined first, so the right one is undone first.
            if of_right is None or (of_left is not None and left > right):
                before, left = left, of_left[1]
            else:
                before, right = right + 1, of_right[0]

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Works out one transition: the next state and the tokens it emits."""
        last, held, starts = self.nodes[state]
        text = held + bytes((byte,))
        live, found = [], None
        tree, spelt, inner, pairs = self.tree, self.spelt, self.inner, self.pairs
        for start, tokens, node in starts:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            if found is None:
                token = spelt[node]
                if token >= 0:
                    before = tokens[-1] if tokens else last
                    fits = pairs.get((before, token))
                    if self.adjacent(before, token) if fits is None else fits:
                        found = (*tokens, token)
            if inner[node]:
                live.append((start, tokens, node))
        # Tokens that all usable starts agree on are final; a start that stands for itself agrees on none.
        shared = len(found)
        for _, tokens, _ in live:
            shared = min(shared, len(tokens))
            while tokens[:shared] != found[:shared]:
                shared -= 1
            if not shared:
                break
        live.append((len(text), found, 0))
        out = found[:shared]
        if shared:
            last, cut = out[-1], sum(len(self.bytes[t]) for t in out)
            text = text[cut:]
            live = [(start - cut, tokens[shared:], node) for start, tokens, node in live]
        key = (last, text)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.nodes)
            self.nodes.append((last, text, tuple(live)))
        move = self.moves[state << 8 | byte] = (to, out)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. An entry of the vocabulary stands for itself."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        state, out, moves = 0, [], self.moves
        for byte in piece:
            try:
                state, emitted = moves[state << 8 | byte]
            except KeyError:
                if len(self.nodes) > self.limit:
                    state = self.reset(self.nodes[state])
                    moves = self.moves
                state, emitted = self.move(state, byte)
            if emitted:
                out += emitted
        return (*out, *self.nodes[state][2][-1][1])


class Pieces(dict):
    """White-space-led piece of text -> ids. When full, the table becomes the older half and is refilled from it, so
    memory is bounded and frequent pieces stay. Pre-tokens that pieces share, such as a word with and without a comma, have a table
    of their own."""

    def __init__(self, transducer: Transducer, pattern: str, limit: int):
        super().__init__()
        self.limit = limit
        self.transducer, self.pattern = transducer, regex.compile(pattern)
        self.older, self.tokens, self.older_tokens = {}, {}, {}

    def _token(self, token: str) -> tuple[int, ...]:
        ids = self.older_tokens.get(token)
        if ids is None:
            ids = self.transducer.encode(token.encode())
        if len(self.tokens) >= self.limit:
            self.older_tokens, self.tokens = self.tokens, {}
        self.tokens[token] = ids
        return ids

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            if len(piece) > 200:
                return tuple(chain.from_iterable(self.transducer.encode(t.encode()) for t in self.pattern.findall(piece)))
            parts = self.pattern.findall(piece)
            known = self.tokens.get
            ids = (known(parts[0]) or self._token(parts[0])) if len(parts) == 1 else tuple(
                chain.from_iterable(known(t) or self._token(t) for t in parts))
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class StreamDecoder:
    """Incremental decoder: ``feed`` takes any slice of ids and returns the complete characters so far."""

    def __init__(self, table: dict[int, bytes]):
        self.table, self.pending = table, b""

    @staticmethod
    def _needed(first: int) -> tuple[int, int, int]:
        """For a first byte: length of its sequence, and the range of the second byte. Length 0: malformed."""
        if first < 0x80:
            return 1, 0, 0
        if 0xC2 <= first <= 0xDF:
            return 2, 0x80, 0xBF
        if 0xE0 <= first <= 0xEF:
            return 3, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
        if 0xF0 <= first <= 0xF4:
            return 4, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
        return 0, 0, 0

    def _walk(self, data: bytes) -> tuple[str, bytes]:
        out, at = [], 0
        while at < len(data):
            size, low, high = self._needed(data[at])
            end = at + 1
            while size and end < min(at + size, len(data)) and (
                    (low <= data[end] <= high) if end == at + 1 else 0x80 <= data[end] <= 0xBF):
                end += 1
            if size and end == at + size:
                out.append(data[at:end].decode())
            elif size and end == len(data):
                return "".join(out), data[at:]
            else:
                out.append("�")
            at = end
        return "".join(out), b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(map(self.table.__getitem__, ids))
        # The sequence that the slice leaves open: a first byte among the last three whose sequence needs more bytes than follow.
        end = len(data)
        for at in range(end - 1, max(end - 4, -1), -1):
            if data[at] >= 0xC0:
                if self._needed(data[at])[0] > end - at:
                    end = at
                break
        try:
            out, self.pending = data[:end].decode(), data[end:]
        except UnicodeDecodeError:
            pass
        else:
            if not self.pending or not self._walk(self.pending)[0]:
                return out
        # Malformed bytes: a byte automaton finds them.
        out, self.pending = self._walk(data)
        return out

    def close(self) -> str:
        """What an unfinished sequence at the end stands for."""
        rest, self.pending = self.pending, b""
        return "�" if rest else ""


def codec(content: bytes, pattern: str, tables: int = TABLES) -> tuple[Pieces, dict[int, bytes]]:
    """Tables of a worker: ``tables`` bounds the states kept, and two thirds of it the pieces and pre-tokens."""
    key = sha256(content + f"{pattern} {tables}".encode()).hexdigest()
    store = worker_store()
    if key not in store:
        transducer = Transducer(parse_ranks(content), tables)
        store[key] = (Pieces(transducer, pattern, tables * 2 // 3), transducer.bytes)
    return store[key]


def encode(text: str, pieces: Pieces) -> list[int]:
    return list(chain.from_iterable(map(pieces.__getitem__, _PIECE.findall(text))))


def _encode(batches: Iterator[pa.RecordBatch], content, pattern: str, tables: int) -> Iterator[pa.RecordBatch]:
    """(id, ids): the ids of each text."""
    pieces, _ = codec(content.value, pattern, tables)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            ids = [encode(t or "", pieces) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _digest(batches: Iterator[pa.RecordBatch], content, pattern: str, tables: int) -> Iterator[pa.RecordBatch]:
    """Digests of the ids and of what the streaming decoder makes of them, slice by slice."""
    pieces, table = codec(content.value, pattern, tables)
    decoder = worker_store().setdefault(("decoder", id(table)), StreamDecoder(table))
    names = worker_store().setdefault(("names", id(table)), {i: str(i) for i in table})
    for batch in batches:
        counts, of_ids, of_bytes = [], [], []
        for text in batch.column(1):
            ids = encode(text.as_py() or "", pieces)
            back = sha256()
            decoder.pending = b""
            for at in range(0, len(ids), 4096):
                back.update(decoder.feed(ids[at:at + 4096]).encode())
            back.update(decoder.close().encode())
            counts.append(len(ids))
            of_ids.append(sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(back.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                                          pa.array(of_bytes, pa.string())],
                                         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
                     tables: int = TABLES) -> DataFrame:
    """(doc_id, ids) by the rank file at ``path``; texts stay where they are, nothing is shuffled."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        partial(_encode, content=content, pattern=pattern, tables=tables), "doc_id long, ids array<int>")


def encoding_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
                     text: str = "text", tables: int = TABLES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded as a stream."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        partial(_digest, content=content, pattern=pattern, tables=tables),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
