"""Ids of whole texts by a file of the tokenizers library, each distinct word encoded once a worker.

White space separates pre-tokens, and nothing the tokenizer does to a text (composition, lower-casing, splitting, merging) reaches
across it, so a text's ids are those of its words in a row. Words are looked up in a table of bounded size; those it lacks are cut into
a core of Latin letters and the punctuation behind it, which are pre-tokens of their own; a core needs the library's merges only,
since it is normalised already. All other words go through the library whole. A file whose normaliser, splitter or added tokens
differ from those this holds for is given whole texts.

Ids are bytes, four to an id, little-endian: joining them is all that a text takes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from hashlib import sha256

import numpy as np

from netwatch.llm.common import worker_store

#: The normaliser and splitter that the reasoning above holds for, as tokenizer files state them.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Letters that lower-case to one letter and compose with nothing, then punctuation without the apostrophe (contractions).
CORE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte-level alphabet: a printable byte stands for itself, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}
#: Python's split also cuts at these, which are no white space to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_CUT = re.compile("[ \n]+")


class _Table(dict):
    """Word -> ids; a word it lacks goes to ``learn``."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class WordIds:
    """``limit`` bounds the words kept; a full table becomes the older half and is refilled from it."""

    def __init__(self, vocabulary: bytes, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        self.table = _Table(self._learn)
        self.older: dict[str, bytes] = {}
        self.limit = limit
        stated = json.loads(vocabulary)
        added = [t["content"] for t in stated.get("added_tokens") or []]
        self.by_words = (
            stated.get("normalizer") == NORMALIZER and stated.get("pre_tokenizer") == PRE_TOKENIZER
            and stated["model"]["type"] == "BPE" and sys.byteorder == "little" and array("I").itemsize == 4
            and not (stated.get("truncation") or stated.get("padding"))
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in stated.get("added_tokens") or [])
            and not any(re.search(r"\s", t) or CORE.fullmatch(t) for t in added))

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _core(self, core: str) -> bytes:
        """Ids of a lower-case word of letters, which is one pre-token, by the library's merges alone."""
        spelt = core if core.isascii() else "".join(map(BYTE_CHARS.__getitem__, core.encode()))
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def _learn(self, word: str) -> bytes:
        """Ids of a word that the table lacks; words of up to 100 letters are kept."""
        table, older = self.table, self.older
        ids = older.get(word)
        if ids is None:
            parts = CORE.fullmatch(word)
            if parts is None:
                ids = self._ask([word])[0]
            else:
                core, tail = parts.groups()
                core = core.lower()
                ids = (table.get(core) or older.get(core) or self._part(core, self._core)) if core != word else self._core(core)
                if tail:
                    ids += table.get(tail) or older.get(tail) or self._part(tail, lambda t: self._ask([t])[0])
        if len(word) <= 100:
            self._keep(word, ids)
        return ids

    def _part(self, part: str, ask: Callable[[str], bytes]) -> bytes:
        ids = ask(part)
        if len(part) <= 100:
            self._keep(part, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.table) >= self.limit:  # emptied in place: a text's look-ups go on in the same table
            self.older = dict(self.table)
            self.table.clear()
        self.table[word] = ids

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text; words that the table lacks are learnt as they come."""
        if not self.by_words:
            return self._ask(list(texts))
        known = self.table.__getitem__
        return [b"".join(map(known, _CUT.split(t) if any(map(t.__contains__, _SEPARATORS)) else t.split())) for t in texts]


def word_ids(vocabulary: bytes, limit: int = 300_000) -> WordIds:
    """The worker's encoder of this file."""
    store, key = worker_store(), ("word ids", sha256(vocabulary).hexdigest())
    if key not in store:
        store[key] = WordIds(vocabulary, limit)
    return store[key]
