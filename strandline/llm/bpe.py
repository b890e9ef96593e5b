"""Byte-pair encoding and decoding with a public vocabulary.

The merge of least rank that neighbouring symbols of a word allow comes first,
leftmost among equals.  A short word's ranks are a list; a longer word's symbols form
a doubly linked list with a priority queue of ranks, in which an entry whose symbols
have changed since is skipped.  Decoding joins vocabulary strings.  Words are encoded
once per task while they stay in a bounded store, where what is in use stays longer.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import sha256
from .text import find_package, slices

#: Words that a task remembers in each of two halves of its store.
STORE = 60_000
#: Symbols up to which ranks are a list, characters up to which a word is remembered, and what leaves the id of a merge's rank and id.
SHORT, LONGEST, ID = 32, 64, (1 << 20) - 1
#: White space beyond ASCII, as Unicode has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def category_class(first: str) -> str:
    """A character class (without brackets) of all characters whose Unicode category starts with `first`."""
    marks = np.array([unicodedata.category(chr(c))[0] == first for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


class Known(dict):
    """What `make` gives for each word, remembered for the words met last: a word that is met again in the older half moves to the newer."""

    def __init__(self, make: Callable[[str], tuple[bytes, str]]):
        self.make = make
        self.older: dict[str, tuple[bytes, str]] = {}

    def __missing__(self, word: str) -> tuple[bytes, str]:
        have = self.older.get(word) or self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= STORE:
                self.older = dict(self)
                self.clear()
            self[word] = have
        return have


class Bpe:
    """A lower-casing word-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.first = [self.ids[c] for c in byte_symbols()]
        self.last = [self.ids[c + self.suffix] for c in byte_symbols()]
        letter, number = category_class("L"), category_class("N")
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.split = re.compile(f"{short}|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+")
        self.split_ascii = re.compile(f"{short}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.store = Known(self._encoded)

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        of, none = self.merges.get, sys.maxsize
        ranks = [of(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = new = best & ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = of((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = of((new, ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m, i, pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(pair))]
        heapify(queue)
        while queue:
            _, i, pair = heappop(queue)
            j = after[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue  # stale: one of the symbols is gone or has grown
            ids[i] = new = merges[pair] & ID
            ids[j] = -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heappush(queue, (m, i, (new, ids[k])))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heappush(queue, (m, h, (ids[h], new)))
        return [x for x in ids if x >= 0]

    def _encoded(self, word: str) -> tuple[bytes, str]:
        """The ids as 32-bit numbers, and the string they decode to."""
        own = self.encode_word(word)
        return array("i", own).tobytes(), " ".join([self.strings[i] for i in own])

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        # Character by character, so a final sigma is an ordinary one.
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit numbers, and the string they decode to."""
        found: list[tuple[bytes, str]] = []
        pieces = self.parts.split(text) if self.parts and "<|" in text else [text]
        for place, piece in enumerate(pieces):
            if place % 2:
                found.append((array("i", [self.special[piece]]).tobytes(), piece))
            else:
                found += map(self.store.__getitem__, self._words(piece))
        return b"".join([ids for ids, _ in found]), " ".join([s for _, s in found])


@lru_cache(2)
def load(path: str) -> Bpe:
    """Once for each Python worker."""
    return Bpe(path)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """Token ids of each whole text, and the text that they decode to.

    documents: doc_id, text; other columns are not read.  path: a tokenizer file
    that each executor can read.  Returns doc_id, ids (array of int), decoded.
    Strings of special tokens inside a text are these tokens, as the file's library
    has it.  A null or empty text has no ids and decodes to an empty string.  One
    row comes out for each row that goes in, repeated ones too.
    """
    find_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches):
            done = [bpe.encode(text or "") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in done)])
            flat = np.frombuffer(b"".join([ids for ids, _ in done]), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([s for _, s in done], pa.string())], ["doc_id", "ids", "decoded"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))
