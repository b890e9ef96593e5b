"""Words of many texts at once, as numpy arrays over Arrow string buffers.

A batch of texts is one byte buffer with offsets.  Words are runs of word bytes
inside one text.  A word's hash is made of two polynomials over its bytes modulo two
primes, so unlike polynomials modulo a power of two no two words are bound to
collide; the hash of k neighbouring words is a tree of mixed word hashes.
Everything is exact integer arithmetic, so equal words have equal hashes in every
batch, task and run.  Where equality must be certain, `same_words` gives a
cryptographic digest of the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are hashed at once; words of a long text that are worked on at once; rows that are.
CHUNK_BYTES, PART_WORDS, ROWS = 1 << 19, 1 << 17, 1000

# Primes under 2**31, a base for each, and odd multipliers.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_566_083_941)
PAIR, PAIR_2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def byte_table(separators: bytes | None = None, letters: str | None = None) -> np.ndarray:
    """Which bytes belong to words: all but `separators`, or ASCII `letters` and all bytes from 0x80."""
    table = np.zeros(256, bool)
    if separators is not None:
        table[:] = True
        table[list(separators)] = False
    else:
        table[list(letters.encode())] = True
        table[0x80:] = True
    return table


#: Words are what lies between white space.
SPACED = byte_table(separators=b" \t\n\x0b\x0c\r")
#: Words are runs of letters, digits and non-ASCII characters, in lower case.
ALNUM = byte_table(letters="0123456789abcdefghijklmnopqrstuvwxyz")
#: ASCII lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime: base**i and base**-i modulo the prime, for i up to CHUNK_BYTES."""
    if not _powers:
        for prime, base in zip(PRIMES, BASES, strict=True):
            both = []
            for b in (base, pow(base, -1, prime)):
                up = np.ones(1, np.uint64)
                while len(up) <= CHUNK_BYTES:
                    up = np.concatenate([up, up * np.uint64(pow(b, len(up), prime)) % np.uint64(prime)])
                both.append(up)
            _powers.append(tuple(both))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of a run of texts.

    data: the texts' bytes (in lower case if asked for); first, last: each word's
    byte range; at: text i has the words at[i]:at[i + 1]; hashes: one per word;
    rows: which rows of the batch these texts are; base: the number of the run's
    first word in its text (see parts()).
    """

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    rows: range
    base: int = 0

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text in this run."""
        return np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), self.counts())

    def starts(self, k: int, text_of: np.ndarray | None = None) -> np.ndarray:
        """Word indices at which k words of one text start."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        if len(self.at) == 2:
            return np.arange(n)
        text_of = self.text_of() if text_of is None else text_of
        return np.flatnonzero(text_of[:n] == text_of[k - 1 :])

    def windows(self, k: int, by: int = PAIR) -> np.ndarray:
        """Hashes of k words from each word on (also across texts; see starts())."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        level, size, out, done = self.hashes, 1, None, 0
        while True:  # of 1, 2, 4, ... words; those in k are joined in turn
            if k & size:
                out = level[:n] if out is None else mix(out * np.uint64(by) + level[done : done + n])
                done += size
            if 2 * size > k:
                return out
            level = mix(level[:-size] * np.uint64(by) + level[size:])
            size *= 2

    def word(self, i: int) -> str:
        return self.data[self.first[i] : self.last[i]].tobytes().decode("utf-8", "replace")

    def joined(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """The words of each text joined by one space, and where each word begins and ends there."""
        keep = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(keep, self.first, 1)
        np.add.at(keep, self.last, -1)
        keep = np.cumsum(keep, dtype=np.int8).astype(bool)
        keep[self.last[self.last < len(self.data)]] = True  # the byte after a word, unless that is a word of the next text
        place = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        own = self.data[keep[:-1]]
        ends = place[self.last]
        between = np.ones(len(ends), bool)
        between[:-1] = self.last[:-1] != self.first[1:]
        gaps = ends[between & (ends < len(own))]
        own[gaps] = 32
        return memoryview(own), place[self.first], ends

    def same_words(self, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """n x 2 numbers: a 128-bit BLAKE2 digest of the k words from each of `starts` on, which lie in one text."""
        text, first, last = self.joined()
        own = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(first[starts].tolist(), last[starts + k - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(own), np.uint64).reshape(-1, 2)

    def parts(self, overlap: int, most: int = PART_WORDS) -> Iterator[Words]:
        """The run itself; a text of very many words in parts, each with the first `overlap` words of the next one."""
        n = len(self.hashes)
        if len(self.at) != 2 or n <= most + overlap:
            yield self
            return
        for low in range(0, n - overlap, most):
            high = min(n, low + most + overlap)
            a, b = int(self.first[low]), int(self.last[high - 1])
            yield replace(self, data=self.data[a:b], first=self.first[low:high] - a, last=self.last[low:high] - a, at=np.array([0, high - low]), hashes=self.hashes[low:high], base=self.base + low)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def runs(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows of a string array with their bytes and offsets, in runs of bounded size; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        yield range(low, high), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _block(data: np.ndarray, begins: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """first, last and, for each prime, the polynomial of each word in at most CHUNK_BYTES bytes; begins: where texts begin."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
    values, total, own = data.astype(np.uint64) + np.uint64(1), np.zeros(n + 1, np.uint64), []
    for prime, (up, down) in zip(PRIMES, powers(), strict=True):
        np.cumsum(values * up[:n], out=total[1:])  # under 2**8 * 2**31 * 2**19
        own.append((total[last] - total[first]) % np.uint64(prime) * down[first] % np.uint64(prime))
    return first, last, own


def _hashed(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, last, hash of each word, block by block; a word that reaches over blocks is put together."""
    found: tuple[list, list, list] = [], [], []
    tail: list[int] = []  # start and polynomials of a word that reached the end of the block before

    def add(first, last, own) -> None:
        hashes = mix(np.asarray(own[0], np.uint64) << np.uint64(32) | np.asarray(own[1], np.uint64))
        for held, x, kind in zip(found, (first, last, hashes), (np.int32, np.int32, np.uint64), strict=True):
            held.append(np.asarray(x, kind))

    for low in range(0, len(data), CHUNK_BYTES):
        block = data[low : low + CHUNK_BYTES]
        begins = np.zeros(len(block) + 1, bool)
        begins[offsets[(offsets >= low) & (offsets <= low + len(block))] - low] = True
        first, last, own = _block(block, begins, is_word)
        first, last = first + low, last + low
        if tail and len(first) and first[0] == low and not begins[0]:
            for h, part, prime, base in zip(own, tail[1:], PRIMES, BASES, strict=True):
                h[0] = (part + int(h[0]) * pow(base, low - tail[0], prime)) % prime
            first[0] = tail[0]
        elif tail:
            add([tail[0]], [low], [[h] for h in tail[1:]])
        tail = []
        if len(last) and last[-1] == low + len(block):
            tail = [int(first[-1]), *(int(h[-1]) for h in own)]
            first, last, own = first[:-1], last[:-1], [h[:-1] for h in own]
        add(first, last, own)
    if tail:
        add([tail[0]], [len(data)], [[h] for h in tail[1:]])
    if not found[0]:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64)
    out = []
    for held in found:  # one at a time: the pieces of a very long text go as the whole is made
        out.append(np.concatenate(held) if len(held) > 1 else held[0])
        held.clear()
    return tuple(out)


def words(texts: pa.Array, is_word: np.ndarray, lower: bool = False, max_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of the texts, run by run.

    A longer text is a run of its own; beside its bytes that takes sixteen bytes a word.
    """
    for rows, data, offsets in runs(texts, max_bytes):
        if lower:
            data = LOWER[data]
        first, last, hashes = _hashed(data, offsets, is_word)
        yield Words(data, first, last, np.searchsorted(first, offsets.astype(np.int32)), hashes, rows)


def find_package(spark: SparkSession) -> None:
    """Let Python workers find the folder that this package was imported from.

    For sessions that were started elsewhere; on a cluster without that folder, ship the
    package as any other (--py-files).
    """
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [paths.get("PYTHONPATH"), root]))
