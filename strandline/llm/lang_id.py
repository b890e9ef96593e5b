"""Language of whole texts by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary (and every single character).
Per language each piece has a probability, learned by expectation maximisation
from the words of a bounded sample of labelled documents; a word's probability
under a language is the sum over all its segmentations into pieces, by a forward
pass.  A text's score is the product over its words, under equal priors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import category_class
from .columns import lowest
from .text import find_package, slices

#: Labelled documents per language that are learned from, at most; rounds of learning.
SAMPLE, ROUNDS = 400, 3
#: Letters of a word up to which words are scored together; a longer one is scored alone, letter by letter.
LONGEST = 24
#: Scores of words that a task remembers: words times languages, at eight bytes.
STORE = 800_000
#: Added to each piece's expected count; probability of a character that is no piece.
SMOOTH, UNKNOWN = 0.05, 1e-7
MARK = "▁"


@lru_cache(1)
def letters() -> re.Pattern:
    return re.compile(f"[{category_class('L')}]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    if text.isascii():
        return re.findall("[a-z]+", text.lower())
    return letters().findall(unicodedata.normalize("NFC", text).lower())


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary that consist of letters, with or without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    return sorted(p for p in pieces if p.lstrip(MARK).isalpha() and p.count(MARK) <= 1)


class Segmenter:
    """All segmentations of words at once, words of one length at a time.

    table: probability of each piece (row) under each language (column); the last row
    stands for a character that is no piece.
    """

    def __init__(self, pieces: list[str], table: np.ndarray):
        import ahocorasick

        self.longest = max(map(len, pieces), default=1)
        self.table = table
        self.index = {p: i for i, p in enumerate(pieces)}
        self.automaton = ahocorasick.Automaton()
        for row, piece in enumerate(pieces):
            self.automaton.add_word(piece, (row, len(piece)))
        self.automaton.make_automaton()

    def pieces_of(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, piece) of a long word, in order of the end, in letters; the word-start mark is part of the first piece."""
        last, single, unknown = 0, False, len(self.table) - 1
        for end, (row, size) in self.automaton.iter(MARK + word) if len(self.automaton) else ():
            start = max(end + 1 - size, 0)  # in the marked word; a letter's own place there is its number plus one
            marked = start == 0
            start = 0 if marked else start - 1
            if end == 0 or start == 0 and not marked:
                continue
            while last < end:  # ends that are past: each letter is a piece of its own if the vocabulary lacks it
                if last and not single:
                    yield last - 1, last, unknown
                last, single = last + 1, False
            single = single or start == end - 1
            yield start, end, row
        while last <= len(word):
            if last and not single:
                yield last - 1, last, unknown
            last, single = last + 1, False

    def _steps(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, which words, which piece), in order of the end, for words of one length."""
        n, unknown, get = len(words[0]), len(self.table) - 1, self.index.get
        marked = [MARK + w for w in words]
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = np.array([get(w[i + 1 : j + 1] if i else w[: j + 1], -1) for w in marked])
                if j == i + 1:
                    ids[ids < 0] = unknown
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    yield i, j, at, ids[at]

    def forward(self, words: list[str]) -> tuple[np.ndarray, list]:
        steps = list(self._steps(words))
        alpha = np.zeros((len(words[0]) + 1, len(words), self.table.shape[1]))
        alpha[0] = 1
        for i, j, at, ids in steps:
            alpha[j, at] += alpha[i, at] * self.table[ids]
        return alpha, steps

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """log P(word | language), for words of any lengths."""
        out = np.zeros((len(words), self.table.shape[1]))
        for own in by_length(words):
            if len(words[own[0]]) > LONGEST:
                for i in own:
                    out[i] = self.log_probability(words[i])
                continue
            alpha, _ = self.forward([words[i] for i in own])
            out[own] = np.log(np.maximum(alpha[-1], 1e-300))
        return out

    def log_probability(self, word: str) -> np.ndarray:
        """The same for one word of any length, in memory for the longest piece only: the state is scaled as it goes."""
        reach = self.longest + 1
        alpha, log = np.zeros((reach, self.table.shape[1])), np.zeros(self.table.shape[1])
        alpha[0] = 1
        at = 0
        for start, end, row in self.pieces_of(word):
            if end != at:
                if at and at % 8 == 0:
                    scale = np.maximum(alpha[at % reach], 1e-300)
                    alpha /= scale
                    log += np.log(scale)
                at = end
                alpha[at % reach] = 0
            alpha[end % reach] += alpha[start % reach] * self.table[row]
        return log + np.log(np.maximum(alpha[at % reach], 1e-300))

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece under each language, given word counts (words x languages)."""
        out = np.zeros_like(self.table)
        for own in by_length(words):
            alpha, steps = self.forward([words[i] for i in own])
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            share = counts[own] / np.maximum(alpha[-1], 1e-300)
            for i, j, at, ids in reversed(steps):
                flow = self.table[ids] * beta[j, at]
                beta[i, at] += flow
                np.add.at(out, ids, alpha[i, at] * flow * share[at])
        return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def learn(documents: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, table) from at most `sample` documents of each language.

    documents: doc_id, text, lang, of which those with a null in either are not used.
    The sample is that of the lowest hashes of doc_id; words of more than LONGEST letters
    are learned from in parts.  What the driver gets is one number for each piece and
    language, however many documents there are.
    """
    spark = documents.sparkSession
    find_package(spark)
    usable = documents.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    texts = lowest(usable.select("doc_id", "lang", "text"), "doc_id", sample, "lang").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w[i : i + LONGEST]) for w in words_of(text) for i in range(0, len(w), LONGEST))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["lang", "word", "n"])

    counted = texts.mapInArrow(count, "lang string, word string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")).cache()
    try:
        languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
        pieces = vocabulary(path)
        table = np.full((len(pieces) + 1, len(languages)), 1 / max(len(pieces), 1))
        table[-1] = UNKNOWN
        for _ in range(rounds if languages else 0):
            now = spark.sparkContext.broadcast((languages, pieces, table))

            def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                languages, pieces, table = now.value
                total, segmenter = np.zeros_like(table), Segmenter(pieces, table)
                for batch in slices(batches):
                    counts = np.array([[n.get(x, 0) for x in languages] for n in map(dict, batch.column(1).to_pylist())], float)
                    if len(counts):
                        total += segmenter.expected(batch.column(0).to_pylist(), counts)
                rows, columns = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(total[rows, columns])], ["piece", "lang", "n"])

            sums = by_word.mapInArrow(expect, "piece bigint, lang bigint, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
            fresh = np.full_like(table, SMOOTH)
            for piece, lang, n in sums:
                fresh[piece, lang] += n
            table = fresh / fresh.sum(axis=0)
            table[-1] = UNKNOWN
            now.unpersist()
        return languages, pieces, table
    finally:
        by_word.unpersist()


def identify(documents: DataFrame, model: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each document, from its text alone.

    `und` and 0 for a null text or one without a letter, and where no language was
    learned.  The score is the posterior under equal priors; ties go to the language
    that sorts first.  One row comes out for each row that goes in.
    """
    spark = documents.sparkSession
    find_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, table = shared.value
        segmenter = Segmenter(pieces, table)
        place: dict[str, int] = {}
        store = STORE // max(len(languages), 1) + 1
        known = np.zeros((store, max(len(languages), 1)))
        for batch in slices(batches):
            counted = [Counter(words_of(t)) if t else Counter() for t in batch.column(1).to_pylist()]
            preds, scores = ["und"] * len(counted), np.zeros(len(counted))
            low = 0
            while low < len(counted) and languages:
                # As many texts as have new words that still fit; one text with more is scored alone.
                new: dict[str, None] = {}
                high = low
                while high < len(counted) and (high == low or len(place) + len(new) + len(counted[high]) <= store):
                    new.update((w, None) for w in counted[high] if w not in place)
                    high += 1
                if len(place) + len(new) > store:
                    place, new, high = {}, dict.fromkeys(counted[low]), low + 1
                    if len(new) > len(known):
                        known = np.zeros((len(new), len(languages)))
                if new:
                    known[len(place) : len(place) + len(new)] = segmenter.log_probabilities(list(new))
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                for i in range(low, high):
                    if own := counted[i]:
                        logs = np.array(list(own.values())) @ known[[place[w] for w in own]]
                        best = int(np.argmax(logs))
                        preds[i], scores[i] = languages[best], 1 / np.exp(logs - logs[best]).sum()
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Whether a document is kept from learning: a fifth, by its id; a row without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(documents: DataFrame, path: str, **limits) -> DataFrame:
    """The contract's columns: learned on the documents that are not held out, applied to all."""
    model = learn(documents.filter(~held_out()), path, **limits)
    return identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
