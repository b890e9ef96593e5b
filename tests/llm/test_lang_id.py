"""Language identification: the forward pass against all segmentations, learning on held-in documents only."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from strandline.llm import lang_id as li  # noqa: E402


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁a", "a", "b", "ab", "▁ab", "▁", "ba", "bab"]
    table = np.vstack([rng.random((len(pieces), 2)), [[1e-7, 1e-7]]])
    segmenter = li.Segmenter(pieces, table)
    words = ["a", "ab", "abab", "bab", "xab", "abba"]
    for word, got in zip(words, segmenter.log_probabilities(words)):
        want = np.zeros(2)
        n = len(word)
        for cuts in itertools.product([0, 1], repeat=n - 1):
            edges = [0, *(i + 1 for i in range(n - 1) if cuts[i]), n]
            p = np.ones(2)
            for a, b in itertools.pairwise(edges):
                s = word[a:b] if a else "▁" + word[:b]
                p = p * (table[pieces.index(s)] if s in pieces else table[-1] if b == a + 1 else 0)
            want += p
        assert np.allclose(got, np.log(want))
    counts = np.ones((len(words), 2))
    total = segmenter.expected(words, counts)
    lengths = np.array([len(p.strip("▁")) for p in pieces] + [1])
    # A marked piece of one letter and an unmarked one both cover one letter.
    assert np.allclose((total * lengths[:, None]).sum(axis=0), sum(map(len, words)))


def test_learns_tells_apart_and_ignores_labels(spark):
    rng = random.Random(6)
    parts = {"aa": ["the", "ing", "and", "th"], "bb": ["ção", "que", "os", "do"], "cc": ["sch", "ein", "und", "ß"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? ²", "aa"), (1003, "THE ING AND", None), (None, "sch ein", "cc"), (1004, "x" * 100_000, "aa")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in li.query(df, P.path("piece_bpe_32k.model"), sample=50).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:240])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and got[None].lang_pred == "cc"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got.values())
    assert li.query(df.limit(0), P.path("piece_bpe_32k.model")).collect() == []
    assert {r.lang_pred for r in li.query(df.filter("doc_id = 1003"), P.path("piece_bpe_32k.model")).collect()} == {"und"}


def test_long_words_sum_all_segmentations_too():
    rng = np.random.default_rng(3)
    pieces = ["▁a", "a", "b", "ab", "▁ab", "ba", "bab", "abba", "▁bb"]
    segmenter = li.Segmenter(pieces, np.vstack([rng.random((len(pieces), 3)) / 9, [[1e-7] * 3]]))
    for word in ("ab" * 4, "abbaxbab", "b", "x" * 9, "abbabaab" * 3):
        assert np.allclose(segmenter.log_probability(word), segmenter.log_probabilities([word])[0]), word
    long = segmenter.log_probability("abba" * 5000)
    assert np.isfinite(long).all() and (long < -1000).all()
    assert np.allclose(long - segmenter.log_probability("abba" * 4000), segmenter.log_probability("abba" * 4000) - segmenter.log_probability("abba" * 3000))


def test_words_without_spaces_and_many_languages(spark):
    rng = random.Random(2)
    parts = {f"l{i:03}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in "aeiou"] for i in range(60)}
    rows = [(i, "".join(rng.choice(parts[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(parts) * 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = [r for r in li.query(df, P.path("piece_bpe_32k.model")).collect() if r.held_out]
    right = sum(r.lang_pred == rows[r.doc_id][2] for r in got)
    assert right >= 0.9 * len(got)
