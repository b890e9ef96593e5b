"""Importance resampling against runs put together word by word."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from strandline.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, runs + 1) if i + k <= len(w)]


def brute(docs, target, runs, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(doc_id, *features(text, runs)) for doc_id, text in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, runs)[1])
    a, z = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (a + buckets) / ((s[b] + 1.0) * (z + buckets))))
    rows = []
    for doc_id, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(may[: percent * len(may) // 100])}
    return sorted((*r, rank.get(r[0])) for r in rows)


def test_random_texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)] + ["É", "straße", "A", "x-y", "1.5", " "]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(80))) for i in range(400)] + [(400, None), (401, ""), (402, "..."), (403, text(50) + " " + "z" * 5000)]
    target = [text(30) for _ in range(20)] + [None, ""]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id bigint, text string, rank int, features string").repartition(5)
    b = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id bigint, text string").repartition(3)
    for runs, buckets, least, percent in ((1, 10_000, 20, 10), (3, 500, 20, 33), (4, 7, 0, 100)):
        got = im.resample(d, b, runs, buckets, least, percent)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect())) == brute(docs, target, runs, buckets, least, percent, im.SEED), (runs, buckets)


def test_ties_repeats_and_empty_tables(spark):
    same = " ".join(f"w{i}" for i in range(25))
    docs = [(i, same) for i in range(50)]
    d = spark.createDataFrame([*docs, (7, same), (None, same)], "doc_id bigint, text string")
    none = d.limit(0)
    got = im.resample(d, none, percent=50).collect()
    assert len(got) == 52 and sorted(r.rank for r in got if r.rank) == list(range(1, 27))
    seven = [r for r in got if r.doc_id == 7]
    assert len({(r.weight, r.score) for r in seven}) == 1
    assert im.resample(none, none).count() == 0 and im.resample(none, d).count() == 0
    ranks = {r.doc_id: r.rank for r in im.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), none, percent=100).collect()}
    scores = {r[0]: r[4] for r in brute(docs, [], 1, 10_000, 20, 100, im.SEED)}
    assert sorted(ranks, key=ranks.get) == sorted(scores, key=lambda i: (-scores[i], i))
    assert im.drawn(d, im.resample(d, none)).columns == ["doc_id", "text"]


def test_blocks_of_a_long_text(monkeypatch, spark):
    """Runs over the edges of the blocks that a long text is cut into."""
    monkeypatch.setattr(im, "BLOCK", 50)
    text = " ".join(f"word{i % 37}" for i in range(500)) + "  x"
    ring = im.Ring(3)
    states = [s for block in im.word_blocks(text) for s in ring.feed(block)]
    assert Counter(states) == Counter(zlib.crc32(f.encode()) for f in features(text, 3)[1])
    assert sum(map(len, im.word_blocks(text))) == 501 and list(im.word_blocks(None)) == []
