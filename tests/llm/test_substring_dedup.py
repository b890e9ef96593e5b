"""Removal of repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import substring_dedup as sd
from strandline.llm.text import SPACED, words


def brute(docs, window):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode())):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone |= set(range(i, i + window))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


def run(spark, docs, window, anchor, parts=5):
    df = spark.createDataFrame([(t, i) for i, t in docs], "text string, doc_id bigint").repartition(parts)
    return list(map(tuple, sd.remove_repeats(df, window, anchor).collect()))


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_of_few_words(spark, seed):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdé") for _ in range(rng.randrange(40)))) for i in range(40)]
    rng.shuffle(docs)
    assert order(run(spark, docs, 6, 3)) == order(brute(docs, 6))


def test_long_passages_nulls_copies_and_long_texts(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(base) for _ in range(300_000))
    passage = " ".join(base[:60])
    docs = [(7, None), (8, ""), (9, " \t\n"), (1, long), (2, "x " + passage + "\ny"), (3, passage), (4, passage.upper()), (5, long[500:5000]), (6, "a\x0bb\x0cc d")]
    docs += [(100 + i, "hot " * 30 + f"own{i} " + passage) for i in range(60)]
    assert order(run(spark, docs, 20, 8)) == order(brute(docs, 20))


def test_shared_and_missing_doc_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = [(1, t), (1, t + " more"), (None, t), (None, None), (0, "z " + t)]
    assert order(run(spark, docs, 20, 8)) == order(brute(docs, 20))


def test_empty_table(spark):
    assert run(spark, [], 20, 8) == []


@pytest.mark.parametrize("cells", [64, 1e-6])
def test_sketch_wide_or_full_of_collisions(spark, cells):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 9, 400])))) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = sd.remove_repeats(df, 5, 2, cells=cells)
    assert order(map(tuple, got.collect())) == order(brute(docs, 5))


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([30, 500, 3000])))) for i in range(12)]
    keyed = spark.createDataFrame(docs, "key bigint, text string")
    for whole in words(pa.array([t for _, t in docs]), SPACED, max_bytes=1):
        for overlap, most in ((4, 7), (5, 100)):
            parts = list(whole.parts(overlap, most))
            starts = [p.base + s for p in parts for s in p.starts(overlap + 1).tolist()]
            assert starts == whole.starts(overlap + 1).tolist()
            assert np.concatenate([p.windows(overlap + 1) for p in parts]).tolist() == whole.windows(overlap + 1).tolist()
            assert all((p.same_words(np.array([0]), overlap + 1) == whole.same_words(np.array([p.base]), overlap + 1)).all() for p in parts)
    assert keyed.count() == 12


def test_words_that_collide_modulo_powers_of_two(spark):
    """A Thue-Morse word and its complement have equal polynomials modulo 2**64, whatever the base."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    docs = [(1, " ".join([one, *(f"w{i}" for i in range(19))])), (2, " ".join([other, *(f"w{i}" for i in range(19))])), (3, " ".join([other, *(f"w{i}" for i in range(19))]))]
    assert order(run(spark, docs, 20, 8)) == order(brute(docs, 20))


def test_one_exchange_of_the_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = sd.remove_repeats(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange [key" in plan and "doc_id" in plan.split("ReusedExchange [")[1].split("]")[0]
