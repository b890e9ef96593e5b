"""Decontamination against window-by-window brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import decontam
from strandline.llm.text import PART_WORDS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(len(w) - 12, 1)) if w else ():
            wins.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = {}
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= got
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_windows_short_items_nulls_and_overlaps(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, "Straße ist kurz"), (3, None), (4, ""), (5, "..."), (10, passage), (6, "x x x x x x x x x x x x x x"), (7, "one")]
    docs = [
        (0, None), (1, ""), (2, passage.upper()), (3, "a b " + passage + " c " + passage), (4, "lead " + " ".join(f"w{i}" for i in range(12))),
        (5, "die straße ist kurz, die Straße ist kurz"), (6, "x " * 40), (7, "w " * 400 + passage), (8, " ".join(f"w{i}," for i in range(3, 17))), (9, "STRASSE ist kurz"), (10, "one"), (11, "two one"), (12, " one"),
    ]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, n_words string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in decontam.digest(decontam.decontaminate(d, b)).collect()}
    assert got == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert sorted(r[0] for r in decontam.decontaminate(d, none).collect()) == [1, 1, 2]
    assert decontam.decontaminate(d.limit(0), none).count() == 0
    small = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    rows = [(1, "a b c"), (1, "a b c"), (2, "a"), (None, "a b"), (None, "a b"), (None, "c d e"), (None, None), (None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit) for r in decontam.decontaminate(d, small).collect()), key=str)
    assert got == sorted([(1, 3, 2), (1, 3, 2), (2, 1, 0), (None, 2, 2), (None, 2, 2), (None, 3, 0), (None, 0, 0), (None, 0, 0)], key=str)


def test_blocks_give_the_same(spark):
    text = " ".join(f"v{i}" for i in range(60))
    d = spark.createDataFrame([(i, text[i:]) for i in range(20)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(i, i + 15))) for i in range(30)], "item_id bigint, text string")
    one = sorted(map(tuple, decontam.digest(decontam.decontaminate(d, b)).collect()))
    assert one == sorted(map(tuple, decontam.digest(decontam.decontaminate(d, b, block=9)).collect()))


def test_documents_without_finds_are_spread(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain "), "id").alias("text"))
    rows = decontam._scan(d.repartition(4), np.zeros(0, np.uint64), np.zeros(0, np.int64), 13, [5], True)
    assert rows.filter("shingle IS NULL").count() == 0 and rows.select("shingle").distinct().count() == 4000


def test_long_text_in_parts(spark):
    """Passages over the edges of the parts that a very long text is read in."""
    items = [(1, " ".join(f"w{i}" for i in range(30))), (2, "x y z"), (3, "q")]
    text = ["f"] * 300_000
    for edge in (PART_WORDS, 2 * PART_WORDS):
        text[edge - 9 : edge + 21] = [f"w{i}" for i in range(30)]
        text[edge + 40], text[edge - 500 : edge - 497] = "q", ["x", "y", "z"]
    docs = [(1, " ".join(text)), (2, "short")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in decontam.digest(decontam.decontaminate(d, b)).collect()}
    assert got == brute(docs, items) and got[1][1] == 2 * (30 + 1 + 3)


def test_null_texts_and_a_passage_in_every_document_are_spread(spark):
    """Half of the texts are null, the other half holds one passage: no key of the join has more than twice its share."""
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(i, None if i % 2 else passage + (f" own{i}" if i % 4 else "")) for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    shingle = np.sort(next(decontam.words(pa.array([passage]), decontam.ALNUM, lower=True)).windows(5)[:1])
    rows = decontam._scan(d, shingle, np.array([40]), 13, [5], True)
    keys = {tuple(r)[:3]: r.n for r in rows.groupBy(F.col("at") < 0, "shingle", "salt").agg(F.count("*").alias("n")).collect()}
    assert max(keys.values()) <= 2 * 2000 / 40 and len(keys) == 4000 + 40
    items = [(1, passage), (2, "w3 w4 w5")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in decontam.digest(decontam.decontaminate(d, b, per_task=100)).collect()}
    assert got == brute(docs, items)
