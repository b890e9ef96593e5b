"""The filter audit against every order run step by step over a list of rows."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandline.llm import interaction as ia

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(docs):
    """part and the letters that each row fails."""
    out = []
    for doc_id, text, part in docs:
        t = text or ""
        w = WORD.findall(t)
        first = [d for d, x, _ in docs if (x or "") == t and d is not None]
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and min(first) < doc_id}
        out.append((part or "", {k for k, v in own.items() if v}))
    return out


def brute(docs, labels):
    good, toxic = ({d for d, q, x in labels if d is not None and (q, x)[i] == 1} for i in (0, 1))
    rows = [(p, f, d[0] in good, d[0] in toxic) for (p, f), d in zip(fails(docs), docs, strict=True)]
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                own = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in r[1] for r in gone), sum(len(r[1]) == 1 for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                gone += removed
    for part in {r[0] for r in rows}:
        for f in "ABCDE":
            at = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    docs = [(None, "a b", "s0"), (None, "a b", None), (-1, None, "s1"), (500, "", "s1"), (501, " \n", "only")]
    for i in range(160):
        n = rng.choice([3, 150, 200, 230])
        pool = rng.choice([[f"w{j}" for j in range(500)], ["a", "b", "c"], [f"W{j}" for j in range(400)], [f"é{j}" for j in range(300)]])
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(rng.choices(pool, k=n)) + rng.choice(["", "", " #", "|"]), rng.choice(["s0", "s1", "s2", None])))
    docs += [(i, docs[rng.randrange(5, 165)][1], rng.choice(["s0", "s2"])) for i in range(200, 240)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 240, 2)] + [(None, 1, 1)]
    return docs, labels


def test_every_order(spark, data):
    docs, labels = data
    d = spark.createDataFrame([(*r, "x", True) for r in docs], "doc_id bigint, text string, source string, part string, A boolean").repartition(6)
    found = ia.digest(ia.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found.collect()}
    assert got == brute(docs, labels) and len(got) == 5 * 600


def test_states_are_shared(spark, data, monkeypatch):
    """Each of the 31 states that a filter follows is counted once, and what is held is let go."""
    docs, labels = data
    rows = ia.judged(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = ia.edges(rows, ia.FILTERS)
    assert found.select("state").distinct().count() == 31 and found.filter("part = 's0'").select("state", "filter").distinct().count() == found.filter("part = 's0'").count() <= 80
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ia.edges(rows, "ABC")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert ia.audit(empty, labels).count() == 0
    docs = [(1, "x", "s"), (1, "x", "s"), (2, "x", "s")]
    rows = ia.audit(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), labels)
    first = {r.filter: r for r in rows.filter("step = 1").collect()}
    assert first["E"].removed == 1 and first["A"].removed == 3 and (first["A"].good_lost, first["A"].toxic_lost) == (2, 2)
    assert rows.filter(F.col("kept") + F.col("removed") > 3).count() == 0
