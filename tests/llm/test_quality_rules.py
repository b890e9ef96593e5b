"""Quality rules: counts against brute force, rules that separate planted junk, plans without Python."""

import random
import re

from strandline.llm import quality_rules as qr
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    cov = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cov), failed)


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t ", "a", "a a a", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "é\x0bé\x0cé\r\né é é é", "    a", "w " * 20_000]
    out += [" ".join(rng.choice(["a", "b", "c#", "É", "d|", "\n", "\n\n", "e<"]) for _ in range(rng.randrange(120))) for _ in range(120)]
    out += [" ".join(f"w{rng.randrange(9000)}" for _ in range(30_000))]
    return out


def test_counts(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n_words int")
    got = {r[0]: tuple(r)[1:7] for r in qr.judge(df, []).collect()}
    assert got == {i: brute(t) for i, t in docs}
    assert all(r.kept == (not r.base_failed) for r in qr.judge(df, []).collect())
    assert qr.judge(df.limit(0), []).collect() == []


def test_learned_rules_reject_junk_and_keep_clean(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        w = [f"{rng.choice('bcdfg')}{rng.randrange(5000)}x" for _ in range(rng.randrange(60, 200))]
        bad = i % 4 == 0
        if bad:
            w = [x + "$$$" for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    rules = qr.learn(d, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert rules and all(str(t) for r in rules for t in r)
    got = {r.doc_id: r.kept for r in qr.judge(d, rules).collect()}
    assert all(got[i] == (i % 4 != 0) for i in got)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qr.learn(d, none) == []


def test_plan_is_native(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = qr.judge(d, [(qr.Test("words", True, 3.0),)])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert d.filter(qr.verdict(F.col("text"), []).kept).count() == 0
