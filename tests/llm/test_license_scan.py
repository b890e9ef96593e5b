"""Licence scans against a reading of each text word by word."""

import math
import random
import re

from strandline.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROW = "doc_id bigint, text string, n_words string, labels int"


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, notices=ls.NOTICES):
    texts = {k: tokens(t) for k, t in docs}
    words = {w for n in notices for w in n.text.split()}
    weight = {w: max(1, math.floor(1000 * math.log((1 + len(texts)) / (1 + sum(w in t for t in texts.values()))))) for w in words}
    out = {}
    for doc_id, t in texts.items():
        starts, base, labels, score = [], set(), set(), 0.0
        for n in notices:
            own = n.text.split()
            rare = sorted(set(own), key=lambda w: (-weight[w], w))[: ls.RARE]
            whole = sum(weight[w] for w in own if w in rare)
            phrases = [(next(p for p in range(len(own)) if own[p : p + len(x)] == x), x) for x in (y.split() for y in n.phrases)]
            for s in range(-len(own), len(t)):
                if all(s + p >= 0 and t[s + p : s + p + len(x)] == x for p, x in phrases):
                    share = sum(weight[w] for p, w in enumerate(own) if w in rare and 0 <= s + p < len(t) and t[s + p] == w) / whole
                    if share >= ls.AGREE:
                        labels.add(n.label)
                        score = max(score, share)
                        if n.base:
                            base.add(n.label)
                            starts.append(s)
        out[doc_id] = (len(t), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))
    return out


def got(spark, docs):
    rows = ls.digest(ls.scan(spark.createDataFrame([(a, b, "x", 1) for a, b in docs], ROW))).collect()
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows}


def test_phrases_notices_and_edges(spark):
    docs = [
        (0, None), (1, ""), (2, "Released under the MIT License."), (3, "UNDER the MİT license, under the mit licensé"), (4, "CC BY-NC 4.0; cc by cc by nc cc by nc"),
        (5, "Licensed under the Apache License, Version 2.0. Under the MIT license"), (6, "the mit license under the"), (7, "worK under the mit license"),
        (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the x)"),
        (9, "Permission is hereby granted, free of charge, to every human getting one copy"), (10, "x" * 70_000 + " cc by nc"), (11, "!!! ..."),
        (12, "This program is under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
        (13, "under the terms of the GNU General Public License as published by the Free Software Foundation; version 3 of the License"), (14, "all rights reserved " * 3),
        (15, "under under the the mit mit license license under the mit license"),
    ]
    assert got(spark, docs) == brute(docs)
    assert got(spark, docs)[12][5] == "gpl-3" and got(spark, docs)[9][5] == "" and got(spark, docs)[7][1] == 1


def test_random_mixtures(spark):
    rng = random.Random(5)
    pool = [w for n in ls.NOTICES for w in n.text.split()]
    docs = []
    for i in range(300):
        t = []
        for _ in range(rng.randrange(0, 6)):
            own = rng.choice(ls.NOTICES).text.split()
            if rng.random() < 0.5:
                own = [rng.choice(pool) if rng.random() < 0.15 else w for w in own]
            t += own + rng.choices(pool + ["plain", "é"], k=rng.randrange(4))
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t)))
    found = brute(docs)
    assert got(spark, docs) == found and sum(bool(v[5]) for v in found.values()) > 100


def test_empty_and_repeated_rows(spark):
    assert ls.scan(spark.createDataFrame([], ROW)).count() == 0
    rows = ls.digest(ls.scan(spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "under the mit license")], "doc_id bigint, text string"))).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in rows) == [("1", 1), ("1", 1), ("None", 1)]


def test_time_grows_with_the_text(spark):
    """A text of licence words alone, in one row: all places agree with something."""
    text = "under the mit license version 2 of the gnu general public license " * 20_000
    row = ls.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert len(row.starts) == 20_000 and row.base_labels == ["mit"]


def test_no_python_in_the_plan(spark):
    plan = ls.scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
