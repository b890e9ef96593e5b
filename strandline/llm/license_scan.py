"""Licence notices in texts, by a positional index of rare licence words, in Spark expressions only.

The notices' words are the licence words.  How rare each is comes from all documents:
one aggregation counts the documents that hold it, at most one row a licence word.  A
notice is indexed by its `RARE` rarest words and its mandatory phrases, with positions.
The rarest word of its mandatory phrases, without which it cannot be found, is its lead:
a file is looked up by those of its words that are leads.

A file's own index lists the places of its licence words.  For each notice whose lead it
holds, postings are intersected by relative position: each place of an indexed word, less
the word's position in the notice, is a start that this word agrees with.  Starts are
sorted and what agrees with each is summed.  A notice is found where all words of its
mandatory phrases agree with one start and the words that do hold at least `AGREE` of its
weight.

A base notice is one phrase, mandatory as a whole, so that it is found exactly wherever
its words stand consecutively, whatever the weights are.  Everything is done within a
row, in time that grows with the text: votes are sorted and summed in one pass.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let


@dataclass(frozen=True)
class Notice:
    """label; words of the notice; its mandatory phrases; whether every place of it is reported."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


# Public licence notices, in words.
NOTICES = (
    Notice("mit", "under the mit license", ("under the mit license",), base=True),
    Notice("apache-2", "apache license version 2", ("apache license version 2",), base=True),
    Notice("cc-by-nc", "cc by nc", ("cc by nc",), base=True),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Notice("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Notice("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Notice("cc-by-sa", "cc by sa", ("cc by sa",)),
    Notice("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Notice("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Notice("gpl-3", "gnu general public license version 3", ("gnu general public license version 3",)),
    Notice("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    Notice("gpl-2", "gnu general public license version 2", ("gnu general public license version 2",)),
    Notice("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    Notice("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    Notice("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Notice("reserved", "all rights reserved", ("all rights reserved",)),
)
#: Indexed words of a notice, and the share of their weight that must agree.
RARE, AGREE = 8, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, digits and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: More than the votes for any start, so that a sum tells how many mandatory phrases are in it.
PHRASE = 1 << 40


def licence_words(notices: Sequence[Notice]) -> list[str]:
    return sorted({w for n in notices for w in n.text.split()})


def indexed(text: Column, vocabulary: Sequence[str]) -> Column:
    """A struct of a text: n_words, own (place and word of each licence word, in order)."""

    def own(w: Column) -> Column:
        # lower() is fast and finds all that may be meant; which letters are ASCII is settled for these few.
        near = F.transform(w, lambda x, i: F.when(F.lower(x).isin(vocabulary), F.struct(i.alias("place"), F.translate(x, UPPER, LOWER).alias("word"))))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.filter(near, lambda o: o.word.isin(vocabulary)).alias("own"))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), own)


def weights(documents: DataFrame, notices: Sequence[Notice] = NOTICES) -> dict[str, int]:
    """Inverse document frequency of each licence word over all documents, in thousandths, at least 1."""
    vocabulary = licence_words(notices)
    words = documents.select(F.explode(F.array_distinct(indexed(F.col("text"), vocabulary).own.word)).alias("word"))
    seen = {r[0]: r[1] for r in words.groupBy("word").count().collect()}  # a row for each licence word at most
    n = documents.count()
    return {w: max(1, floor(1000 * log((1 + n) / (1 + seen.get(w, 0))))) for w in vocabulary}


def rarest(notice: Notice, weight: dict[str, int], most: int = RARE, among: Sequence[str] = ()) -> list[str]:
    """The rarest words of a notice, or of some of its phrases, the rarest first, ties in the order of the alphabet."""
    return sorted({w for p in among or [notice.text] for w in p.split()}, key=lambda w: (-weight[w], w))[:most]


def index(notices: Sequence[Notice], weight: dict[str, int]) -> Column:
    """The notices as a literal array: label, base, lead, postings (word, position, what its agreement adds), whole and needed sum of a start."""
    rows = []
    for n in notices:
        words = n.text.split()
        rare = rarest(n, weight)
        adds = [weight[w] if w in rare else 0 for w in words]
        whole = sum(adds)
        for phrase in (p.split() for p in n.phrases):
            at = next(p for p in range(len(words)) if words[p : p + len(phrase)] == phrase)
            adds[at : at + len(phrase)] = [x % PHRASE + PHRASE for x in adds[at : at + len(phrase)]]
        phrase_words = sum(x >= PHRASE for x in adds)
        postings = [{"word": w, "at": p, "n": x} for p, (w, x) in enumerate(zip(words, adds, strict=True)) if x]
        rows.append({"label": n.label, "base": n.base, "lead": rarest(n, weight, 1, n.phrases)[0], "postings": postings, "fixed": phrase_words * PHRASE, "whole": float(whole), "size": len(words)})
    kind = "array<struct<label:string,base:boolean,lead:string,postings:array<struct<word:string,at:int,n:bigint>>,fixed:bigint,whole:double,size:int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def matches(own: Column, notices: Column) -> Column:
    """The notices found in a file: an array of label, share of the weight that agrees at the best start, starts (of base notices).

    Only notices whose lead the file holds are looked at.  Votes for one start are the
    places of different words of a notice, each of them once, so that a base notice
    stands where as many votes as it has words are for one start.
    """

    def found(n: Column) -> Column:
        vote = lambda p: F.transform(F.filter(own, lambda o: o.word == p.word), lambda o: F.struct((o.place - p["at"]).alias("start"), p.n.alias("n")))
        return let(F.sort_array(F.flatten(F.transform(n.postings, vote))), lambda votes: settled(n, votes))

    def settled(n: Column, votes: Column) -> Column:
        first = F.struct(F.lit(None).cast("int").alias("start"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("best"))

        def add(a: Column, v: Column) -> Column:
            return let(F.when(a.start == v.start, a.n + v.n).otherwise(v.n), lambda n: F.struct(v.start.alias("start"), n.alias("n"), F.greatest(a.best, n).alias("best")))

        best = F.aggregate(votes, first, add, lambda a: a.best) - n.fixed
        last = lambda v, i: F.get(votes, i + n.size - 1).start == v.start
        starts = F.when(n.base, F.transform(F.filter(votes, last), lambda v: v.start)).otherwise(F.array().cast("array<int>"))
        return let(best, lambda b: F.when(b >= AGREE * n.whole, F.struct(n.label.alias("label"), (b / n.whole).alias("share"), starts.alias("starts"))))

    words = F.array_distinct(F.transform(own, lambda o: o.word))
    return F.filter(let(words, lambda held: F.transform(F.filter(notices, lambda n: F.array_contains(held, n.lead)), found)), lambda m: m.isNotNull())


def scan(documents: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """doc_id, n_words, starts (of base notices, in order), base_labels, labels (arrays, distinct and sorted), score.

    score: the greatest share of a found notice's weight that agrees, 1 for a base
    notice, 0 for none.  Only doc_id and text are read; one row comes out for each row
    that goes in.  A null text is empty and has no words and no labels; texts are read
    whole, however long.  A place that two base notices share counts for each.  Copies
    weigh as often as they come.  An empty table gives no rows.
    """
    notices = tuple(notices)
    table = index(notices, weights(documents, notices))
    found = documents.select("doc_id", let(indexed(F.col("text"), licence_words(notices)), lambda d: F.struct(d.n_words.alias("n_words"), matches(d.own, table).alias("found"))).alias("d"))
    labels = lambda m: F.array_sort(F.array_distinct(F.transform(m, lambda x: x.label)))
    base = F.filter("d.found", lambda m: F.size(m.starts) > 0)
    return found.select(
        "doc_id", "d.n_words", F.array_sort(F.flatten(F.transform("d.found", lambda m: m.starts))).alias("starts"), labels(base).alias("base_labels"),
        labels(F.col("d.found")).alias("labels"), F.coalesce(F.array_max(F.transform("d.found", lambda m: m.share)), F.lit(0.0)).alias("score"),
    )


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    end = lambda c: c.cast("bigint")
    return result.select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"), end(F.array_min("starts")).alias("first_word"), end(F.array_max("starts")).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def sql(notices: Sequence[Notice] = NOTICES) -> str:
    """The same in plain SQL: words joined to the notices' words by word, summed by (document, notice, start)."""
    postings, phrases = [], []
    for i, n in enumerate(notices):
        words = n.text.split()
        postings += [f"({i},'{n.label}',{str(n.base).lower()},{p},'{w}')" for p, w in enumerate(words)]
        for j, phrase in enumerate(n.phrases):
            own = phrase.split()
            at = next(p for p in range(len(words)) if words[p : p + len(own)] == own)
            phrases += [f"({i},{j},{at + p},'{w}')" for p, w in enumerate(own)]
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {",".join(postings)}) t(notice, label, base, pos, word)),
k AS (SELECT * FROM (VALUES {",".join(phrases)}) t(notice, phrase, pos, word)),
w AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM d) WHERE word IN (SELECT word FROM p)),
f AS (SELECT word, greatest(1, CAST(floor(1000 * ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(n, 0))::DOUBLE)) AS BIGINT)) AS weight
      FROM (SELECT DISTINCT word FROM p) LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM w GROUP BY word) USING (word)),
r AS (SELECT notice, word, weight FROM (SELECT notice, word, weight, row_number() OVER (PARTITION BY notice ORDER BY weight DESC, word) AS nth
      FROM (SELECT DISTINCT notice, word FROM p) JOIN f USING (word)) WHERE nth <= {RARE}),
total AS (SELECT notice, any_value(label) AS label, any_value(base) AS base, sum(weight) AS total FROM p JOIN r USING (notice, word) GROUP BY notice),
v AS (SELECT doc_id, notice, place - pos AS start, sum(weight) AS agree FROM w JOIN (SELECT notice, pos, word, weight FROM p JOIN r USING (notice, word)) USING (word) GROUP BY ALL),
ks AS (SELECT notice, count(*) AS need FROM k GROUP BY notice),
kv AS (SELECT doc_id, notice, place - pos AS start FROM w JOIN k USING (word) JOIN ks USING (notice) GROUP BY doc_id, notice, place - pos, need HAVING count(*) = need),
m AS (SELECT doc_id, notice, label, base, start, agree / total::DOUBLE AS share FROM v JOIN kv USING (doc_id, notice, start) JOIN total USING (notice) WHERE agree >= {AGREE} * total),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN g USING (doc_id)
"""
