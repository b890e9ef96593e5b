"""Audit of how filters interact: what each removes at each place in every order they may be applied in.

The orders of k filters are the paths of a trie; two paths that have applied the same
filters, in whatever order, leave the same documents.  So the trie is walked depth
first over persisted DataFrames of survivors, and a state that another order has
reached before is not run again: 2**k states and k * 2**(k-1) edges, not k! paths.  At
each state one aggregation over its survivors counts, by part, what each filter that is
still to come removes there.  A state's survivors are filtered from those of the state
before it, and are let go once all that follows from them has been counted, so at most
k sets of survivors are held, each from its parent if executors are lost.

Counts are written to the shared folder state by state: one row a part and edge, summed
in each task before they are shuffled.  Rows by order and step are looked up among a
part's edges, at most k * 2**(k-1) of them; nothing is joined.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import join_hot, let, remove_at_end, shared_dir, stored

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """The four conditions that a whole text is judged by alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))
    sizes = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))
    return {
        "A": let(sizes, lambda s: s.n < 200),
        "B": let(sizes, lambda s: 100 * s.distinct < 50 * s.n),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 2 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, A to E (whether the row fails), good, toxic: one row for each document, stored.

    E: the text is that of a row with a smaller doc_id anywhere in the table.  A row
    without doc_id is smaller than none and has no labels.  A doc_id that `labels` has
    several times is good, or toxic, if any of its rows says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = failures(F.col("text"))
    rows = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), *(c.alias(n) for n, c in alone.items()))
    rows = stored(rows)  # texts are read once; what is kept of them is small
    least = rows.filter("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = join_hot(rows, least, ["same"], "id").withColumn("E", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))))
    # A row without doc_id gets a key of its own that no label has, so that such rows are spread.
    lone = F.when(F.col("id").isNull(), F.concat(F.lit("row "), F.monotonically_increasing_id())).otherwise(F.col("id").cast("string"))
    rows = rows.withColumn("_who", lone).join(known.withColumn("_who", F.col("id").cast("string")).drop("id"), "_who", "left")
    return stored(rows.select("part", *FILTERS, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("good", "toxic"))))


def edges(rows: DataFrame, filters: Sequence[str], outcomes: Sequence[str] = (), part: str = "part") -> DataFrame:
    """part, state (filters applied before, in their own order, joined), filter, survivors, removed, and for each outcome how many of it were removed.

    rows: part, a boolean for each filter (whether the row fails it, never null), a 0/1
    number for each outcome.  A part without survivors at a state has no rows there.
    """
    spark, place = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/{uuid.uuid4()}"
    seen: set[frozenset[str]] = set()
    schema = f"part {rows.schema[part].dataType.simpleString()}, state string, filter string, survivors bigint, removed bigint" + "".join(f", lost_{o} bigint" for o in outcomes)

    def count(state: frozenset[str], survivors: DataFrame, to_come: list[str]) -> None:
        fails = lambda f, value: F.sum(F.when(F.col(f), value).otherwise(0)).cast("bigint")
        counts = [c for f in to_come for c in (fails(f, F.lit(1)).alias(f"{f}_removed"), *(fails(f, F.col(o)).alias(f"{f}_lost_{o}") for o in outcomes))]
        by_part = survivors.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("survivors"), *counts)
        edge = lambda f: F.struct(F.lit(f).alias("filter"), F.col(f"{f}_removed").alias("removed"), *(F.col(f"{f}_lost_{o}").alias(f"lost_{o}") for o in outcomes))
        named = by_part.select("part", F.lit("".join(f for f in filters if f in state)).alias("state"), "survivors", F.explode(F.array(*(edge(f) for f in to_come))).alias("edge"))
        named.select("part", "state", "edge.filter", "survivors", "edge.removed", *(f"edge.lost_{o}" for o in outcomes)).write.mode("append").parquet(place)

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        seen.add(state)
        to_come = [f for f in filters if f not in state]
        if not to_come:
            return  # what is left after all is what was left before the last, less what that removed
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count(state, survivors, to_come)
        for f in to_come:
            if (after := state | {f}) not in seen:
                visit(after, survivors.filter(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows.select(part, *filters, *outcomes))
    remove_at_end(spark, place)
    return spark.read.schema(schema).parquet(place)


def by_order(edges: DataFrame, filters: Sequence[str], outcomes: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, lost_* for each outcome, shapley: each order's steps in each part.

    redundant: fails its filter and was removed earlier; unique_fails: fails its filter
    only; shapley: what its filter removes, summed over all orders.
    """
    k, zero = len(filters), F.lit(0).cast("bigint")
    named = lambda state: "".join(f for f in filters if f in state)
    value = F.struct("survivors", "removed", *(f"lost_{o}" for o in outcomes))
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "state", "filter"), value))).alias("at"))
    read = lambda state, f, name: F.coalesce(F.element_at("at", F.concat_ws(">", state, f))[name], zero)

    def of_filter(f: str) -> Column:
        others = [o for o in filters if o != f]
        states = [named([o for i, o in enumerate(others) if bits >> i & 1]) for bits in range(1 << (k - 1))]
        share = reduce(lambda a, b: a + b, (read(F.lit(s), F.lit(f), "removed") * (factorial(len(s)) * factorial(k - 1 - len(s))) for s in states))
        return F.struct(share.alias("shapley"), read(F.lit(named(others)), F.lit(f), "removed").alias("unique_fails"), read(F.lit(""), F.lit(f), "removed").alias("fails"))

    parts = parts.withColumn("of", F.create_map(*(x for f in filters for x in (F.lit(f), of_filter(f)))))
    steps = [("".join(o), i + 1, named(o[:i]), o[i]) for o in permutations(filters) for i in range(k)]
    table = F.from_json(F.lit("[" + ",".join('{"o":"%s","i":%d,"s":"%s","f":"%s"}' % s for s in steps) + "]"), "array<struct<o:string,i:int,s:string,f:string>>")
    rows = parts.select("part", "at", "of", F.explode(table).alias("x"))
    own = lambda name: read(F.col("x.s"), F.col("x.f"), name)
    fixed = F.element_at("of", F.col("x.f"))
    return rows.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.i").alias("step"), F.col("x.f").alias("filter"),
        (own("survivors") - own("removed")).alias("kept"), own("removed").alias("removed"), (fixed.fails - own("removed")).alias("redundant"),
        fixed.unique_fails.alias("unique_fails"), *(own(f"lost_{o}").alias(f"lost_{o}") for o in outcomes), fixed.shapley.alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents, by source: one row for each source, order and step, zeros included.

    documents: doc_id, text, source; labels: doc_id, quality, toxic; other columns are
    not read.  A null text is empty, a null source is the part with the empty name.
    Rows that repeat are counted each; see judged() for E and for labels.  An empty
    table has no parts and gives no rows.
    """
    outcomes = ("good", "toxic")
    rows = by_order(edges(judged(documents, labels), FILTERS, outcomes), FILTERS, outcomes)
    return rows.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same in plain SQL: documents counted by part and by which conditions they fail, then every order step by step.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
             regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM w),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM d LEFT JOIN labels USING (doc_id) GROUP BY part, f),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, e.x, h.x] AS o FROM l a, l b, l c, l e, l h WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5),
s AS (SELECT o, x AS step, o[x] AS own, o[1:x - 1] AS earlier FROM o, l),
r AS (SELECT part, o, step, own, f[own] AS fails, len(list_filter(earlier, lambda y: f[y])) > 0 AS gone, len(list_filter(f, lambda y: y)) = 1 AS alone, n, good, toxic FROM g, s),
c AS (SELECT part, o, step, own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM r GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', y, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM c
"""
