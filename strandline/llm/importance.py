"""Importance resampling towards a target: bucketed word runs, log-ratio weights, a seeded draw without replacement.

A document's features are its runs of 1 to `runs` consecutive words, joined by one
space; a feature's bucket is its CRC-32 modulo `buckets`.  One scan finds them all: a
ring keeps the running CRC states of the last `runs` starts, and each word extends
every one of them by a space and itself, starts another, and emits the states as they
then stand.  No run is ever put together as a string, and a text is scanned once: what
the scan emits is written to the shared folder, and both the corpus counts and the
documents' weights are taken from there.

A task sums its counts before it sends them, one row a bucket at most, so the tables of
counts have a fixed size.  The draw orders documents by weight plus Gumbel noise from a
hash of seed and doc_id.  Scores are whole numbers, so that documents are counted by
score, totals of the higher scores give each score's first rank, and only documents of
one score are ordered together: no task orders the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import stored
from .text import find_package, slices

#: Words in the longest run, buckets, words of a document that may be drawn, share drawn in per cent, seed of the noise.
RUNS, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a text that are cut into words at once, and features that a batch holds.
BLOCK, HELD = 1 << 20, 1 << 20
#: Words are runs of letters, digits and non-ASCII characters, in lower case: all else becomes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size (but for a longer word)."""
    data = (text or "").encode().translate(PLAIN)
    low = 0
    while low < len(data):
        high = len(data) if low + BLOCK >= len(data) else data.find(b" ", low + BLOCK)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


class Ring:
    """CRC-32 states of the last starts of runs; `feed` extends them word by word and returns those of all runs that end there."""

    def __init__(self, runs: int):
        self.room, self.states = runs - 1, []

    def feed(self, words: list[bytes]) -> list[int]:
        states, out = self.states, []
        for word in words:
            if states:
                more = b" " + word
                states = [crc32(more, state) for state in states]
            states.append(crc32(word))
            out += states
            if len(states) > self.room:
                del states[0]
        self.states = states
        return out


def scan(documents: DataFrame, key: str, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, features (the bucket of each feature, repeats kept), one row for each row; null counts as empty."""
    kind = documents.schema[key].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: pa.Array, n_words: list[int], held: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            features = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *held])))
            return pa.RecordBatch.from_arrays([keys, pa.array(n_words, pa.int64()), features], ["key", "n_words", "features"])

        for batch in slices(batches):
            first, full, n_words, held, sizes = 0, 0, [], [], []
            for i, text in enumerate(batch.column(1)):
                ring, words, size = Ring(runs), 0, 0
                for block in word_blocks(text.as_py()):
                    states = np.array(ring.feed(block), np.uint32) % np.uint32(buckets)
                    held.append(states.astype(np.int32))
                    words, size = words + len(block), size + len(states)
                n_words.append(words)
                sizes.append(size)
                full += size
                if full >= HELD:
                    yield out(batch.column(0).slice(first, i + 1 - first), n_words, held, sizes)
                    first, full, n_words, held, sizes = i + 1, 0, [], [], []
            if sizes:
                yield out(batch.column(0).slice(first), n_words, held, sizes)

    return documents.select(key, "text").mapInArrow(emit, f"key {kind}, n_words bigint, features array<int>")


def totals(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features are in each bucket, over all rows: one number a bucket, however many rows there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in scanned.select("features").mapInArrow(partial, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: 1000 times the log ratio of its smoothed shares in target and corpus, floored."""
    n = float(len(corpus))
    over, under = (target + 1.0) * (corpus.sum() + n), (corpus + 1.0) * (target.sum() + n)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weighed(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight: the floored mean of the gains over a row's features, 0 without any."""
    known = scanned.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    kind = scanned.schema["key"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(2)
            ends = features.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(known.value[features.flatten().to_numpy()])])
            ends -= ends[0]
            n = np.diff(ends)
            weight = np.floor_divide(sums[ends[1:]] - sums[ends[:-1]], np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    return scanned.mapInArrow(weigh, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of the SHA-256 of `seed:doc_id`; a null doc_id counts as empty."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """The rows, with rank: 1, 2, 3... of the `percent` per cent of eligible rows with the highest score, ties to the smaller doc_id; else null.

    scored: doc_id, score (whole numbers).  It is read twice, so it should be stored.
    """
    rows = scored.withColumn("_eligible", eligible)
    # One row a score: whole thousandths between bounds that floor, ceiling and the 32 bits of the noise set.
    counted = [(r[0], r[1]) for r in rows.filter("_eligible").groupBy("score").count().orderBy(F.desc("score")).collect()]
    drawn = percent * sum(n for _, n in counted) // 100
    places, before = [], 0
    for score, n in counted:
        if before >= drawn:
            break
        places.append((score, before))
        before += n
    firsts = F.broadcast(scored.sparkSession.createDataFrame(places, "score bigint, _before bigint"))
    rows = rows.withColumn("_key", F.when(F.col("_eligible"), F.col("score"))).join(firsts.withColumnRenamed("score", "_key"), "_key", "left")
    # Rows that cannot be drawn are left as they are; the rest, a percent of all, is ordered score by score.
    in_score = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    may = rows.filter("_before IS NOT NULL").withColumn("rank", (F.col("_before") + in_score).cast("bigint"))
    may = may.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter("_before IS NULL").withColumn("rank", F.lit(None).cast("bigint"))
    return may.unionByName(rest).drop("_key", "_eligible", "_before")


def resample(documents: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document; rank is null for those that are not drawn.

    documents: doc_id, text; target: text, whose distribution is drawn towards; other
    columns are not read.  A null or empty text has no words, no features and weight 0,
    and is never drawn.  An empty target or an empty table gives weights from the
    smoothing alone, or no rows.  Ties go to the smaller doc_id; rows that repeat a
    doc_id have the same noise, and those that are equal in all take consecutive ranks;
    a row without doc_id comes last among ties.
    """
    find_package(documents.sparkSession)
    scanned = stored(scan(documents.select("doc_id", "text"), "doc_id", runs, buckets))
    corpus = totals(scanned, buckets)
    wanted = totals(scan(target.select(F.lit(0).alias("key"), "text"), "key", runs, buckets), buckets)
    found = weighed(scanned, gains(corpus, wanted)).withColumnRenamed("key", "doc_id")
    scored = stored(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    return ranked(scored, F.col("n_words") >= least, percent)


def drawn(documents: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of documents whose doc_id was drawn, with all their columns."""
    return documents.join(resampled.filter("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_features", "weight", "score", "rank")


#: The same in plain SQL: CRC-32 byte by byte of each distinct word, from a table of its polynomial.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bytes AS (SELECT word, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS x FROM words),
hashed AS (SELECT word, xor(4294967295, list_reduce(x, lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS a, coalesce((SELECT sum(n) FROM t), 0) AS z),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (a + 10000.0::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (z + 10000.0::DOUBLE)))) AS g
         FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
p AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT p.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CAST(CASE WHEN rank <= 10 * n // 100 THEN rank END AS BIGINT) AS rank
FROM p LEFT JOIN r USING (doc_id)
"""
