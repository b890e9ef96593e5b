"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of `window` words (a shorter item is one
window).  A window is a set of shingles; a document contains the window only if
it contains every shingle, so with a required overlap of 100 % the prefix that
must be joined is one shingle: the rarest of the window, by its count over all
documents.  Documents are scanned for prefix shingles; each find joins the
windows with that prefix, the shingle's place in the window gives the only place
where the window could lie (positional bound), the text must have room for it
(length bound), and the words there are compared with the window's words.

Cost: two scans of the documents (counts, then finds), one shuffle of the finds
and of one small row per document.  Benchmark shingles are held in memory in
blocks of `BLOCK` hashes; a larger benchmark takes one more pair of scans per
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cut, sha256
from .text import ALNUM, Words, find_package, slices, words

#: Words in a window, and in a shingle.
WINDOW, SHINGLE = 13, 5
#: Benchmark shingle hashes (8 bytes each) that go to every task at once.
BLOCK = 2_000_000
#: Finds of one shingle to a task, about, and the parts that they are dealt in at most.
PER_TASK, SALTS = 50_000, 4096


def _shingles(run: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of each shingle of any of these sizes."""
    text_of = run.text_of()
    starts = [run.starts(size, text_of) for size in sizes]
    return np.concatenate(starts), np.concatenate([run.windows(size)[at] for size, at in zip(sizes, starts, strict=True)])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window: words, n, shingles (hash by place), items (ids as strings)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, ws, shs = [], [], []
            for run in words(batch.column(1), ALNUM, lower=True):
                for i, row in enumerate(run.rows):
                    low, high = int(run.at[i]), int(run.at[i + 1])
                    for a in range(low, max(high - window, low) + 1) if high > low else ():
                        b = min(a + window, high)
                        size = min(shingle, b - a)
                        part = Words(run.data, run.first[a:b], run.last[a:b], np.array([0, b - a]), run.hashes[a:b], range(1))
                        ids.append(batch.column(0)[row].as_py())
                        ws.append([run.word(j) for j in range(a, b)])
                        shs.append(part.windows(size).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ws, pa.list_(pa.string())), pa.array(shs, pa.list_(pa.int64()))], ["item", "words", "shingles"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut_up, "item string, words array<string>, shingles array<bigint>")
    return rows.groupBy("words", "shingles").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("words"))


def _counts(documents: DataFrame, hashes: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each of the (sorted) shingle hashes occurs in all documents."""
    known = documents.sparkSession.sparkContext.broadcast(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        total = np.zeros(len(keys), np.int64)
        for batch in slices(batches):
            for whole in words(batch.column(0), ALNUM, lower=True):
                for run in whole.parts(max(sizes) - 1):  # a short shingle where parts meet is counted twice; only order and zero matter
                    _, found = _shingles(run, sizes)
                    place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    np.add.at(total, place[keys[place] == found], 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(total[hit])], ["shingle", "n"])

    return documents.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("count"))


def _scan(documents: DataFrame, prefixes: np.ndarray, salts: np.ndarray, reach: int, sizes: list[int], marks: bool) -> DataFrame:
    """A row for each find: doc_id, text_key, part, n_words, at, shingle, salt, low and context (words around it and the first one's place).

    salts: in how many parts the finds of each prefix are dealt.  marks: with a row for each
    document too, whose `at` is -1 and whose shingle is a number of its row alone, so that
    rows without finds are spread, equal and empty texts too.
    """
    known = documents.sparkSession.sparkContext.broadcast((prefixes, salts))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, dealt), nth = known.value, 0
        for batch in slices(batches):
            n_words, rows = np.zeros(batch.num_rows, np.int64), []
            for whole in words(batch.column(2), ALNUM, lower=True):
                n_words[whole.rows.start : whole.rows.stop] = whole.counts()
                for run in whole.parts(max(sizes) - 1) if len(keys) else ():
                    starts, found = _shingles(run, sizes)
                    place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    hits = np.flatnonzero(keys[place] == found)
                    for w, h, n in zip((starts[hits] + run.base).tolist(), found[hits].view(np.int64).tolist(), dealt[place[hits]].tolist(), strict=True):
                        i = int(np.searchsorted(whole.at, w, "right")) - 1
                        low, high = max(int(whole.at[i]), w - reach), min(int(whole.at[i + 1]), w + reach)
                        nth += 1
                        rows.append((whole.rows.start + i, w - int(whole.at[i]), h, nth % n, low - int(whole.at[i]), [whole.word(j) for j in range(low, high)]))
            if marks:
                rows += [(i, -1, h, 0, 0, None) for i, h in enumerate(batch.column(4).to_pylist())]
            if rows:
                of = pa.array([r[0] for r in rows], pa.int64())
                columns = [batch.column(0).take(of), batch.column(1).take(of), batch.column(3).take(of), pa.array(n_words).take(of)]
                columns += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "part", "n_words", "at", "shingle", "salt", "low", "context"])

    own = F.xxhash64(F.monotonically_increasing_id())
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text", F.spark_partition_id().alias("part"), own.alias("own"))
    return rows.mapInArrow(scan, f"doc_id {kind}, text_key bigint, part int, n_words bigint, at bigint, shingle bigint, salt bigint, low bigint, context array<string>")


def _hashes(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of at most `block` rows, in order of the first one, which is a hash."""
    first, *rest = (c.to_numpy() for c in rows.toArrow().columns)
    order = np.argsort(first.view(np.uint64))
    return first.view(np.uint64)[order], *(c[order] for c in rest)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, block: int = BLOCK, per_task: int = PER_TASK) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    documents: doc_id, text (other columns are not read); benchmark: item_id, text.
    Returns doc_id, text_key, n_words, n_hit (words inside any occurrence of a window), hits
    (array of start, n), items (sorted array of item ids as strings), contaminated
    (n_hit > 0 and share * n_hit >= n_words).

    Null or empty texts have no words and are not contaminated.  Items without
    words are ignored; an empty benchmark contaminates nothing.  One row comes out for
    each row that goes in, repeated ones and those without doc_id too; `text_key` (the
    xxhash64 of the text) tells the texts of one doc_id apart.  Equal windows of several
    items name all of these items.
    """
    spark = documents.sparkSession
    find_package(spark)
    windows = benchmark_windows(benchmark, window=window, shingle=shingle)
    # The benchmark's own shingles: counted first, then taken in blocks of bounded size.
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle)).alias("n")).distinct().collect()) or [shingle]
    marks = windows.select(F.explode(F.array_distinct("shingles")).alias("shingle")).distinct()
    blocks = max(1, -(-marks.count() // block))
    prefixed, scans = None, []
    for b in range(blocks):
        mine = marks.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        hashes = _hashes(mine)[0]
        counts = _counts(documents, hashes, sizes) if len(hashes) else spark.createDataFrame([], "shingle bigint, count bigint")
        prefixed = counts if prefixed is None else prefixed.unionByName(counts)
    rarity = prefixed
    places = windows.select("words", "items", "n", F.posexplode("shingles").alias("place", "shingle"))
    # Shingles that no document has need no join: a window with one occurs nowhere.
    ranked = places.join(rarity, "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    chosen = ranked.groupBy("words", "items", "n").agg(F.min(F.struct("count", "shingle", "place")).alias("rarest"))
    # The finds of a passage that very many documents have are dealt to several tasks, as many as its count fills.
    salts = F.least(F.lit(SALTS), 1 + F.floor(F.col("rarest.count") / per_task)).cast("bigint")
    chosen = chosen.filter("rarest.count > 0").select("words", "items", "n", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("place"), salts.alias("salts"))
    chosen = cut(chosen)
    prefixes = chosen.select("shingle", "salts").distinct()  # a shingle has one count
    for b in range(blocks):
        mine = prefixes if blocks == 1 else prefixes.filter(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == b)
        scans.append(_scan(documents, *_hashes(mine), window, sizes, marks=b == 0))
    found = scans[0]
    for more in scans[1:]:
        found = found.unionByName(more)
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (start >= F.col("low"))
    same = F.slice("context", F.when(fits, (start - F.col("low") + 1).cast("int")).otherwise(1), F.col("n")) == F.col("words")
    candidates = chosen.select(F.col("shingle").alias("of"), "words", "items", "n", "place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("of_salt"))
    joined = found.join(candidates, (F.col("shingle") == F.col("of")) & (F.col("salt") == F.col("of_salt")) & (F.col("at") >= 0), "left").withColumn("hit", F.when(fits & same, F.struct(start.alias("start"), F.col("n").cast("bigint").alias("n"))))
    per = joined.groupBy("doc_id", "text_key", "part").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(F.col("at") < 0, 1)).alias("copies"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("items")))))).alias("items"),
    )
    # Words covered by the sorted hits: what each hit adds beyond the furthest end so far.
    empty = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(a, x):
        end = x.start + x.n
        return F.struct(F.greatest(a.end, end).alias("end"), (a.n + F.greatest(F.lit(0).cast("bigint"), end - F.greatest(a.end, x.start))).alias("n"))

    n_hit = F.aggregate("hits", empty, add, lambda a: a.n)
    per = per.withColumn("n_hit", n_hit).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return per.select("doc_id", "text_key", "n_words", "n_hit", "hits", "items", ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


#: The same in plain SQL, window by window.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, len(w[s:s + 12]) AS n, array_to_string(w[s:s + 12], ' ') AS k
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)
"""
