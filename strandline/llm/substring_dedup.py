"""Removal of passages that repeat across documents: count-min prefilter, then exact grouping.

A window is `window` consecutive words.  Of the `anchor`-word shingles in a window
the one with the least hash is its anchor; equal windows have equal anchors, so a
window cannot repeat unless its anchor does (neighbouring windows mostly share an
anchor, which leaves about a seventh as many things to count).

Pass 1: each task counts its anchors in a sparse count-min sketch of one row.  The
partition sketches are merged in Spark, cell by cell; a cell that was hit at least
twice in all marks its anchors.  Collisions only add hits, so counts are never too
low.  With a cell a task sends where the anchor stands, so that the merged cell itself
says which anchors of which documents are estimated repeated.  An anchor that a task
has met twice needs no answer: its places go past the cell, over all tasks, and the
cell gets the count alone.  So a passage that is in every document sends one row per
task to its cell.
Pass 2: windows whose anchor is estimated repeated are grouped exactly, by a 128-bit
BLAKE2 digest of their words.  A task first settles what repeats within itself, so
that a window of which there are many copies sends one row per task; what is left
is ordered by (doc_id, start) within each digest, and all but the first are removed.

The sketch has CELLS cells for each anchor expected, whatever the size of the input;
no task holds more of it than its own anchors, and nothing is broadcast.  Texts are shuffled
once, by document; both passes' joins use that one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut, sha256
from .text import SPACED, Words, find_package, mix, slices, words

#: Words in a window and in an anchor.
WINDOW, ANCHOR = 20, 8
#: Cells of the sketch for each anchor expected, at 42 characters an anchor.
CELLS = 64
#: Anchors or windows that a task holds before it hands them on.
HELD = 1 << 21


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of `span` neighbouring values, from each place on."""
    have, low = 1, values
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = span - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _anchors(run: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes; whether a shingle is an anchor; each window's least hash; whether a window is within one text."""
    shingles, n = run.windows(anchor), len(run.hashes) - window + 1
    chosen = np.zeros(len(shingles), bool)
    if n <= 0:
        return shingles, chosen, np.empty(0, np.uint64), np.empty(0, bool)
    inside = np.zeros(n, bool)
    inside[run.starts(window)] = True
    least = _least(shingles, window - anchor + 1)
    for t in range(window - anchor + 1):
        chosen[t : t + n] |= (shingles[t : t + n] == least) & inside
    return shingles, chosen, least, inside


def _estimated(keyed: DataFrame, bits: int, window: int, anchor: int) -> DataFrame:
    """key, place (of anchors, by words): those that the merged sketch of 2**bits cells estimates to be repeated."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            cells, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(cells, kind="stable")
            cells, keys, places = cells[order], keys[order], places[order]
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            hits = np.diff(np.append(np.flatnonzero(first), len(cells)))
            many = np.repeat(hits > 1, hits)
            # Met twice here: the cell gets the count alone; the places go by cells of their own, under 0, spread by document.
            once, twice = first & ~many, first & many
            spread = -1 - (mix(keys[many].view(np.uint64)) >> np.uint64(2)).astype(np.int64)
            columns = (
                np.concatenate([cells[once].view(np.int64), cells[twice].view(np.int64), spread]),
                np.concatenate([keys[once], np.zeros(twice.sum(), np.int64), keys[many]]),
                np.concatenate([places[once], np.full(twice.sum(), -1, np.int32), places[many]]),
            )
            order = np.lexsort((columns[2], columns[1]))  # neighbours in a text stay together, which is smaller when compressed
            return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], ["cell", "key", "place"])

        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for whole in words(batch.column(1), SPACED):
                for run in whole.parts(window - 1):
                    shingles, chosen, _, _ = _anchors(run, window, anchor)
                    at = np.flatnonzero(chosen)
                    text = np.searchsorted(run.at, at, "right") - 1
                    held.append((mix(shingles[at]) >> np.uint64(64 - bits), keys[run.rows.start + text], (at - run.at[text] + run.base).astype(np.int32)))
            if sum(len(h[0]) for h in held) >= HELD:
                yield out()
                held.clear()
        if sum(len(h[0]) for h in held):
            yield out()

    sent = keyed.select("key", "text").mapInArrow(partial, "cell bigint, key bigint, place int")
    hits = F.sum(F.when(F.col("place") < 0, 2).otherwise(1)).over(Window.partitionBy("cell"))
    return sent.withColumn("hits", hits).filter("place >= 0 AND (hits > 1 OR cell < 0)").select("key", "place")


def _repeats(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, run (start, n): runs of window starts that are to be removed.

    marked: key, doc_id, text, places: which of the text's anchors are estimated repeated.
    """

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, key, h2, h1))
        h1, h2, key, start = h1[order], h2[order], key[order], start[order]
        again = np.zeros(len(h1), bool)
        again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        gone_key, gone = key[again], start[again]
        order = np.lexsort((gone, gone_key))
        gone_key, gone = gone_key[order], gone[order]
        first = np.ones(len(gone), bool)
        first[1:] = (gone_key[1:] != gone_key[:-1]) | (gone[1:] != gone[:-1] + 1)
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(gone)))
        # A settled run has hashes of its own, which spread such runs over tasks.
        own = mix(gone_key[at].view(np.uint64) ^ gone[at].astype(np.uint64) << np.uint64(40))
        columns = (np.concatenate([h1[~again], own]), np.concatenate([h2[~again], own]), np.concatenate([key[~again], gone_key[at]]), np.concatenate([start[~again], gone[at]]), np.concatenate([np.zeros((~again).sum(), np.int32), n.astype(np.int32)]))
        order = np.lexsort((columns[3], columns[2]))  # as above
        arrays = [pa.array(c[order].view(np.int64) if c.dtype == np.uint64 else c[order]) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "key", "start", "n"])

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for whole in words(batch.column(2), SPACED):
                own = batch.column(3).slice(whole.rows.start, len(whole.rows))
                places = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(whole.at[:-1], np.diff(own.offsets.to_numpy()))
                for run in whole.parts(window - 1):
                    shingles, _, least, inside = _anchors(run, window, anchor)
                    n = len(least)
                    repeated = np.zeros(len(shingles), bool)
                    repeated[places[(places >= run.base) & (places < run.base + len(shingles))] - run.base] = True
                    hit = np.zeros(n, bool)
                    for t in range(window - anchor + 1):
                        hit |= repeated[t : t + n] & (shingles[t : t + n] == least)
                    where = np.flatnonzero(hit & inside)
                    if len(where):
                        text = np.searchsorted(run.at, where, "right") - 1
                        digests = run.same_words(where, window)
                        held.append((digests[:, 0], digests[:, 1], keys[run.rows.start + text], (where - run.at[text] + run.base).astype(np.int32)))
                        count += len(where)
            if count >= HELD:
                yield settle(held)
                held, count = [], 0
        if held:
            yield settle(held)

    rows = marked.mapInArrow(flagged, "h1 bigint, h2 bigint, key bigint, start int, n int")
    order = Window.partitionBy("h1", "h2").orderBy("n", "key", "start")
    rows = rows.withColumn("nth", F.row_number().over(order)).filter("n > 0 OR nth > 1")
    return rows.select("key", F.struct("start", F.greatest("n", F.lit(1)).alias("n")).alias("run"))


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS) -> DataFrame:
    """Remove each word in a window whose words also start earlier (a smaller doc_id, or earlier in the document).

    documents: doc_id (integer), text; other columns are not read.
    Returns doc_id, n_words, n_removed, text (the words kept, joined by one space).

    Null and empty texts have no words and give an empty text; a text of fewer words
    than a window loses none.  Rows that share a doc_id, or have none, are told apart
    by their order by (doc_id, text), nulls first.  An empty table gives no rows.
    """
    find_package(documents.sparkSession)
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("key"), "doc_id", "text")
    if documents.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        ordered = documents.select("doc_id", "text").orderBy("doc_id", "text")
        keyed = cut(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    # About six characters to a word and seven words to an anchor.
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(chars / 42 * cells, 2)))))
    places = _estimated(keyed, min(bits, 62), window, anchor).groupBy("key").agg(F.collect_list("place").alias("places"))
    # Left joins on a key that cannot be null, so that both use one exchange of the texts.
    marked = keyed.join(places, "key", "left").filter("size(places) > 0")
    gone = _repeats(marked, window, anchor).groupBy("key").agg(F.collect_list("run").alias("runs"))
    joined = keyed.join(gone, "key", "left")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = (text or "").encode().split()  # white space of bytes is ASCII white space
                n_words.append(len(own))
                if runs:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, [r["start"] for r in runs], 1)
                    np.add.at(edge, [r["start"] + r["n"] - 1 + window for r in runs], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    own = [own[i] for i in np.flatnonzero(stays)]
                n_removed.append(n_words[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    return joined.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", "n_words", "n_removed", sha256(F.col("text")).alias("kept_sha256"))


#: The same in plain SQL, window by window.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM s) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM r),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM t ANTI JOIN g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
