"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: its `SHINGLE`-word shingles, each with its count in
the document times an inverse document frequency.  Frequencies are counted over
all documents in `BUCKETS` hashed buckets, so their table has a fixed size.  The
inverse frequencies lie between 1 and `RANGE`, whatever the input: what a large
group of variants shares does not get light against each variant's own edits.  Two
documents are alike if the Jaccard similarity of their sets (sum of the lesser
weights over sum of the greater) is at least `SIMILARITY`, by these weights or by
the counts alone.  By the bounds of the weights, the weighted similarity of alike
documents is at least `REACH`, which is what candidates are sought by.

Each document draws `BANDS * ROWS` consistent weighted samples (Ioffe's improved
scheme); two documents share a sample with probability equal to their similarity.
`ROWS` samples make a band, and documents that share a band are candidates.
Texts with the same words are one node from the start.  Within a band's bucket,
up to `SMALL` nodes are paired with each other.  In a larger one all nodes are
compared with one leader; then those outside the bucket's largest component with
the node of that component that has most links, and with another of its members in
the bucket.  Nodes that are still outside are compared with every node of a large bucket that may be alike by two
bounds, both exact.  Alike texts share a shingle of their prefixes: shingles in
order of rarity, as many as hold more weight than alike texts may differ in.  And
what each of two texts has to itself, among all these nodes, can only be in one
of them, which limits both similarities, by weights and by counts; how many shingles
they differ in at least is told by sketches of a fixed size (see _far()).  What
may be alike is verified in waves, the nearest pair of each two components first, since
one link between them is enough.  So no link between components is lost, and variants
of one text are not all compared in pairs.
Every candidate is verified on its whole text.  Classes are the connected
components of the links: tasks join what links they have, and where many are left,
large and small stars alternate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import cut, join_hot, stored
from .text import ALNUM, Words, find_package, mix, slices, words

SHINGLE, BANDS, ROWS = 5, 12, 4
#: Similarity, as a ratio of whole numbers.
SIMILARITY = (4, 5)
#: Greatest inverse document frequency, the least being 1; the least weighted similarity of alike texts, if counts alone make them so.
RANGE = (5, 4)
REACH = (SIMILARITY[0] * RANGE[1], SIMILARITY[0] * RANGE[1] + (SIMILARITY[1] - SIMILARITY[0]) * RANGE[0])
BUCKETS, SHARD = 1 << 18, 1 << 12
#: Buckets of up to so many nodes are paired in full; rounds of further leaders in larger ones.
SMALL, LEADERS = 8, 2
#: Pairs of two components that the first wave verifies, and how many times more each wave does than the one before.
NEAREST = 4
WAVE = 16
#: Links to a task in the steps that find components.
PER_TASK = 200_000
#: Parts in which the nodes of each bucket are joined to what is known of the bucket, and the pairs of a node to its text.
SALTS = 16
#: Shingles before one in a prefix that are looked at to tell whether a pair has met already.
BEFORE = 16
#: 64-bit words of a sketch of the shingles in a text.
WORDS = 16
#: Inverse document frequencies are whole multiples of 1 / UNIT.
UNIT = 64


def _sets(run: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of each distinct shingle of each text, ordered by text; a shorter text is one shingle."""
    text_of = run.text_of()
    starts = run.starts(size, text_of)
    texts, hashes = text_of[starts], run.windows(size)[starts] if len(starts) else np.empty(0, np.uint64)
    counts = run.counts()
    for n in range(1, size):
        if len(short := np.flatnonzero(counts == n)):
            texts = np.concatenate([texts, short])
            hashes = np.concatenate([hashes, run.windows(n)[run.at[short]]])
    if not len(texts):
        return texts, hashes, np.empty(0, np.int64)
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return texts[at], hashes[at], np.diff(np.append(at, len(texts)))


def _frequencies(documents: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket, in units, from all documents."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int32), 0
        for batch in slices(batches):
            n += batch.num_rows
            for run in words(batch.column(0), ALNUM, lower=True):
                _, hashes, _ = _sets(run, SHINGLE)
                total += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        if n:
            shards = range(BUCKETS // SHARD)
            packed = [total[s * SHARD : (s + 1) * SHARD].tobytes() for s in shards]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *shards], pa.int32()), pa.array([np.array([n], np.int32).tobytes(), *packed], pa.binary())], ["shard", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(counts, np.int32).astype(np.int64)
                seen[shard] = seen[shard] + more if shard in seen else more
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([c.tobytes() for c in seen.values()], pa.binary())], ["shard", "counts"])

    rows = documents.select("text").mapInArrow(partial, "shard int, counts binary").repartition("shard").mapInArrow(merge, "shard int, counts binary")
    total, n = np.zeros(BUCKETS, np.int64), 0
    for shard, counts in rows.collect():  # 8 bytes a bucket, whatever the input
        if shard < 0:
            n = int(np.frombuffer(counts, np.int64)[0])
        else:
            total[shard * SHARD : (shard + 1) * SHARD] = np.frombuffer(counts, np.int64)
    rare = np.log((1 + n) / (1 + np.minimum(total, n))) / np.log(2 + n)
    return np.rint((1 + rare * (RANGE[0] / RANGE[1] - 1)) * UNIT).astype(np.int64)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r from Gamma(2, 1), its inverse, and beta from U(0, 1), at 65,536 hashed places."""
    rng = np.random.Generator(np.random.PCG64(20))
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32) + np.float32(1e-4)
    return r, (1 / r).astype(np.float32), rng.random(1 << 16, np.float32)


def _bands(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, bands: int, rows: int, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have shingles, and their band keys (texts x bands)."""
    first = np.flatnonzero(np.diff(texts, prepend=-1))
    sizes = np.diff(np.append(first, len(texts)))
    log_w = np.log(weights.astype(np.float32))
    r_of, inverse_of, beta_of = tables
    keys = np.zeros((len(first), bands), np.uint64)
    scale = np.float32(2.0**-24)
    for k in range(bands * rows):
        z = (hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD1342543DE82EF95)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xAF251AF3B0F025B5)
        place = (z >> np.uint64(48)).astype(np.int32)
        u1 = ((z & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
        u2 = ((z >> np.uint64(24) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
        r, beta = r_of[place], beta_of[place]
        t = np.floor(log_w * inverse_of[place] + beta)
        # ln a = ln c - r (t - beta) - r, with c = -ln(u1 u2) from Gamma(2, 1).
        log_a = np.log(-np.log(np.minimum(u1 * u2, np.float32(1 - 1e-7)))) - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, first)
        # A sample is the shingle that wins and its t, whatever the last bits of logarithms are.
        won = np.flatnonzero(log_a == np.repeat(least, sizes))
        won = won[np.searchsorted(won, first)]
        sample = hashes[won] + t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, k // rows] = mix(keys[:, k // rows] * np.uint64(31) + sample + np.uint64(k + 1))
    return texts[first], keys


def _signatures(documents: DataFrame, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """doc_id, same1, same2 (a 128-bit BLAKE2 digest of all words), keys (band keys; null for a text without words)."""
    known = documents.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, tables = known.value, _tables()
        for batch in slices(batches):
            same1, same2 = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            keys: list = [None] * batch.num_rows
            for run in words(batch.column(1), ALNUM, lower=True):
                texts, hashes, counts = _sets(run, SHINGLE)
                if not len(texts):
                    continue
                filled = np.flatnonzero(run.counts())
                digests = run.same_words(run.at[filled], run.counts()[filled])
                same1[run.rows.start + filled], same2[run.rows.start + filled] = digests[:, 0], digests[:, 1]
                which, own = _bands(texts, hashes, counts * units[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)], bands, rows, tables)
                for i, row in zip(which.tolist(), own.view(np.int64).tolist(), strict=True):
                    keys[run.rows.start + i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same1.view(np.int64)), pa.array(same2.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same1", "same2", "keys"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, same1 bigint, same2 bigint, keys array<bigint>")


def _with_text(pairs: DataFrame, texts: DataFrame, side: str, other: str, out: str) -> DataFrame:
    """Pairs with the text of one side; a node with pairs in a large bucket has its pairs spread by the other side."""
    salted = pairs.withColumn("_salt", F.when(F.col("wide"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int"))
    heads = salted.select(side, "_salt").distinct().join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(out)), side)
    return salted.join(heads, [side, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, similarity, alike: whether the sum of the lesser weights, or of the lesser counts, is SIMILARITY of that of the greater.

    pairs: a, b, wide (whether a or b may be in very many pairs).  similarity: the greater of the two.
    """
    known = pairs.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = known.value

        def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            out = []
            for run in words(column, ALNUM, lower=True):
                of, hashes, counts = _sets(run, SHINGLE)
                weights = counts * units[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
                edges = np.searchsorted(of, np.arange(len(run.rows) + 1))
                out += [(hashes[a:b], weights[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return out

        def jaccard(x: np.ndarray, y: np.ndarray, both: np.ndarray, at: np.ndarray) -> tuple[int, int]:
            common = int(np.minimum(x[both], y[at[both]]).sum()) if len(y) else 0
            return common, int(x.sum() + y.sum()) - common

        for batch in slices(batches, 64):  # few pairs at once: texts may be long
            alike, similar = [], []
            for (h, w, n), (g, v, m) in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                at = np.minimum(np.searchsorted(g, h), max(len(g) - 1, 0))
                both = g[at] == h if len(g) else np.zeros(len(h), bool)
                ratios = jaccard(w, v, both, at), jaccard(n, m, both, at)
                alike.append(any(c * SIMILARITY[1] >= u * SIMILARITY[0] for c, u in ratios))
                similar.append(max(c / max(u, 1) for c, u in ratios))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64()), pa.array(alike, pa.bool_())], ["a", "b", "similarity", "alike"])

    # Written, so that Spark knows their size: texts are not shuffled for few pairs.
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("wide").alias("wide")))
    rows = _with_text(_with_text(pairs, texts, "a", "b", "text_a"), texts, "b", "a", "text_b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(weigh, "a bigint, b bigint, similarity double, alike boolean").groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("alike").alias("alike"))


def _weighed_shingles(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """node, shingle, rare (the shingle's inverse document frequency), weight, of each distinct shingle of each text."""
    known = texts.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = known.value
        for batch in slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for run in words(batch.column(1), ALNUM, lower=True):
                of, hashes, counts = _sets(run, SHINGLE)
                rare = units[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[run.rows.start + of]), pa.array(hashes.view(np.int64)), pa.array(rare), pa.array(counts * rare)], ["node", "shingle", "rare", "weight"])

    return texts.select("doc_id", "text").mapInArrow(weigh, "node bigint, shingle bigint, rare bigint, weight bigint")


def _possible(texts: DataFrame, idf: np.ndarray, placed: DataFrame, outside: DataFrame) -> DataFrame:
    """a, b, far: pairs of a node in `outside` and a node in `placed` with another label that may be alike, and how many shingles they differ in at least."""
    named = placed.select("node", "label").distinct()
    rows = _weighed_shingles(texts.join(named.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), idf)
    rows = stored(rows.groupBy("node", "shingle").agg(F.max("rare").alias("rare"), F.max("weight").alias("weight")))  # a doc_id may have several texts
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    own = Window.partitionBy("node")
    rarest_first = own.orderBy(F.desc("rare"), "shingle")
    upto = rarest_first.rowsBetween(Window.unboundedPreceding, 0)
    common = lambda c: F.when(F.col("n") > 1, F.col(c)).otherwise(0)
    weighed = rows.withColumn("times", (F.col("weight") / F.col("rare")).cast("bigint"))
    rows = weighed.join(shared, "shingle")
    sums = [F.sum(f(c)).over(own).alias(f"{name}_{c}") for c in ("weight", "times") for name, f in (("all", F.col), ("rest", common))]
    rows = rows.select("node", "shingle", "rare", "n", *sums, (F.sum(common("weight")).over(own) - F.sum(common("weight")).over(upto) + common("weight")).alias("from_here"))
    # A common shingle of alike texts is in both prefixes: from it on, what is not alone holds REACH of each text's weight.
    prefix = (F.col("n") > 1) & (F.col("from_here") * REACH[1] >= F.col("all_weight") * REACH[0])

    # What two texts share is at most the lesser of what they do not have alone; all else that either has is in one of them only.
    def may_be_alike(shared: str, union) -> Column:
        fits = [F.col(f"{shared}_{c}") * SIMILARITY[1] >= union(c) * SIMILARITY[0] for c in ("weight", "times")]
        return fits[0] | fits[1]

    rows = rows.filter(prefix & may_be_alike("rest", lambda c: F.col(f"all_{c}")))
    # A pair is wanted once: not again at a shingle when one of the few before it is common too.
    before = F.collect_list("shingle").over(rarest_first.rowsBetween(-BEFORE, -1))
    held = ["node", "label", "before", "sketch", *(f"{name}_{c}" for name in ("all", "rest") for c in ("weight", "times"))]
    marked = stored(rows.withColumn("before", before).join(named.join(_sketches(weighed, texts), "node"), "node").select("shingle", *held))
    mine = marked.join(outside.select("node").distinct(), "node", "left_semi").select("shingle", *(F.col(c).alias(f"x_{c}") for c in held)).withColumnRenamed("x_node", "x")
    both = marked.join(mine, "shingle").filter((F.col("label") != F.col("x_label")) & ~F.arrays_overlap("before", "x_before"))
    both = both.withColumns({f"least_{c}": F.least(f"rest_{c}", f"x_rest_{c}") for c in ("weight", "times")})
    alone = lambda c: F.col(f"all_{c}") - F.col(f"rest_{c}") + F.col(f"x_all_{c}") - F.col(f"x_rest_{c}")
    met = both.filter(may_be_alike("least", lambda c: F.greatest(f"rest_{c}", f"x_rest_{c}") + alone(c)))
    total = lambda c: F.col(f"all_{c}") + F.col(f"x_all_{c}")
    met = met.filter(_near(_far("sketch", "x_sketch"), total("weight"), total("times")))
    return met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"), _far("sketch", "x_sketch").alias("far")).distinct()


def _sketches(weighed: DataFrame, texts: DataFrame) -> DataFrame:
    """node, sketch: a bit for each of `64 * WORDS` cells, whether the shingles in it are odd in number; null for a node of several texts.

    weighed: node, shingle, times.
    """
    cells = 64 * WORDS
    bit = F.expr(f"shiftleft(1L, cast(pmod(shingle, {cells}) % 64 as int))")
    odd = lambda k: (F.col("times") % 2 == 1) & (F.floor(F.pmod(F.col("shingle"), F.lit(cells)) / 64) == k)
    sketch = F.array(*(F.coalesce(F.bit_xor(F.when(odd(k), bit)), F.lit(0).cast("bigint")) for k in range(WORDS)))
    several = texts.groupBy(F.col("doc_id").alias("node")).agg((F.count("*") > 1).alias("several"))
    return weighed.groupBy("node").agg(sketch.alias("sketch")).join(several, "node").select("node", F.when(~F.col("several"), F.col("sketch")).alias("sketch"))


def _far(one: str, other: str) -> Column:
    """How many shingles two texts have not in common, at least: what they share cancels, so they differ in as many as their sketches in bits, or more."""
    differ = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"))
    return F.coalesce(F.aggregate(differ, F.lit(0).cast("bigint"), lambda n, x: n + x), F.lit(0).cast("bigint"))


def _near(far: Column, weight: Column, times: Column) -> Column:
    """Whether texts may be alike that differ in so many shingles; weight, times: of both together.

    What is common is half of the total less the difference, the union half of total and
    difference.  A shingle weighs UNIT or more.
    """
    fits = [(total - far * unit) * SIMILARITY[1] >= (total + far * unit) * SIMILARITY[0] for total, unit in ((weight, UNIT), (times, 1))]
    return fits[0] | fits[1]


def _in_waves(pairs: DataFrame, weighed: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """`weighed` with all of the pairs that are needed to know the components; pairs: a, b, far.

    Of two components one link is enough.  Each wave verifies, for every two components that
    have pairs, the nearest ones, WAVE times as many as the wave before; then pairs whose
    ends have come together are left out, and the rest waits for the next wave.
    """
    left, most = stored(pairs), NEAREST
    while left.limit(1).count():
        ends = left
        for side in ("a", "b"):
            of = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
            ends = join_hot(ends, of, [side], "b" if side == "a" else "a", "left", SALTS).withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
        two = [F.least("label_a", "label_b"), F.greatest("label_a", "label_b")]
        nth = F.row_number().over(Window.partitionBy(*two).orderBy("far", "a", "b"))
        apart = stored(ends.filter("label_a != label_b").withColumn("nth", nth).select("a", "b", "far", "nth"))
        now = apart.filter(F.col("nth") <= most).select("a", "b", F.lit(True).alias("wide"))
        if now.limit(1).count():
            weighed = weighed.unionByName(cut(_verified(now, texts, idf)))
            labels = cut(components(weighed.filter("alike").select("a", "b")))
        left, most = apart.filter(F.col("nth") > most).select("a", "b", "far"), most * WAVE
    return weighed


def _of_bucket(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Nodes joined to one row of their bucket, by band, key and salt, so that a large bucket is spread over tasks."""
    salted = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = nodes.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["band", "key", "_salt"]).drop("_salt")


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of these links that is not the least of its component to the one that is."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    top, before = np.arange(len(nodes)), None
    while before is None or (top != before).any():
        before = top.copy()
        low = np.minimum(top[x], top[y])
        np.minimum.at(top, before[x], low)
        np.minimum.at(top, before[y], low)
        while (top[top] != top).any():
            top = top[top]
    own = top != np.arange(len(nodes))
    return nodes[own], nodes[top[own]]


def _stars(edges: DataFrame) -> DataFrame:
    """Links with the same components, after each PER_TASK of a task's links were made stars."""
    most = PER_TASK

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            u, v = _joined(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for low in range(0, batch.num_rows, most):
                held.append(piece := batch.slice(low, most))
                n += piece.num_rows
                if n >= most:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    return edges.mapInArrow(join, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """node, label (the component's least node) of every node with a link; links: a, b.

    Each task first joins what it has of the links, PER_TASK at once, so that fewer
    are left.  Up to PER_TASK links need one such step more.  Of more than that, large
    and small stars find the components, in as many tasks as these links fill.
    """
    edges = cut(_stars(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    n = edges.count()
    if n <= PER_TASK:
        edges = cut(_stars(edges.coalesce(1)))
    else:
        edges = cut(edges.distinct())
        before = state(edges)
        while True:
            tasks = 1 + before[0] // PER_TASK
            # Large star: greater neighbours of each node go to the least of its neighbourhood.
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
            # Small star: lesser neighbours of each node, and the node, go to the least of them.
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
            now = state(edges)
            if now == before:
                break
            before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(documents: DataFrame, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """The near-duplicate class of each document: doc_id, class_id (the least doc_id of the class), n_links, least_similarity.

    documents: doc_id (integer), text; other columns are not read.  One row comes
    out for each row that goes in.  A text without words (null, empty, only signs)
    is like no other and is a class of its own.  A text of fewer than five words is
    one shingle.  Rows that share a doc_id share its class.  A row without doc_id
    is compared with none and has a null class.  Ties: the least doc_id.
    n_links: how many other texts this text was verified to be alike to, on the way to
    its class (not all texts of a class are compared); least_similarity: the least of
    these links' similarities, null without one.  Copies of one text share both.
    """
    spark = documents.sparkSession
    find_package(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    idf = _frequencies(texts)
    signed = cut(_signatures(texts, idf, bands, rows))
    # Texts with the same words are one node, named by its least doc_id.
    nodes = signed.filter("keys IS NOT NULL AND doc_id IS NOT NULL").groupBy("same1", "same2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    nodes = cut(nodes)
    entries = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = cut(_of_bucket(entries, buckets))
    # From here on only texts that have a candidate are read.
    texts = stored(texts.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    mine = members.filter(F.col("size") <= small)
    other = mine.select("band", "key", F.col("node").alias("b"))
    paired = mine.join(other, ["band", "key"]).filter("node < b").select(F.col("node").alias("a"), "b", F.lit(False).alias("wide"))
    starred = members.filter((F.col("size") > small) & (F.col("leader") != F.col("node"))).select(F.col("leader").alias("a"), F.col("node").alias("b"), F.lit(True).alias("wide"))
    weighed = cut(_verified(paired.unionByName(starred), texts, idf))
    # One row of each node, whose label is looked up once, however many buckets it is in.
    in_buckets = lambda rows: rows.groupBy("node").agg(F.collect_list(F.struct("band", "key")).alias("places"))
    large = in_buckets(members.filter(F.col("size") > small))
    if large.limit(1).count():
        for nth in range(LEADERS + 1):
            labels = cut(components(weighed.filter("alike").select("a", "b")))
            placed = cut(large.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("places").alias("place")).select("place.band", "place.key", "node", "label"))
            parts = placed.groupBy("band", "key", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(nth))).alias("leader"))
            top = parts.groupBy("band", "key").agg(F.max(F.struct("n", "label", "leader")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
            mixed = cut(_of_bucket(placed, top))
            outside = cut(mixed.filter("label != top.label").select("node", "label", F.col("top.leader").alias("leader"), F.col("top.label").alias("into")))
            if not outside.limit(1).count():
                break
            if nth == 0:
                # The component's node of most links so far, such as the text that its variants were made of.
                degrees = weighed.filter("alike").select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
                hubs = labels.join(degrees, "node").groupBy(F.col("label").alias("into")).agg(F.max_by("node", F.struct("count", -F.col("node"))).alias("hub"))
                outside = cut(join_hot(outside, hubs, ["into"], "node").withColumn("leader", F.coalesce("hub", "leader")).drop("hub"))
            if nth == LEADERS:
                possible = _possible(texts, idf, mixed, outside)
                weighed = _in_waves(possible.join(weighed.select("a", "b"), ["a", "b"], "left_anti"), weighed, labels, texts, idf)
                break
            more = outside.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
            more = more.distinct().join(weighed.select("a", "b"), ["a", "b"], "left_anti").withColumn("wide", F.lit(True))
            weighed = weighed.unionByName(cut(_verified(more, texts, idf)))
            large = in_buckets(mixed)  # the nodes of any other bucket are in one component, and stay there
    links = weighed.filter("alike").select("a", "b", "similarity")
    # A doc_id that has several texts ties their nodes together.
    named = nodes.select("same1", "same2", "node")
    of_node = cut(join_hot(signed.select("doc_id", "same1", "same2"), named, ["same1", "same2"], "doc_id").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")))
    ties = of_node.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("a", "b")
    labels = components(links.select("a", "b").unionByName(ties))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.count("*").alias("n_links"), F.min("similarity").alias("least_similarity"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = join_hot(of_node, labels.join(ends, "node", "left"), ["node"], "doc_id")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce("label", "node").cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "least_similarity")
