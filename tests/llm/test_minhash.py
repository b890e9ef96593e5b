"""Near-duplicate classes against brute force over all pairs."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import minhash as mh


def brute(docs):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[0-9a-z]+", (text or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_copies_near_copies_and_strangers(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    docs, n = [], 0
    for _ in range(25):
        base = rng.sample(words, rng.randrange(120, 400))
        for _ in range(rng.choice([1, 2, 3, 30])):
            own = list(base)
            if rng.random() < 0.8:
                own[rng.randrange(len(own))] = "changed"
            docs.append((n, " ".join(own)))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "short one"), (n + 4, "Short ONE!"), (n + 5, " ".join(rng.choice(words) for _ in range(100_000)))]
    df = spark.createDataFrame([(t, "x", i) for i, t in docs], "text string, class_id string, doc_id bigint").repartition(6)
    got = {r[0]: r[1] for r in mh.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_chain_in_one_large_bucket(spark):
    """Neighbours are alike, the ends are not: links beyond the leader's reach must not be lost."""
    words = [f"c{i}" for i in range(400)]
    docs = [(i, " ".join(words[3 * i : 3 * i + 200])) for i in range(40)]
    got = mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), bands=60, rows=1, small=2).collect()
    assert {r[1] for r in got} == {0}


def test_variants_that_are_a_third_of_the_rows(spark):
    """Every variant is 0.811 like each other one by plain Jaccard; the group's size must not part them."""
    words = [f"v{i}" for i in range(9000)]
    docs = [(i, " ".join([*words[:at], f"own{i}", *words[at + 1 : 100]])) for i, at in enumerate(range(5, 95, 5))]
    docs += [(100 + i, " ".join(words[200 + 100 * i : 300 + 100 * i])) for i in range(36)]
    got = {r[0]: r[1] for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute(docs) == {i: 0 if i < 100 else i for i, _ in docs}


def weighted_pairs(docs):
    """Pairs that are alike by weights of true document frequencies, or by counts, as they are defined; and those by weights alone."""
    counts = {}
    for i, text in docs:
        w = re.findall(r"[0-9a-z]+", text.lower())
        counts[i] = Counter(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1)))
    n, df = len(docs), Counter(s for c in counts.values() for s in c)
    idf = {s: round(64 * (1 + math.log((1 + n) / (1 + k)) / math.log(2 + n) / 4)) for s, k in df.items()}
    weight = lambda c: {s: k * idf[s] for s, k in c.items()}
    by, pairs = {}, set()
    for i, c in counts.items():
        for s in c:
            by.setdefault(s, []).append(i)
    near = {(a, b) for own in by.values() for a, b in itertools.combinations(sorted(own), 2)}
    for a, b in near:
        for x, y in ((weight(counts[a]), weight(counts[b])), (counts[a], counts[b])):
            common = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
            if 5 * common >= 4 * (sum(x.values()) + sum(y.values()) - common):
                pairs.add((a, b))
    return pairs


@pytest.mark.parametrize("n", [300, 1500])
def test_recall_against_weighted_brute_force(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    common = [" ".join(rng.sample(words, 12)) for _ in range(20)]
    docs = []
    while len(docs) < n:
        base = [*rng.sample(words, rng.randrange(60, 200)), *common[rng.randrange(20)].split()]
        for _ in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.randrange(len(own) // 25 + 1)):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((len(docs), " ".join(own)))
    want = weighted_pairs(docs)
    got = {r[0]: r[1] for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    found = sum(got[a] == got[b] for a, b in want)
    assert len(want) > n / 6 and found >= 0.95 * len(want)
    linked = {frozenset(p) for p in want}
    parent = {i: i for i in got}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a, b in map(sorted, linked):
        parent[root(b)] = root(a)
    assert sum(got[i] != got[j] for i, j in itertools.combinations(got, 2) if root(i) == root(j)) <= 0.05 * len(want)
    assert all(root(i) == root(got[i]) for i in got)


def test_words_that_collide_modulo_powers_of_two(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    docs = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (1, 0)}


def test_links_are_counted(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*words[: 50 + i], "x", *words[51 + i :]])) for i in range(3)] + [(3, " ".join(words)), (4, " ".join(words)), (9, "none like it")]
    got = {r.doc_id: r for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[i].n_links for i in (0, 1, 2, 3, 4, 9)] == [3, 3, 3, 3, 3, 0]
    assert got[9].least_similarity is None and all(0.8 <= got[i].least_similarity < 1 for i in range(5))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(map(tuple, mh.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}


@pytest.mark.parametrize("most", [4, 10_000])
def test_components_of_few_and_of_many_links(spark, monkeypatch, most):
    """As by breadth-first search, with more links than one step takes and with fewer; few links take few jobs."""
    monkeypatch.setattr(mh, "PER_TASK", most)
    rng = random.Random(most)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i - 1) for i in range(401, 440)] + [(500, i) for i in range(501, 540)]
    near = {x: {x} for link in links for x in link}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(x for x in near if near[x] != {x}):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += near[y]
    spark.sparkContext.setJobGroup(f"components {most}", "")
    found = mh.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}"))
    assert dict(map(tuple, found.collect())) == want
    assert most < 10_000 or jobs <= 8


def test_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "q r s t u v"), (2, "q r s t u v")], "doc_id bigint, text string")
    got = sorted((tuple(r)[:2] for r in mh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (2, 1), (None, None)], key=str)
    assert mh.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("n,length,edits", [(200, 150, 2), (300, 60, 1), (150, 120, 2)])
def test_variants_of_one_text_lose_no_pair(spark, n, length, edits):
    """Buckets of variants, whose alike pairs end in one class though few of them are verified."""
    rng = random.Random(n)
    words = [f"v{i}" for i in range(20_000)]
    base, docs = rng.sample(words, length), []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(1, edits + 1)):
            own[rng.randrange(length)] = rng.choice(words)
        docs.append((i, " ".join(own)))
    want = weighted_pairs(docs)
    got = {r[0]: r[1] for r in mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert want and all(got[a] == got[b] for a, b in want)


def test_sketches_never_part_what_is_alike(spark):
    """Of random pairs of weighted sets, none that is alike is left out, and few that are far apart are kept."""
    rng, rows, sets = random.Random(8), [], {}
    for i in range(60):
        near = i % 2 and sets[i - 1]
        own = {s: k for s, k in near.items() if rng.random() > i / 150} if near else {rng.randrange(-(2**62), 2**62): rng.choice([1, 1, 2, 3]) for _ in range(rng.randrange(20, 300))}
        if near:
            own |= {rng.randrange(-(2**62), 2**62): 1 for _ in range(int(len(near) * i / 300))}
        sets[i] = own
        rows += [(i, s, 64 * k, k) for s, k in own.items()]
    weighed = spark.createDataFrame(rows, "node bigint, shingle bigint, weight bigint, times bigint")
    texts = spark.createDataFrame([(i, "x") for i in range(60)] + [(58, "y")], "doc_id bigint, text string")
    pairs = list(itertools.combinations(range(60), 2))
    sums = weighed.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum("times").alias("times")).join(mh._sketches(weighed, texts), "node")
    other = sums.select(*(F.col(c).alias(f"x_{c}") for c in sums.columns))
    both = sums.join(other, F.col("node") < F.col("x_node")).withColumn("far", mh._far("sketch", "x_sketch"))
    near = both.filter(mh._near(F.col("far"), F.col("weight") + F.col("x_weight"), F.col("times") + F.col("x_times")))
    kept = {(r.node, r.x_node): r.far for r in near.collect()}
    n_alike = 0
    for a, b in pairs:
        x, y = Counter(sets[a]), Counter(sets[b])
        common, union = sum((x & y).values()), sum((x | y).values())
        if 5 * common >= 4 * union:
            n_alike += 1
            assert (a, b) in kept and kept[a, b] <= union - common
    assert n_alike > 5 and len(kept) < 100 + 59  # of the node with two texts all pairs are kept


def test_waves_verify_what_is_needed(spark):
    """Two sets of copies of a ring of neighbours: one link for each two components, not all pairs of them."""
    words = [f"c{i}" for i in range(300)]
    docs = {i: " ".join(words[2 * i : 2 * i + 120]) for i in range(30)}
    texts = mh.stored(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    idf = mh._frequencies(texts)
    pairs = spark.createDataFrame([(a, b, b - a) for a, b in itertools.combinations(docs, 2)], "a bigint, b bigint, far bigint")
    none = spark.createDataFrame([], "a bigint, b bigint, similarity double, alike boolean")
    seen = mh._in_waves(pairs, none, spark.createDataFrame([], "node bigint, label bigint"), texts, idf)
    labels = dict(map(tuple, mh.components(seen.filter("alike")).collect()))
    assert set(labels.values()) == {0} and len(labels) == 30
    # A star of known links leaves one component and one node outside, of which the nearest pair is enough.
    star = spark.createDataFrame([(0, i, 1.0, True) for i in range(1, 29)], none.schema)
    known = spark.createDataFrame([(i, 0) for i in range(29)], "node bigint, label bigint")
    seen = mh._in_waves(pairs.filter("b = 29"), star, known, texts, idf)
    assert seen.count() == 28 + mh.NEAREST and seen.filter("b = 29").agg(F.min("a")).first()[0] == 29 - mh.NEAREST


def joined_rows(spark, since, what):
    """Rows that joins of this description have made in executions after `since`, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda it: iter(lambda: it.next() if it.hasNext() else None, None)
    n, last = 0, since
    for run in each(store.executionsList().iterator()):
        if run.executionId() > since:
            last, values = max(last, run.executionId()), store.executionMetrics(run.executionId())
            for node in each(store.planGraph(run.executionId()).allNodes().iterator()):
                if "Join" in node.name() and re.search(what, re.sub(r"#\d+L?", "", node.desc())):
                    n += sum(int(values.apply(x.accumulatorId()).replace(",", "")) for x in each(node.metrics().iterator()) if x.name() == "number of output rows" and values.contains(x.accumulatorId()))
    return n, last


def test_labels_meet_each_node_once_a_round(spark):
    """Nodes are in up to BANDS large buckets each, and still look up their label once in each round."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(20_000)]
    base, docs = rng.sample(words, 150), []
    for i in range(200):
        own = list(base)
        for _ in range(rng.randrange(1, 8)):
            own[rng.randrange(150)] = rng.choice(words)
        docs.append((i, " ".join(own)))
    _, since = joined_rows(spark, -1, "^$")
    mh.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()
    made, _ = joined_rows(spark, since, r"\[node\], \[node\], LeftOuter")
    assert 0 < made <= (mh.LEADERS + 2) * len(docs)
