"""Quality rules: statistics of whole texts and a learned decision list, in Spark expressions only.

Sequential covering: conjunctions of threshold tests are grown on two thirds of
the labelled documents by the gain of each test, pruned on the last third from
their end, and kept while they are precise on both; the documents that a rule
covers are set aside before the next is grown.  The outcome is an ordered list of
readable conditions and, from it, one conditional expression.

Growing needs counts only.  Spark puts each labelled document into a cell of
threshold intervals and counts labels by cell; the driver sees these counts, of
which there are at most SAMPLE, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, lowest

#: Labelled documents that the rules are learned from, at most: those whose ids hash lowest.
SAMPLE = 20_000
#: Intervals per statistic, rules, tests per rule, least share of bad documents that a rule may cover.
BINS, RULES, TESTS, PRECISION = 8, 8, 3, 0.9
#: Bad documents that a rule must cover in the growing part, and laplace-corrected share in the pruning part.
LEAST = 5
SPACE = " \t\n\x0b\x0c\r"


def statistics(text: Column) -> Column:
    """A struct of the counts that the rules use, from a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of(w: Column) -> Column:
        own = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(own).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.regexp_count(own, F.lit("[A-Z!]")).cast("bigint").alias("n_loud"),
        )

    return let(words, of)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more in the text.

    Windows are ordered by hash, so that equal ones stand together; the places of
    those with an equal neighbour are put in order, and each adds the words that the
    one before it does not reach.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a.last)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a.n)

    def equal(windows: Column) -> Column:
        near = lambda x, i: F.coalesce(F.get(windows, i).h == x.h, F.lit(False))
        same = F.filter(windows, lambda x, i: near(x, i - 1) | near(x, i + 1))
        return covered(F.sort_array(F.transform(same, lambda x: x.i)))

    def order(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return let(F.sort_array(F.transform(places, lambda i: F.struct(hashes(i).alias("h"), i.alias("i")))), equal)

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(order(words))


def shares(s: Column) -> dict[str, Column]:
    """What rules test, by name."""
    words, chars = F.greatest(s.n_words, F.lit(1)).cast("double"), F.greatest(s.word_chars, F.lit(1)).cast("double")
    return {
        "symbols_per_char": s.n_symbols / chars,
        "repeated_words": s.n_repeat_words / words,
        "dup_lines_per_word": s.n_dup_lines / words,
        "loud_per_char": s.n_loud / chars,
        "chars_per_word": s.word_chars / words,
        "words": s.n_words.cast("double"),
    }


def base_failed(s: Column) -> Column:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    value: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.name] > self.value if self.above else values[self.name] <= self.value


Rule = tuple[Test, ...]


def cells(labelled: DataFrame, bins: int = BINS) -> tuple[dict[str, list[float]], list[tuple]]:
    """Thresholds by statistic; by cell: the interval of each statistic, good and bad to grow on, good and bad
    to prune on, and for each statistic its least and greatest value among the good and among the bad."""
    names = [n for n in labelled.columns if n not in ("label", "grow")]
    shares_of = [i / bins for i in range(1, bins)]
    row = labelled.agg(*(F.percentile_approx(n, shares_of, 10_000).alias(n) for n in names)).first()
    # Of the bad ones too: the thresholds between the two lie where either has its quantiles.
    bad = labelled.filter("label = 0").agg(*(F.percentile_approx(n, shares_of, 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted({x for r in (row, bad) for x in (r[n] or ())}) for n in names}
    place = [sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in names]
    count = lambda grow, label: F.count(F.when((F.col("grow") == grow) & (F.col("label") == label), 1))
    ends = [f(F.when(F.col("label") == y, F.col(f"v_{n}"))) for n in names for y in (1, 0) for f in (F.min, F.max)]
    counts = [count(g, y) for g in (True, False) for y in (1, 0)]
    kept = labelled.select(*place, *(F.col(n).alias(f"v_{n}") for n in names), "label", "grow")
    rows = kept.groupBy(*names).agg(*(c.alias(f"_{i}") for i, c in enumerate(counts + ends))).collect()
    at = len(names) + len(counts)
    return cuts, [(tuple(r[: len(names)]), *r[len(names) : at], tuple(r[at:])) for r in rows]


def middle(name: int, above: bool, cut: float, covered: list[tuple], outside: list[tuple]) -> float:
    """A test's threshold: half way between the bad that its rule covers and the good on its other side, if they are apart; else the cut."""
    of = lambda at, y, last: [x for c in at if (x := c[5][4 * name + 2 * y + last]) is not None]
    bad, good = of(covered, 1, not above), of(outside, 0, above)
    if bad and good:
        near, far = (max(good), min(bad)) if above else (max(bad), min(good))
        if near <= cut and near < far:
            return (near + far) / 2
    return cut


def cover(cuts: dict[str, list[float]], counted: list, rules: int = RULES, tests: int = TESTS, precision: float = PRECISION, least: int = LEAST) -> list[Rule]:
    """An ordered list of rules for bad documents, from counts by cell."""
    names = list(cuts)
    left, found = list(counted), []
    holds = lambda test, cell: (cell[0][names.index(test[0])] > test[2]) == test[1]
    total = lambda rule, at, good, bad: [sum(c[k] for c in at if all(holds(t, c) for t in rule)) for k in (good, bad)]
    while left and len(found) < rules:
        rule: list[tuple[str, bool, int]] = []
        at = left
        while len(rule) < tests:
            good, bad = sum(c[1] for c in at), sum(c[2] for c in at)
            if not bad or not good:
                break
            best, best_gain = None, 1e-9
            for n, name in enumerate(names):
                by = [[0, 0] for _ in range(len(cuts[name]) + 1)]
                for c in at:
                    by[c[0][n]][0] += c[1]
                    by[c[0][n]][1] += c[2]
                low_good = low_bad = 0
                for k in range(len(cuts[name])):
                    low_good, low_bad = low_good + by[k][0], low_bad + by[k][1]
                    for above, g, b in ((False, low_good, low_bad), (True, good - low_good, bad - low_bad)):
                        if b >= least and (gain := b * (log2(b / (b + g)) - log2(bad / (bad + good)))) > best_gain:
                            best, best_gain = (name, above, k), gain
            if best is None:
                break
            rule.append(best)
            at = [c for c in at if holds(best, c)]
        if not rule:
            break

        def worth(part: list) -> float:
            g, b = total(part, left, 3, 4)
            return (b - g) / (b + g) if b + g else -1.0

        rule = max((rule[:n] for n in range(len(rule), 0, -1)), key=worth)
        good, bad = total(rule, left, 1, 2)
        held_good, held_bad = total(rule, left, 3, 4)
        if bad < least or bad < precision * (good + bad) or held_bad < precision * (held_good + held_bad):
            break
        covered = [c for c in left if all(holds(t, c) for t in rule)]
        found.append(tuple(Test(t[0], t[1], middle(names.index(t[0]), t[1], cuts[t[0]][t[2]], covered, [c for c in left if not holds(t, c)])) for t in rule))
        left = [c for c in left if not all(holds(t, c) for t in rule)]
    return found


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, **limits) -> list[Rule]:
    """The decision list for quality 0, from at most `sample` labelled documents.

    documents: doc_id, text; labels: doc_id, quality (0 bad, 1 good; others are not
    used).  Documents that fail the base test are not learned from, since the base
    test decides them.  No labels, or none of a kind, give no rules: all is kept.
    """
    ids = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    ids = lowest(ids, "doc_id", sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `sample` rows
    rows = rows.select("doc_id", "label", statistics(F.col("text")).alias("s"))
    # What fails the base test is marked and left out of the kept rows: as a filter here, Spark would
    # apply it to all documents, before the join.
    grow = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0
    rows = rows.select(*(c.alias(n) for n, c in shares(F.col("s")).items()), F.when(~base_failed(F.col("s")), F.col("label")).alias("label"), grow.alias("grow")).cache()
    try:
        return cover(*cells(rows.filter("label IS NOT NULL")), **limits)
    finally:
        rows.unpersist()


def verdict(text: Column, rules: list[Rule]) -> Column:
    """A struct: the statistics, base_failed, the number of the rule that rejects (null if none), kept."""

    def of(s: Column) -> Column:
        values, base = shares(s), base_failed(s)
        hit = F.lit(None).cast("int")
        for n in range(len(rules), 0, -1):  # the first rule that holds decides
            held = F.lit(True)
            for test in rules[n - 1]:
                held = held & test.column(values)
            hit = F.when(held, F.lit(n)).otherwise(hit)
        return let(hit, lambda h: F.struct(s.alias("statistics"), base.alias("base_failed"), h.alias("rule"), (~base & h.isNull()).alias("kept")))

    return let(statistics(text), of)


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The contract's columns, and the number of the rule that rejects (null if none).

    Only doc_id and text are read; one row comes out for each row that goes in.  A
    null, empty or blank text has no words and fails the base test.
    """
    v = documents.select("doc_id", verdict(F.col("text"), rules).alias("v"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return v.select("doc_id", *(F.col(f"v.statistics.{n}") for n in names), "v.base_failed", "v.kept", "v.rule")
