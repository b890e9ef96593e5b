"""Chat conversations as text, with a loss mask, in Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged by array functions and share a block:

    <|im_start|>role<|im_middle|>text<|im_sep|>text<|im_end|>\n

Control strings inside roles and texts are escaped by a backslash after their
first character (one more where there are some already), so no control string
stands in the output but the template's own, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, sha256

START, MIDDLE, SEP, END = "<|im_start|>", "<|im_middle|>", "<|im_sep|>", "<|im_end|>"
#: What follows the first character of each control string that is escaped.
REST = r"(/?s>|/?INST\]|/?SYS>>|\|(?:im_start|im_middle|im_sep|im_end|endoftext|startoftext|user|assistant|system)\|>)"
#: Array elements in a piece of a running sum; code points in a part of a formatted conversation that is read back.
PIECE, PART = 512, 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, "$1$2$3")


def sums(numbers: Column) -> Column:
    """Running sums of an array of bigints, each without its own number.

    An aggregation that appends to an array copies it at each step, so it is done for
    pieces of PIECE numbers and for the totals of the pieces.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def within(piece: Column) -> Column:
        start = F.struct(zero.alias("sum"), none.alias("before"))
        return F.aggregate(piece, start, lambda a, x: F.struct((a.sum + x).alias("sum"), F.concat(a.before, F.array(a.sum)).alias("before")))

    def whole(pieces: Column) -> Column:
        totals = within(F.transform(pieces, lambda p: p.sum)).before
        return let(totals, lambda t: F.flatten(F.transform(pieces, lambda p, i: F.transform(p.before, lambda x: x + F.get(t, i)))))

    def of(x: Column) -> Column:
        places = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(places, lambda i: within(F.slice(x, i, PIECE))), whole)

    return let(numbers, of)


def blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one: array of (role, texts), from sorted turns of (turn, role, text)."""
    first = lambda t: F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1).role != x.role), i)), lambda i: i.isNotNull())

    def of(t: Column) -> Column:
        def merged(starts: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(t))
            return F.transform(starts, lambda s, k: F.struct(F.get(t, s).role.alias("role"), F.transform(F.slice(t, s + 1, upto(k) - s), lambda x: x.text).alias("texts")))

        return let(first(t), merged)

    return let(turns, of)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, n: spans in code points).

    turns: conv_id, turn, role, text; other columns are not read.  Turns are ordered by
    (turn, role, text), nulls first; repeated rows are turns of their own.  A null text
    or role counts as empty; rows without conv_id make one conversation with a null id.
    The spans cover each text of `loss_role` and nothing else.  An empty table gives no
    rows.  The turn structs of a conversation are collected and sorted as one array,
    merged by role, and concatenated: a conversation becomes one string, so its rows
    meet in one task whatever the plan; all else is spread.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("turn"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv_id", blocks(F.col("turns")).alias("blocks"))
    # Each text with what stands before it: the head of its block, or the mark between texts.
    head = lambda b: F.concat(F.lit(START), escape(b.role), F.lit(MIDDLE))
    opened = lambda b, k: F.when(k == 0, head(b)).otherwise(F.concat(F.lit(END + "\n"), head(b)))
    piece = lambda b, k, x, i: F.struct(F.when(i == 0, opened(b, k)).otherwise(F.lit(SEP)).alias("head"), escape(x).alias("body"), (b.role == loss_role).alias("learn"))
    pieces = F.flatten(F.transform("blocks", lambda b, k: F.transform(b.texts, lambda x, i: piece(b, k, x, i))))
    per = per.select("conv_id", pieces.alias("pieces"))
    long = lambda x: F.length(x).cast("bigint")
    starts = sums(F.transform("pieces", lambda p: long(p.head) + long(p.body)))
    spans = lambda s: F.transform("pieces", lambda p, i: F.when(p.learn, F.struct((F.get(s, i) + F.length(p.head)).alias("start"), long(p.body).alias("n"))))
    loss = F.filter(let(starts, spans), lambda x: x.isNotNull())
    return per.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body)), ""), F.lit(END + "\n")).alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text)."""
    quoted = [x.replace("|", r"\|") for x in (MIDDLE, SEP, END)]

    def turns(block: Column) -> Column:
        def of(parts: Column) -> Column:
            role = unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(START) + 1)))
            return F.transform(F.split(F.get(parts, F.lit(1)), quoted[1]), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

        return let(F.split(block, quoted[0], 2), of)

    blocks = F.filter(F.split(formatted, quoted[2] + "\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output."""
    # Cut into parts first: a place in a long string is found by walking to it.
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("formatted") / F.lit(PART)).cast("int")), lambda i: F.substr("formatted", i * PART + 1, F.lit(PART)))
    nth = lambda n: F.floor(n / F.lit(PART)).cast("int")
    near = lambda p, s: F.array_join(F.slice(p, nth(s.start) + 1, nth(s.start + s.n) - nth(s.start) + 1), "")
    spans = lambda p: F.transform("loss", lambda s: unescape(F.substr(near(p, s), (s.start % PART).cast("int") + 1, s.n.cast("int"))))
    under = F.array_join(let(parts, spans), "")
    rows = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under.alias("under"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"),
        sha256(F.col("under")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts are control strings."""
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The same in plain SQL.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, role)),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)REST', '\1\\\2\3', 'g')) AS body, length(regexp_replace(role, '([<\[])(\\*)REST', '\1\\\2\3', 'g')) AS head,
    coalesce(lag(role) OVER w = role, FALSE) AS same
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN same THEN 10 ELSE 12 + head + 13 + 10 + 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("REST", REST.replace("'", "''"))
