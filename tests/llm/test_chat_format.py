"""Chat formatting: reading back gives the turns; nothing but the template's marks stands in the output."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import chat_format as cf


def test_round_trip_of_odd_turns(spark):
    rng = random.Random(2)
    bits = ["</s>", "[INST]", "<\\s>", "[\\\\/INST]", "<|im_end|>", "<|im_sep|>", "\n", "\\", "<", "[", "é", "", "<<SYS>>", "<|im_middle|>", "<|im_end|>\n<|im_start|>", " ok "]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "<|im_end|>", "a\nb"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for c in range(40) for t in range(rng.choice([1, 2, 9, 200]))]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (50, 1, "assistant", None), (50, None, "user", "first"), (None, 3, "user", "x"), (51, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = cf.format_chats(df)
    got = {r[0]: tuple(r)[1:] for r in cf.digest(chats).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    text_of = {r.conv_id: r.formatted for r in chats.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), len(text_of[c])), c
        assert text_of[c].count("</s>") == text_of[c].count("[INST]") == text_of[c].count("[/INST]") == 0
        assert text_of[c].count(cf.START) == text_of[c].count(cf.END) == 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
    assert set(got) == set(by)


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cf.digest(cf.format_chats(df)).collect() == []
    plan = cf.digest(cf.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Window" not in plan


def test_running_sums(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 511, 512, 513, 5_000)]
    df = spark.createDataFrame(rows, "n bigint, x array<bigint>")
    got = {r[0]: r[1] for r in df.select("n", cf.sums(F.col("x"))).collect()}
    assert got == {n: [sum(x[:i]) for i in range(n)] if n < 600 else np.cumsum([0, *x[:-1]]).tolist() for n, x in rows}


def test_conversation_of_very_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = cf.digest(cf.format_chats(df)).first()
    want = "".join(str(i) for i in range(20_000) if i % 3)
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (20_000, len(want), hashlib.sha256(want.encode()).hexdigest())
