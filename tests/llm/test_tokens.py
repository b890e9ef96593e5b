"""Token counts and byte-pair encoding against the vocabularies' own libraries."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from strandline.llm import bpe, token_counts  # noqa: E402


def texts():
    rng = random.Random(5)
    marks = ["a", "the", " ", "  ", "\n", "é", "ß", "你好", "<|endoftext|>", "</s>", "▁", "'s", "12", "!?", " ", "é", "Σ", "\t", "İ", "x" * 40, "\x00", "😀", "ﬁ"]
    out = [None, "", " ", "\n\n", "plain words only", "<|startoftext|><|endoftext|>", "a" * 70_000, "ab " * 30_000, "▁ " * 9000]
    out += ["".join(rng.choice(marks) + rng.choice(["", " "]) for _ in range(rng.choice([3, 30, 20_000]))) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(0, None, 0), (4, "plain words only", 1)]
    return spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")


def test_counts_as_the_library(frame):
    model = token_counts.load(P.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in enumerate(texts())]
    want += [want[0], want[4]]
    got = [tuple(r) for r in token_counts.count_tokens(frame, P.path("piece_bpe_32k.model")).collect()]
    assert sorted(got) == sorted(want)


def test_parts_make_up_the_text():
    for t in texts():
        parts = token_counts.split(t or "", 50)
        assert " ".join(parts) == (t or "")


def test_ids_and_decoding_as_the_library(frame):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t in [*enumerate(texts()), (0, None), (4, "plain words only")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        hexes = (hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
        want.append((i, len(ids), *hexes))
    got = [tuple(r) for r in bpe.digest(bpe.encode(frame, P.path("word_bpe_49k.json"))).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(frame):
    assert bpe.encode(frame.limit(0), P.path("word_bpe_49k.json")).collect() == []
    assert token_counts.count_tokens(frame.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_words_in_use_stay_in_the_store(monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 10)
    model, asked = bpe.Bpe(P.path("word_bpe_49k.json")), []
    monkeypatch.setattr(model, "encode_word", lambda word, own=model.encode_word: asked.append(word) or own(word))
    for i in range(100):
        model.encode("often " + "q" * (i % 50 + 1) + chr(97 + i // 50))
    assert asked.count("often") == 1
    assert len(asked) == 101
    assert len(model.store) + len(model.store.older) <= 20


def test_short_and_long_words_merge_alike():
    rng, model = random.Random(3), bpe.Bpe(P.path("word_bpe_49k.json"))
    for _ in range(500):
        ids = [rng.choice(model.first) if rng.random() < 0.2 else model.first[b] for b in "".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(1, 60))).encode()]
        assert model._merged(list(ids)) == model._merged_long(list(ids))
