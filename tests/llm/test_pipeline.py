"""The pipeline, stage by stage, against brute force on a small corpus."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from strandline.llm import columns, pii, quality_rules  # noqa: E402

from . import test_decontam, test_minhash, test_quality_rules  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.sample(words, n))
    bench = [(i, " ".join(rng.sample(words, 30))) for i in range(5)]
    docs = [(i, text(rng.randrange(80, 200))) for i in range(120)]
    labels = [(i, 1) for i in range(120)]
    for i in range(120, 160):
        docs.append((i, " ".join(w + "$$$" for w in rng.sample(words, 90))))
        labels.append((i, 0))
    docs += [(200 + i, docs[i][1] + " tail") for i in range(20)] + [(300 + i, docs[50][1]) for i in range(30)]
    docs += [(400 + i, text(100) + " " + bench[i][1]) for i in range(5)]
    docs += [(500 + i, text(90) + f" a{i}@mail.example.com +1 (663) 555-68{i:02d} 10.0.0.{i}") for i in range(5)]
    docs += [(600, None), (601, ""), (602, "short"), (603, text(2900) + " " + bench[0][1])]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, bench


def test_each_stage(spark, corpus, tmp_path):
    folder, _, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        made = stage(spark, docs, folder)
        if name == "quality_rules":
            rules = quality_rules.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            want = {i for i, t in before.items() if not test_quality_rules.brute(t)[5] and "$" not in (t or "")}
            assert rules and {r.doc_id for r in made.collect()} == want
        elif name == "near_dedup":
            classes = test_minhash.brute(list(before.items()))
            assert {r.doc_id for r in made.collect()} == {i for i, c in classes.items() if i == c}
        elif name == "decontamination":
            found = test_decontam.brute(list(before.items()), bench)
            want = {i for i in before if not found[i][4]}
            assert {r.doc_id for r in made.collect()} == want and 603 in want and 400 not in want
        elif name == "pii":
            got = {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
            assert got == {i: (x := pii.redact(t, pii.find(t)), len(x)) for i, t in before.items()}
            assert not any("@" in t or " 555-68" in t or "10.0.0." in t for t, _ in got.values())
        else:
            tokenizers = pytest.importorskip("tokenizers")
            library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            encoded = {i: library.encode(t, add_special_tokens=False).ids for i, t in before.items()}
            want = {(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, ids in encoded.items()}
            assert {tuple(r) for r in made.collect()} == want
            break
        assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_run_is_the_stages(spark, corpus):
    folder, docs, _ = corpus
    rows = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in rows.collect()}
    assert ids and ids < {i for i, _ in docs} and not ids & set(range(120, 160)) and not ids & set(range(400, 405))


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    folder, docs, _ = corpus
    good = docs[0][1]
    odd = spark.createDataFrame([(1, good, "x"), (1, good, "x"), (None, good, "y"), (2, None, None), (3, docs[1][1], None)], "doc_id bigint, text string, spans string")
    for frame, most in ((odd, 5), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, frame, folder)
            assert made.count() <= most
            if made.columns == ["doc_id", "text", "spans"]:
                frame = made
    kept = corpus_pipeline.near_duplicates(spark, odd, folder)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, None]


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_decontamination_goes_by_row(spark, corpus):
    """A contaminated row without doc_id, or of a doc_id with several texts, takes no clean one with it."""
    folder, docs, bench = corpus
    rows = [(None, docs[0][1]), (None, bench[0][1]), (7, docs[1][1]), (7, bench[1][1]), (None, None), (8, docs[2][1]), (8, docs[2][1])]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), folder)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)


def test_runs_do_not_share_their_folder(spark, corpus):
    folder, _, _ = corpus
    one = corpus_pipeline.run(spark, folder)
    before = sorted(map(tuple, one.collect()))
    corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, one.collect())) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))})

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        columns.shared_dir(Session())
