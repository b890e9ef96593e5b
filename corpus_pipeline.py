"""A corpus from raw documents to token ids: quality, near duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  Empty tables give empty tables; other
columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import bpe, decontam, minhash, pii, quality_rules
from strandline.llm.columns import stored, table
from strandline.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned rules keep; a null text has no words and goes.  Without labels only the base test counts."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_rules.verdict(F.col("text"), rules).kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id; a doc_id comes once, rows without one stay."""
    kept = minhash.near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    ids = docs.filter("doc_id IS NOT NULL")
    repeated = ids.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    one = ids.join(kept, "doc_id", "left_semi")
    if repeated:
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        one = one.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text").withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")
    return one.unionByName(docs.filter("doc_id IS NULL")) if repeated or docs.filter("doc_id IS NULL").limit(1).count() else one


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, each row judged by its own text.

    Rows that repeat a doc_id and a text go or stay together; of a doc_id with several
    texts, or of rows without doc_id, only the contaminated texts go.
    """
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_key"])
    return docs.join(found, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the names of its kinds; a null text stays null, n_chars follows the text."""
    own = "_spans_of_documents"  # the operator adds a column named spans, which documents may have too
    redacted = pii.scan(docs.withColumnRenamed("spans", own), rewrite=True).drop("spans").withColumnRenamed(own, "spans")
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*(f"`{c}`" for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was encoded and of what it decodes to; a null text counts as empty."""
    return bpe.digest(bpe.encode(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", encoding),
]

#: Learned rules, near-duplicate classes and token ids are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to a folder of this run in the shared folder, and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
