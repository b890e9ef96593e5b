"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.shared import cut, remove_at_end, shared_dir

__all__ = ["cut", "join_hot", "let", "lowest", "sha256", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def lowest(df: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """At most `most` rows (of each value of `by`), those whose keys hash lowest: a fixed sample of bounded size.

    A cut at the share of hashes that leaves about four times as many rows comes first,
    so that ordering them is bounded too, however many rows and tasks there are.  `by`
    must have few values, such as languages: one row each is sent to every task.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32)) / F.lit(float(1 << 32))
    share = F.least(F.lit(1.0), F.lit(4.0 * most) / F.greatest(F.count("*"), F.lit(1)))
    if not by:
        near = df.withColumn("_place", place).filter(F.col("_place") < df.agg(share).first()[0])
        return near.orderBy("_place", key).limit(most).drop("_place")
    near = df.join(F.broadcast(df.groupBy(by).agg(share.alias("_share"))), by).withColumn("_place", place).filter("_place < _share")
    nth = F.row_number().over(Window.partitionBy(by).orderBy("_place", key))
    return near.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_share", "_place", "_nth")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "left", salts: int = 64) -> DataFrame:
    """left joined to the one row that `right` has for each key, where a third of `left` may have one key.

    The rows of a key are spread by a hash of `by` over `salts` parts; of `right` a key
    has as many rows as its rows in `left` fill parts.  `left` is read twice.
    """
    spread = F.when(F.col(by).isNull(), F.spark_partition_id()).otherwise(F.xxhash64(by))
    salted = left.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    return salted.join(salted.select(*on, "_salt").distinct().join(right, on), [*on, "_salt"], how).drop("_salt")


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: smaller than a checkpoint, for rows with texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
