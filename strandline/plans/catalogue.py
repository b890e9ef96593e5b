"""Where queries are registered, and the frames that many of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

HOUR, DAY = 3_600_000_000, 86_400_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: event_id, user_id, event_type, value, us (microseconds)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: each purchase is an operation with its times in microseconds."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("op_id"), F.col("user_id").alias("subject_id"), (F.col("us") - 3 * DAY).alias("adm"), F.col("us").alias("orin"), (F.col("us") + 2 * HOUR).alias("orout"), (F.col("us") + 4 * DAY).alias("disch"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with gaps: user_id, us, event_id, x (two of three rows), y (four of five rows)."""
    e = events(spark, sf_dir)
    return e.select("user_id", "us", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"), F.when(F.col("event_id") % 5 != 1, F.col("value") * 2).alias("y"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions: doc_id, lang, source, y (quality), z (toxic), score (a share of the text's length, with ties)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), F.col("toxic").alias("z"), (F.floor(F.least(F.col("n_chars"), F.lit(6400)) / 64) / 100.0).alias("score"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
OPS = f"{EV}, ops AS (SELECT event_id AS op_id, user_id AS subject_id, us - {3 * DAY} AS adm, us AS orin, us + {2 * HOUR} AS orout, us + {4 * DAY} AS disch FROM ev WHERE event_type = 'purchase')"
GAPS = f"{EV}, g AS (SELECT user_id, us, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS x, CASE WHEN event_id % 5 <> 1 THEN value * 2 END AS y FROM ev)"
PRED = "p AS (SELECT doc_id, lang, source, quality AS y, toxic AS z, floor(least(n_chars, 6400) / 64e0) / 100e0 AS score FROM documents JOIN labels USING (doc_id))"
