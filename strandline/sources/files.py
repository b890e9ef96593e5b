"""Tables, dictionaries and parameters in files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.dictionary import Variable, check_against, from_rows


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, by an explicit schema; NaN and empty cells are null."""
    df = spark.read.schema(schema).csv(path, header=True, encoding=encoding, nanValue="NaN", nullValue="NA", emptyValue="")
    numbers = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def read_labelled(spark: SparkSession, paths: Sequence[str], labels: Sequence[str], schema: StructType | str, column: str = "model") -> DataFrame:
    """The rows of several CSV files, each with its file's label: one scan per file, one plan."""
    if len(paths) != len(labels):
        raise ValueError("as many labels as files are needed")
    out = None
    for path, label in zip(paths, labels, strict=True):
        one = read_csv(spark, path, schema).withColumn(column, F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", single: bool = False) -> None:
    """CSV with a header in a fresh folder; `single` for small tables that belong in one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, encoding=encoding)


def write_artefacts(tables: Mapping[str, DataFrame], root: str, key: str | None = None) -> None:
    """Each table as Parquet under its name; `key` partitions folders (for few distinct values, such as splits)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(key) if key else writer).parquet(f"{root}/{name}")


def read_artefact(spark: SparkSession, root: str, name: str, key: str | None = None, values: Sequence | None = None) -> DataFrame:
    """A table that write_artefacts wrote; the filter prunes folders or reaches the scan."""
    df = spark.read.parquet(f"{root}/{name}")
    return df.filter(F.col(key).isin(*values)) if key and values is not None else df


def units(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length of the files that match, without reading them."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def read_dictionary(spark: SparkSession, path: str) -> list[Variable]:
    """A variable dictionary from CSV (or Excel, where pandas can read it)."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return from_rows(pd.read_excel(path).astype(object).where(lambda d: d.notna(), None).to_dict("records"))
    rows = spark.read.csv(path, header=True).collect()  # one row per variable
    number = {"low", "high", "last_value"}
    return from_rows([{k: float(v) if k in number and v is not None else v for k, v in r.asDict().items()} for r in rows])


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, value: Mapping, path: str) -> None:
    """A small object as one JSON file in a fresh folder."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """The object of write_json; ValueError if it cannot be parsed."""
    return json.loads(_text(spark, path))


def parameters_to_dict(parameters: DataFrame) -> dict[str, dict[str, float]]:
    """name -> mean, sd; one row per variable of a dictionary."""
    return {r["var"]: {"mean": r["mean"], "sd": r["sd"]} for r in parameters.collect()}


def read_stats(spark: SparkSession, path: str, variables: Sequence[Variable]) -> dict:
    """Saved statistics, checked against the dictionary."""
    stats = read_json(spark, path)
    check_against(stats, variables)
    return stats


def read_parameters(spark: SparkSession, path: str, name: str = "var") -> DataFrame:
    """var, mean, sd from CSV; ValueError if a column is missing."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if lacking := {name, "mean", "sd"} - set(df.columns):
        raise ValueError(f"no columns {sorted(lacking)}")
    return df.select(F.col(name).alias("var"), F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd"))
