"""Tables of many entities, kept so that one entity is read from one small part of each.

Rows lie in folders by a hash of the key, sorted by it within each file, so that Parquet's
statistics of row groups are an index of keys.  A reader works out the folder from the key:
nothing is listed but that folder, and of its file only the row groups that hold the key are
read.  A manifest, written last, says what is whole.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SHARDS = 256
MANIFEST = "manifest"


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def write(tables: Mapping[str, DataFrame], root: str, key: str, shards: int = SHARDS, group_bytes: int = 8 << 20) -> None:
    """Each table under its name, in `shards` folders by the key's hash.

    A folder has one file, or, where its rows are over Spark's advisory size of a partition
    (a busy key), as many as adaptive execution cuts it into, so no task writes a hot key alone.
    Choose shards so that one is below that size.  Columns named like the folders
    (_shard) are refused; a null key is a key.  group_bytes: size of a row group.
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    kinds = {df.schema[key].dataType.simpleString() for df in tables.values()}
    if len(kinds) != 1:
        raise ValueError(f"{key} has several types: {sorted(kinds)}")
    for name, df in tables.items():
        if "_shard" in df.columns or name == MANIFEST:
            raise ValueError(f"a name that the store needs, in {name}")
        placed = df.withColumn("_shard", _shard(F.col(key), shards)).hint("rebalance", "_shard").sortWithinPartitions("_shard", key)
        placed.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("_shard").parquet(f"{root}/{name}")
    rows = [(name, key, kinds.copy().pop(), shards, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, key string, kind string, shards int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{MANIFEST}")


def _folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class Store:
    """What write() left under `root`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        rows = spark.read.parquet(f"{root}/{MANIFEST}").collect()  # a row for each table
        self.key, self.kind, self.shards = rows[0]["key"], rows[0]["kind"], rows[0]["shards"]
        self.schemas = {r["name"]: StructType.fromJson(json.loads(r["columns"])) for r in rows}

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}").select(*(f"`{c}`" for c in self.schemas[name].names))

    def entities(self, keys: Sequence, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The rows of these entities in each table, from their folders alone; a table without any is empty."""
        names = list(names or self.schemas)
        one = self.spark.createDataFrame([(k,) for k in keys], f"k {self.kind}")
        found = one.select("k", _shard(F.col("k"), self.shards).alias("s")).collect()  # the keys asked for
        known, own = sorted({r["k"] for r in found if r["k"] is not None}), F.col(f"`{self.key}`")
        wanted = own.isin(*known) if known else F.lit(False)
        if any(r["k"] is None for r in found):
            wanted = wanted | own.isNull()
        out = {}
        for name in names:
            paths = [p for p in (f"{self.root}/{name}/_shard={s}" for s in sorted({r["s"] for r in found})) if _folder(self.spark, p)]
            schema = self.schemas[name]
            rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            out[name] = rows.filter(wanted)
        return out
