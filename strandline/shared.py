"""The folder that the driver and all executors share, for rows that must not be computed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.  Without one, a session on one machine gets a folder of its own; a cluster, an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
        held = sc._jsc.sc().getCheckpointDir()
        remove_at_end(spark, held.get())
    return held.get()


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver remove a folder of intermediate rows when it ends."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, whose size Spark knows when it plans."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    held = path(shared_dir(spark)).toUri().getPath()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = path(folder)
        if at.getParent().toUri().getPath() == held:
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
