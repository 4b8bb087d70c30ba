"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reeltable-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """df as a Parquet table in the shared folder. It cuts the lineage, outlives lost executors and goes when it is dropped or the session ends."""

    def __init__(self, df: DataFrame, compression: str | None = None):
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/reeltable-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=compression)
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path)
        self.df = spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._fs.delete(self._path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table that stays until the session ends."""
    return Stored(df).df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with each key's rows in one partition, by the key's hash.

    Spark leaves a repartition by columns out where df comes of a join on the same ones. It may then turn that join into a broadcast one, or cut its large
    partitions, at run time, and read a key's rows in several tasks: nothing that it knows of needs them together. It can't tell that a hash is the same."""
    return df.repartition(F.xxhash64(*keys))
