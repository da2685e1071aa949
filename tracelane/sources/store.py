"""Frames kept as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, or under a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracelane-')}"
    return f"{base.rstrip('/')}/tracelane/{uuid.uuid4().hex}"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Store:
    """Writes frames under one folder of their own and reads them back: a lost executor costs no more than the running stage. remove() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._kept = spark, scratch(spark), 0

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self._kept += 1
        path = f"{self.folder}/{self._kept}-{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
