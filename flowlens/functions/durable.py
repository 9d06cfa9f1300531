"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set.

    The folder named in ``spark.checkpoint.dir`` is used. Without it a scratch folder
    serves a local session; on a cluster that would not survive a lost machine, so it fails.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Compute a DataFrame now and keep it in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared checkpoint folder that one computation writes and reads again.

    ``drop`` frees a table, or all of them, as soon as nothing will read it any more. Tables
    that a returned DataFrame still reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        checkpoint_folder(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a DataFrame down and return the DataFrame that reads it."""
        self.written += 1
        path = f"{self.folder}/{self.written}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables."""
        context = self.spark.sparkContext
        for table in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
