"""Stored feature tables: one Parquet partition per request."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timerange import to_micros


@dataclass(frozen=True)
class FeatureKey:
    """What a stored result is kept under: the data set's whole path, window geometry and requested range.

    The path goes in as a digest, the range in microseconds, so no two requests share a partition.
    """

    dataset: str
    window_size: int
    window_offset: int
    start: datetime
    end: datetime

    def partition(self) -> dict[str, str]:
        return {
            "dataset": "d" + hashlib.sha256(self.dataset.encode()).hexdigest()[:32],
            "window_size": f"{self.window_size}",
            "window_offset": f"{self.window_offset}",
            "range_start": f"{to_micros(self.start)}",
            "range_end": f"{to_micros(self.end)}",
        }

    def folder(self, root: str) -> str:
        return "/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in self.partition().items())])


def write_features(features: DataFrame, root: str, key: FeatureKey) -> None:
    """Store a feature table; an earlier result under the same key is replaced, others stay."""
    keys = key.partition()
    (
        features.withColumns({name: F.lit(value) for name, value in keys.items()})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(root)
    )


def has_features(spark: SparkSession, root: str, key: FeatureKey) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(key.folder(root))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_features(spark: SparkSession, root: str, key: FeatureKey) -> DataFrame:
    """A stored feature table, read from its own partition alone."""
    return spark.read.parquet(key.folder(root))


def read_or_compute(
    spark: SparkSession, root: str, key: FeatureKey, compute: Callable[[], DataFrame]
) -> DataFrame:
    """The stored result if there is one, else compute it, store it and read it back."""
    if not has_features(spark, root, key):
        features = compute()
        write_features(features, root, key)
        if not has_features(spark, root, key):
            return features
    return read_features(spark, root, key)
