"""Tables of a ``foreachBatch`` sink: one version per micro-batch, in a folder that all machines share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RANGE = "version bigint, low bigint, high bigint"


@dataclass(frozen=True)
class VersionedRows:
    """Rows written per version with the range of positions they cover, so that a later version
    reads the versions that it needs and no others. Writing a version again replaces it."""

    folder: str

    def write(self, rows: DataFrame, version: int, position) -> list[tuple[int, int, int]]:
        """Write rows down; returns their range as a list of one (version, low, high), or of none."""
        path = f"{self.folder}/version={version}"
        rows.write.mode("overwrite").parquet(path)
        written = rows.sparkSession.read.schema(rows.schema).parquet(path)
        low, high = written.agg(F.min(position), F.max(position)).first()
        return [] if low is None else [(version, int(low), int(high))]

    def read(self, spark: SparkSession, schema, ranges: Sequence[tuple[int, int, int]], low: int) -> DataFrame:
        """The versions that reach up to ``low`` or beyond."""
        paths = [f"{self.folder}/version={version}" for version, _, high in ranges if high >= low]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    @staticmethod
    def still_needed(ranges: Sequence[tuple[int, int, int]], low: int) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in ranges if r[2] >= low]


def write_row(spark: SparkSession, row: tuple, schema: str, path: str) -> None:
    """One row as a table of its own, which is there as a whole or not at all."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def latest(spark: SparkSession, schema: str, folder: str) -> Row | None:
    """The row of the highest version, of those that were written as a whole."""
    context = spark.sparkContext
    pattern = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [s.getPath().getParent().toString() for s in found or []]
    if not paths:
        return None
    return spark.read.schema(schema).parquet(*paths).orderBy(F.desc("version"), F.desc("ended")).first()
