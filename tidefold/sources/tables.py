"""Parquet tables, read in batch or as a stream; a feed that records are sent to."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under ``root``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def stream(
    spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 1
) -> DataFrame:
    """A directory of parquet files as a stream; new files are new records."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


@dataclass
class Feed:
    """A folder of small files that records are sent to, and a stream of them.

    Each ``send`` is one file, so a batch of records arrives as a whole; ``send_all`` is
    the way for many. ``size`` is the capacity in records over the feed's lifetime, those
    that are there already included; one more raises ``CapacityExceeded``.
    """

    spark: SparkSession
    path: str
    schema: StructType
    size: int | None = None

    def __post_init__(self) -> None:
        self._sent: int | None = None

    def _there(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema(self.schema).parquet(self.path).count() if files.exists(folder) else 0

    def send(self, *records: tuple | dict) -> None:
        """Appends records."""
        self.send_all(records)

    def send_all(self, records: Iterable[tuple | dict]) -> None:
        """Appends many records at once."""
        from tidefold.plans.pipeline import CapacityExceeded

        rows = list(records)
        if self.size is not None:
            self._sent = self._there() if self._sent is None else self._sent
            if self._sent + len(rows) > self.size:
                raise CapacityExceeded("Store is full")
            self._sent += len(rows)
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def replay(self, df: DataFrame, time_col: str, width: float, unit: float = 1e-9, pause: Callable[[float], object] = time.sleep) -> int:
        """Sends a recorded frame as it came: what lies in ``width`` seconds of ``time_col``
        together, each at its distance in time from the first; a gap of over a second is
        not waited for. ``unit`` is the length of a tick in seconds. Returns the spans sent."""
        span = F.floor(F.col(time_col) * F.lit(unit) / F.lit(width)).cast("long")
        held = df.withColumn("_span", span)
        began = last = None
        sent = 0
        for row in held.select("_span").distinct().orderBy("_span").toLocalIterator():
            at = row["_span"] * width
            if last is None or at - last > 1:
                began, last = time.monotonic() - at, at
            late = began + at - time.monotonic()
            if late > 0:
                pause(late)
            held.where(F.col("_span") == row["_span"]).select(*self.schema.names).coalesce(1).write.mode("append").parquet(self.path)
            last, sent = at, sent + 1
        return sent

    def stream(self, max_files_per_trigger: int = 1) -> DataFrame:
        """What has been and will be sent."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return stream(self.spark, self.path, self.schema, max_files_per_trigger)
