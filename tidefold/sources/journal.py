"""A journal: an append-only log of records, addressed by index.

The log is a frame with a column of consecutive indices; stored, it is a folder
of Parquet files. Readers are cursors; many may read one journal.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.plans.pipeline import CapacityExceeded


#: How often an append looks for a free place, a twentieth of a second apart.
TRIES = 600


@dataclass
class Journal:
    """``df`` with the index column ``seq``, from 0 without gaps."""

    df: DataFrame
    seq: str = "seq"

    def get_at(self, at: int) -> DataFrame:
        """The record at an index; no row past the end. The filter reaches the scan."""
        return self.df.where(F.col(self.seq) == at)

    def get_last(self) -> DataFrame:
        """The newest record; no row if there is none."""
        return self.df.orderBy(F.desc(self.seq)).limit(1)

    def get_window(self, at: int, n: int) -> DataFrame:
        """``n`` records from an index on, or no row if there are fewer."""
        rows = self.df.where(F.col(self.seq).between(at, at + n - 1))
        full = rows.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select(F.lit(1).alias("_full"))
        return rows.join(F.broadcast(full), F.lit(True), "left_semi")

    def sliding(self, n: int, value: Column, name: str, block: int = 1 << 16) -> DataFrame:
        """For each index with ``n`` records from it on, the sum of ``value`` over them.

        The log is cut into blocks of indices that overlap by ``n - 1`` records, so
        windows run in parallel instead of in one task.
        """
        if n > block:
            raise ValueError("a window is larger than a block")
        own = F.expr(f"{self.seq} div {block}")
        early = F.expr(f"({self.seq} - {n - 1}) div {block}")
        blocks = F.array_distinct(F.array(own, F.when(F.col(self.seq) >= n - 1, early).otherwise(own)))
        spread = self.df.select(self.seq, value.alias(name)).withColumn("_block", F.explode(blocks))
        frame = Window.partitionBy("_block").orderBy(self.seq).rowsBetween(0, n - 1)
        out = spread.withColumn("_n", F.count(F.lit(1)).over(frame)).withColumn(name, F.sum(name).over(frame))
        return out.where((F.col("_n") == n) & (F.col("_block") == own)).select(self.seq, name)

    def size(self) -> int:
        """The number of records."""
        return self.df.count()

    def reader(self) -> Reader:
        """A new cursor at the beginning."""
        return Reader(self)

    def latest(self, *slot: str) -> DataFrame:
        """The newest record of each slot."""
        names = [c for c in self.df.columns if c not in slot]
        newest = self.df.groupBy(*slot).agg(F.max_by(F.struct(*names), self.seq).alias("_r"))
        return newest.select(*slot, "_r.*")


class Reader:
    """An independent cursor; fetches a span of records at a time."""

    SPAN = 1024

    def __init__(self, journal: Journal) -> None:
        self.journal, self.at = journal, 0
        self._span: list[Row] = []
        self._from = 0

    def _record(self, at: int) -> Row | None:
        if not self._from <= at < self._from + len(self._span):
            seq = self.journal.seq
            rows = self.journal.df.where(F.col(seq).between(at, at + self.SPAN - 1)).orderBy(seq).collect()
            self._span, self._from = rows, at
        i = at - self._from
        return self._span[i] if 0 <= i < len(self._span) else None

    def next(self) -> bool:
        """Advances if there is a record; at the end the cursor stays."""
        if self._record(self.at) is None:
            return False
        self.at += 1
        return True

    def get(self) -> Row | None:
        """The current record; None before the first ``next``."""
        return self._record(self.at - 1) if self.at else None

    def with_current(self, fn: Callable[[Row], object]) -> object | None:
        """``fn`` of the current record, or None."""
        row = self.get()
        return None if row is None else fn(row)

    def get_index(self) -> int:
        """How many records have been consumed."""
        return self.at

    def __iter__(self) -> Iterator[Row]:
        while self.next():
            row = self.get()
            assert row is not None
            yield row

    def handle_remaining(self, fn: Callable[[DataFrame], object]) -> int:
        """Gives the backlog to ``fn`` as one frame and commits the cursor after it."""
        seq = self.journal.seq
        rest = self.journal.df.where(F.col(seq) >= self.at)
        end = rest.agg(F.max(seq)).first()[0]
        if end is None:
            return 0
        fn(rest.where(F.col(seq) <= end))
        n, self.at = end + 1 - self.at, end + 1
        return n


@dataclass
class JournalStore:
    """A journal in a folder of Parquet files, or in memory without a path.

    ``size`` is the capacity in records over its lifetime; None is unbounded.
    Unlike a memory-mapped file, a reopened store goes on where it ended. An append
    becomes a folder named by its first and last index, moved into place in one step that
    fails if another writer has taken that place; it then numbers its records anew. So
    indices have no gaps and no doubles, and a reader sees whole appends.
    """

    spark: SparkSession
    schema: str
    path: str | None = None
    size: int | None = None
    seq: str = "seq"

    def __post_init__(self) -> None:
        self._memory = self.spark.createDataFrame([], f"{self.seq} bigint, {self.schema}")
        self._count = self._parts = 0

    def _files(self) -> tuple:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def count(self) -> int:
        """Records so far, from the names of the appends."""
        if self.path is None:
            return self._count
        folder, files = self._files()
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max((int(n.split("-")[1]) + 1 for n in names if n.startswith("from=")), default=0)

    def journal(self) -> Journal:
        """What has been appended so far."""
        if self.path is None or not self.count():
            return Journal(self._memory, self.seq)
        reader = self.spark.read.schema(f"{self.seq} bigint, {self.schema}").option("recursiveFileLookup", "true")
        return Journal(reader.parquet(f"{self.path}/from=*"), self.seq)

    def append(self, rows: DataFrame, order: list[str]) -> int:
        """Appends records in the order given; returns the new size.

        Indices are counted range by range: a range's offset is the number of
        records before it, so no single task numbers them all.
        """
        from tidefold.plans.ranged import materialised

        parts = materialised(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
        sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = sizes.select("_part", before.alias("_start"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
        named = parts.withColumn("_place", place).join(starts, "_part").withColumn("_at", F.col("_start") + F.col("_place"))
        more = sizes.agg(F.sum("_n")).first()[0] or 0
        for _ in range(TRIES):
            had = self.count()
            if self.size is not None and had + more > self.size:
                raise CapacityExceeded("Store is full")
            if not more:
                return had
            out = named.select((F.lit(had) + F.col("_at")).cast("long").alias(self.seq), *rows.columns)
            if self.path is None:
                self._keep(materialised(out))
                self._count = had + more
                return self._count
            if self._moved(out, had, more):
                return had + more
        raise RuntimeError("another writer has taken the next place and not filled it")

    def _keep(self, part: DataFrame) -> None:
        """One more part; many are written as one, so the plan stays short."""
        from tidefold.plans.ranged import materialised

        self._memory, self._parts = self._memory.unionByName(part), self._parts + 1
        if self._parts >= 64:
            self._memory, self._parts = materialised(self._memory), 0

    def _moved(self, out: DataFrame, had: int, more: int) -> bool:
        """Writes an append aside and moves it into place; False if the place is taken."""
        folder, files = self._files()
        jvm = self.spark._jvm
        aside = f"{self.path}/_aside-{uuid.uuid4()}"
        out.write.parquet(aside)
        if not self._claimed(had):
            files.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
            time.sleep(0.05)  # until it has moved its append
            return False
        return files.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{self.path}/from={had:019d}-{had + more - 1:019d}"))


    def _claimed(self, at: int) -> bool:
        """Whether the place from an index on is now this writer's; one of several gets it."""
        folder, files = self._files()
        claim = self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"_claim-{at:019d}")
        if files.getScheme() == "file":  # where Hadoop looks first and creates then
            try:
                os.close(os.open(claim.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            files.create(claim, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception):
                raise
            return False
        return True


class Slots:
    """The newest state of each slot, which writers set by number."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.store = JournalStore(spark, f"_i bigint, slot bigint, {schema}")

    def set(self, at: int, *state: object) -> None:
        """Puts a state in a slot."""
        self.set_all([(at, *state)])

    def set_all(self, rows: list[tuple]) -> None:
        """Puts many, in order; of several for a slot the last stays."""
        held = self.store.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], self.store.schema)
        self.store.append(held, ["_i"])

    def latest(self) -> DataFrame:
        """Slot and state of every slot that was set."""
        return self.store.journal().latest("slot").drop(self.store.seq, "_i")
