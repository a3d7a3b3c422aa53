"""Pipelines: stages of operators over an ordered source, in batch or as a stream."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidefold.functions.format import format_duration
from tidefold.measure import OpCounter, progress_line
from tidefold.operators.ops import QUANTILES, Latency, Operator, Progress, data_columns, flattened


class CapacityExceeded(RuntimeError):
    """A source or stage has more records than its pipeline allows."""


@dataclass(frozen=True)
class Pipeline:
    """Stages over records ordered by ``order``, columns that make a total order.

    ``max_rows`` bounds the records of the source over its lifetime, ``capacities`` those
    that come out of each stage (None: unbounded). They are checks, not limits: a batch of
    more records raises ``CapacityExceeded``; a stream ends with it after the micro-batch
    that went over. A pipeline without stages passes records on.
    """

    order: tuple[str, ...]
    stages: tuple[tuple[Operator, ...], ...] = ()
    max_rows: int | None = None
    capacities: tuple[int | None, ...] = ()

    def stage(self, *ops: Operator, capacity: int | None = None) -> Pipeline:
        """The pipeline with one more stage of operators."""
        return replace(self, stages=(*self.stages, ops), capacities=(*self.capacities, capacity))

    def _operators(self) -> list[Operator]:
        return flattened(op for stage in self.stages for op in stage)

    def shared_key(self, columns: list[str]) -> list[str]:
        """Source columns that are in the key of every keyed operator.

        Bringing records together by those once serves all of them.
        """
        keys = [k for op in self._operators() if (k := op.keys())]
        if len({frozenset(k) for k in keys}) < 2:  # Spark itself shares the exchange of equal keys
            return []
        return [c for c in keys[0] if c in columns and all(c in k for k in keys[1:])]

    def _frames(self, df: DataFrame, stream: bool = False) -> Iterator[tuple[DataFrame, list[str]]]:
        """The source and what comes out of each stage, with the hidden order columns."""
        out, order = self._start(df)
        yield out, order
        for k, (stage, capacity) in enumerate(zip(self.stages, self.capacities, strict=True)):
            for op in flattened(stage):
                out, order = (op.stream if stream else op.batch)(out, order)
            if capacity is not None:
                if stream:
                    out = out.observe(f"stage {k}", F.count(F.lit(1)).alias("n"))
                else:
                    _within(out, capacity)
            yield out, order

    def _whole(self, df: DataFrame, stream: bool = False) -> tuple[DataFrame, list[str]]:
        out = None
        for out in self._frames(df, stream):
            pass
        assert out is not None
        return out

    def intermediates(self, df: DataFrame, keep_order: bool = False) -> list[DataFrame]:
        """The source and what comes out of each stage. Any number of consumers may go on
        from each; what they share is planned once if they meet again in one query."""
        return [f if keep_order else f.select(*data_columns(f, order)) for f, order in self._frames(df)]

    def _start(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        if self.max_rows is not None:
            if df.isStreaming:
                df = df.observe("source", F.count(F.lit(1)).alias("n"))
            else:
                _within(df, self.max_rows)
        order = [f"_o{i}" for i in range(len(self.order))]
        out = df.select("*", *[F.col(c).alias(o) for c, o in zip(self.order, order, strict=True)])
        shared = self.shared_key(df.columns)
        if shared and not df.isStreaming:
            out = out.repartition(*shared)
        return out, order

    def run(self, df: DataFrame, keep_order: bool = False) -> DataFrame:
        """The pipeline over a bounded frame; ``keep_order`` keeps the hidden columns."""
        out, order = self._whole(df)
        return out if keep_order else out.select(*data_columns(out, order))

    def receive(self, df: DataFrame) -> Iterator[Row]:
        """The results in order, one by one, without gathering them."""
        out, order = self._whole(df)
        return out.orderBy(*order).select(*data_columns(out, order)).toLocalIterator()

    def stream(self, df: DataFrame, keep_order: bool = False) -> DataFrame:
        """The pipeline over a streaming frame."""
        out, order = self._whole(df, True)
        return out if keep_order else out.select(*data_columns(out, order))

    def start(self, df: DataFrame, name: str, checkpoint: str, folder: str | None = None, **trigger: Any) -> StreamRun:
        """Runs the stream; ``trigger`` goes to the writer.

        Results go to Parquet in ``folder``, a micro-batch in a part of its own that is
        written whole or again, so each result is there once, even after a restart.
        Without a folder they go to a table ``name`` in the driver's memory, for tests and
        small results. The state store of the session must be RocksDB's; it is set here.
        """
        from tidefold.session import ROCKSDB_PROVIDER

        spark = df.sparkSession
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        out, order = self._whole(df, True)
        bounds = {"source": self.max_rows} | {f"stage {k}": c for k, c in enumerate(self.capacities)}
        monitor = _Monitor({n: b for n, b in bounds.items() if b is not None}, [r for op in self._operators() for r in op.reporters()])
        if folder is None:
            writer = out.writeStream.format("memory")
        else:
            writer = out.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/batch={k}"))
        writer = writer.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
        spark.streams.addListener(monitor)
        query = (writer.trigger(**trigger) if trigger else writer).start()
        monitor.follow(query)
        return StreamRun(spark, query, name, order, out.schema.simpleString(), folder, monitor)


def _within(df: DataFrame, most: int) -> None:
    if df.limit(most + 1).count() > most:
        raise CapacityExceeded(f"more than {most} records: Store is full")


class _Monitor(StreamingQueryListener):
    """Adds up what a stream observes: ends it beyond a bound, and has reports written."""

    def __init__(self, bounds: dict[str, int], reporters: list[Progress | Latency]) -> None:
        self.bounds, self.reporters = bounds, {r.name: r for r in reporters}
        self.query: StreamingQuery | None = None
        self.early: list[Any] = []
        self.ops = OpCounter()
        self.counters = {n: self.ops.new_counter() for n in (*bounds, *self.reporters)}
        self.told = dict.fromkeys(self.reporters, 0)
        self.begun = time.monotonic()
        self.last = dict.fromkeys(self.reporters, self.begun)
        self.error: CapacityExceeded | None = None

    def follow(self, query: StreamingQuery) -> None:
        """The query to listen to; what it has told before is caught up on."""
        self.query = query
        early, self.early = self.early, []
        for progress in early:
            self._take(progress)

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        self._take(event.progress) if self.query is not None else self.early.append(event.progress)

    def _take(self, progress: Any) -> None:
        if self.query is None or str(progress.runId) != str(self.query.runId):
            return
        for name, row in progress.observedMetrics.items():
            if name in self.bounds and self.counters[name].add(row["n"]) > self.bounds[name] and self.error is None:
                self.error = CapacityExceeded(f"{name}: more than {self.bounds[name]} records: Store is full")
                self.query.stop()
            if name in self.reporters and row["records"]:
                self._report(self.reporters[name], row, self.counters[name].add(row["records"]))

    def _report(self, reporter: Progress | Latency, row: Row, total: int) -> None:
        recent, now = total - self.told[reporter.name], time.monotonic()
        if recent < reporter.interval:
            return
        if isinstance(reporter, Progress):
            reporter.log(progress_line(reporter.name, total, recent, now - self.last[reporter.name], now - self.begun))
        elif row["count"]:
            stats = " ".join(f"{k}={format_duration(row[k])}" for k in ("min", "max", "mean", *QUANTILES))
            reporter.log(f"[{reporter.name}] count={row['count']} {stats}")
        self.told[reporter.name], self.last[reporter.name] = total, now


@dataclass
class StreamRun:
    """A running pipeline with a cursor over its results, in the order they arrive.

    Results that are fetched together, at most those of a micro-batch in a folder, come in
    the order of their records; a late record's result comes when it has arrived, and
    each result once.
    """

    spark: SparkSession
    query: StreamingQuery
    name: str
    order: list[str]
    shape: str
    folder: str | None = None
    monitor: _Monitor | None = None
    fetched: int = 0
    waiting: list[Row] = field(default_factory=list)

    def await_idle(self, timeout: float = 60.0) -> bool:
        """Waits until all records that are there have been processed; False on timeout."""
        end = time.monotonic() + timeout
        while time.monotonic() < end:
            if not self.query.isActive:
                self.failed()
                return True
            status, progress = self.query.status, self.query.lastProgress
            if progress is not None and progress["numInputRows"] == 0 and progress["batchId"] > 0:
                return True  # state with a time to live has batches without data
            if not status["isDataAvailable"] and not status["isTriggerActive"] and progress is not None:
                self.query.processAllAvailable()
                return True
            time.sleep(0.05)
        return False

    @property
    def has_failed(self) -> bool:
        """Whether something ended the query; does not raise."""
        return self.query.exception() is not None or (self.monitor is not None and self.monitor.error is not None)

    def failed(self) -> None:
        """Raises what ended the query, if anything did."""
        if self.monitor is not None and self.monitor.error is not None:
            raise self.monitor.error
        error = self.query.exception()
        if error is not None:
            raise error

    def results(self) -> DataFrame:
        """All results so far, with the hidden order columns."""
        if self.folder is None:
            return self.spark.table(self.name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path) or not len(files.listStatus(path)):
            return self.spark.createDataFrame([], f"{self.shape}").withColumn("batch", F.lit(0))
        return self.spark.read.parquet(self.folder)

    def output_size(self) -> int:
        """Results so far."""
        return self.results().count()

    def _fetch(self) -> None:
        place = lambda r: tuple(r[o] for o in self.order)
        if self.folder is None:
            new = self.results().offset(self.fetched).collect()
            self.fetched += len(new)
            self.waiting = sorted(new, key=place)
            return
        new = self.results().where(F.col("batch") >= self.fetched)
        first = new.agg(F.min("batch")).first()[0]
        if first is not None:
            rows = new.where(F.col("batch") == first).drop("batch").collect()
            self.fetched, self.waiting = int(first) + 1, sorted(rows, key=place)

    def try_receive(self) -> Row | None:
        """The next result, or None if there is none yet; the cursor advances."""
        if not self.waiting:
            self._fetch()
        if not self.waiting:
            return None
        row = self.waiting.pop(0)
        return Row(**{k: v for k, v in row.asDict().items() if k not in self.order})

    def receive(self, timeout: float = 60.0) -> Row:
        """The next result, waited for; raises what ended the query, or on timeout."""
        end = time.monotonic() + timeout
        while (row := self.try_receive()) is None:
            self.failed()
            if time.monotonic() > end:
                raise TimeoutError("no result has arrived")
            time.sleep(0.05)
        return row

    def stop(self) -> None:
        """Ends the query; a new start with the same checkpoint goes on from here."""
        self.query.stop()
        if self.monitor is not None:
            self.spark.streams.removeListener(self.monitor)
