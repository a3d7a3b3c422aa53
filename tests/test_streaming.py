"""Batch and stream give the same records, however the stream is cut into batches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidefold.operators import Custom, DedupBy, Delta, FlatMap, Latency, Map, Progress, Stateful, TrackPrev
from tidefold.plans import Fold
from tidefold.plans.pipeline import CapacityExceeded, Pipeline
from tidefold.sources import Feed, stream
from tidefold.workloads import orderbook, sensor

SCHEMA = "seq bigint, k bigint, v double"
ROWS = [(i, i % 3, float((i * 7) % 5)) for i in range(24)]
PIPE = Pipeline(("seq",))


def halving() -> Custom:
    def step(state: dict, r: dict) -> list[dict]:
        state["s"] = state.get("s", 0.0) / 2 + r["v"]
        return [{"k": r["k"], "s": state["s"]}]

    return Custom(["k"], dict, step, "k bigint, s double")


PIPELINES = {
    "dedup": PIPE.stage(DedupBy(["k"], compare=["k", "v"])),
    "delta": PIPE.stage(Delta(["k"], lambda c, p: (p.exists, {"k": c.k, "d": c.v - p.v}))),
    "first": PIPE.stage(Delta(["k"], lambda c, p: (~p.exists, {"k": c.k}))),
    "track": PIPE.stage(TrackPrev(["k"])),
    "track_all": PIPE.stage(TrackPrev()),
    "folds": PIPE.stage(Stateful(["k"], {"n": Fold.count(), "low": Fold.min(lambda r: r.v), "mean": Fold.mean(lambda r: r.v), "c": Fold.clamped_sum(lambda r: (r.v - 2).cast("bigint"))})),
    "custom": PIPE.stage(halving()),
    "chain": PIPE.stage(Stateful(["k"], {"s": Fold.sum(lambda r: r.v)}), Delta(["k"], lambda c, p: (p.exists & (c.s > p.s), {"k": c.k, "s": c.s}))),
    "flat": PIPE.stage(FlatMap(lambda r: F.array(F.struct(r.k.alias("k"), r.v.alias("v")), F.struct(r.k.alias("k"), (r.v + 1).alias("v")))), Delta(["k"], lambda c, p: (p.exists, {"k": c.k, "d": c.v - p.v}))),
}


def run_stream(spark, tmp_path, pipeline: Pipeline, cuts: list[int], schema: str = SCHEMA, rows: list = ROWS) -> list:
    source = str(tmp_path / "in")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    shape = spark.createDataFrame([], schema).schema
    df = stream(spark, f"{source}/*", shape)
    name = f"t{abs(hash(str(tmp_path)))}"
    run = pipeline.start(df, name, str(tmp_path / "checkpoint"))
    assert run.await_idle(120)
    run.failed()
    n = run.output_size()
    out = spark.table(name).orderBy(*run.order).drop(*run.order).collect()
    if n:
        assert run.try_receive() is not None
    run.stop()
    assert n == len(out)
    return out


def key(row) -> str:
    return str(row.asDict(recursive=True))


@pytest.mark.parametrize("name", list(PIPELINES))
def test_parity(spark, tmp_path, name) -> None:
    pipeline = PIPELINES[name]
    expected = [key(r) for r in pipeline.receive(spark.createDataFrame(ROWS, SCHEMA))]
    got = [key(r) for r in run_stream(spark, tmp_path, pipeline, [5, 6, 17])]
    assert sorted(got) == sorted(expected)


def test_sensor_parity(spark, tmp_path) -> None:
    rows = [(i, 1 + i % 2, float(i % 7), (i * 9000) % 250_000) for i in range(40)]
    schema = "seq bigint, sensor_id bigint, value double, timestamp bigint"
    pipeline = sensor.pipeline(("seq",))
    expected = sorted(key(r) for r in pipeline.receive(spark.createDataFrame(rows, schema)))
    assert sorted(key(r) for r in run_stream(spark, tmp_path, pipeline, [13, 20], schema, rows)) == expected


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path) -> None:
    source, shape = str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema
    pipeline = PIPE.stage(Stateful(["k"], {"n": Fold.count()}))
    found = []
    for part in (ROWS[:10], ROWS[10:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = pipeline.stream(stream(spark, source, shape))
        query = out.writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    expected = list(pipeline.receive(spark.createDataFrame(ROWS, SCHEMA)))
    assert sorted(map(key, found)) == sorted(map(key, expected))


def test_feed_and_cursor(spark, tmp_path) -> None:
    feed = Feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema)
    feed.send((0, 1, 2.0))
    counting = PIPE.stage(Stateful(["k"], {"n": Fold.count()}))
    run = counting.start(feed.stream(), "fed", str(tmp_path / "cp"))
    assert run.await_idle(120) and run.try_receive().n == 1 and run.try_receive() is None
    feed.send((1, 1, 3.0), (2, 2, 1.0))
    run.query.processAllAvailable()
    assert [run.try_receive().n for _ in range(2)] == [2, 1] and run.output_size() == 3
    run.stop()


def test_idle_state_can_be_dropped(spark, tmp_path) -> None:
    feed = Feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema)
    feed.send((0, 1, 2.0))
    run = PIPE.stage(Stateful(["k"], {"n": Fold.count()}, ttl_ms=3_600_000)).start(feed.stream(), "dropped", str(tmp_path / "cp"))
    assert run.await_idle(120) and run.output_size() == 1
    run.stop()


NULLS = [(i, i % 3, None if i % 4 == 1 or i < 3 else float((i * 5) % 7 - 2)) for i in range(30)]


def test_nulls_are_left_out_in_streams_as_in_batch(spark, tmp_path) -> None:
    v = lambda r: r.v
    folds = {
        "n": Fold.count(), "s": Fold.sum(v), "t": Fold.sum_after_first(v), "m": Fold.mean(v), "low": Fold.min(v), "high": Fold.max(v),
        "c": Fold.clamped_sum(lambda r: r.v.cast("bigint")), "first": Fold.first(v, "double"), "last": Fold.last(v, "double"),
    }
    pipeline = PIPE.stage(Stateful(["k"], folds))
    expected = sorted(key(r) for r in pipeline.receive(spark.createDataFrame(NULLS, SCHEMA)))
    assert sorted(key(r) for r in run_stream(spark, tmp_path, pipeline, [4, 5, 19], SCHEMA, NULLS)) == expected


def test_a_late_record_is_received_once_when_it_comes(spark, tmp_path) -> None:
    feed = Feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema)
    feed.send((0, 1, 1.0), (5, 1, 2.0))
    run = PIPE.stage(Map(lambda r: {"k": r.k, "v": r.v})).start(feed.stream(), "late", str(tmp_path / "cp"))
    assert run.await_idle(120) and [run.receive().v for _ in range(2)] == [1.0, 2.0] and run.try_receive() is None
    feed.send((3, 1, 9.0))
    run.query.processAllAvailable()
    assert run.try_receive().v == 9.0 and run.try_receive() is None and run.output_size() == 3
    run.stop()


def test_results_in_a_folder_go_on_after_a_restart(spark, tmp_path) -> None:
    feed = Feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema)
    counting, seen = PIPE.stage(Stateful(["k"], {"n": Fold.count()})), []
    for part, rows in enumerate(([(0, 1, 2.0), (1, 1, 2.0)], [(2, 1, 3.0), (3, 2, 1.0)])):
        run = counting.start(feed.stream(), f"folder{part}", str(tmp_path / "cp"), folder=str(tmp_path / "out"))
        assert run.output_size() == 2 * part
        feed.send(*rows)
        run.query.processAllAvailable()
        if part:
            while (row := run.try_receive()) is not None:
                seen.append((row.k, row.n))
            assert run.output_size() == 4 and not run.has_failed
        run.stop()
    assert seen == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_capacities(spark, tmp_path) -> None:
    shape = spark.createDataFrame([], SCHEMA).schema
    small = Feed(spark, str(tmp_path / "small"), shape, size=1)
    small.send((0, 1, 2.0))
    for feed in (small, Feed(spark, str(tmp_path / "small"), shape, size=1)):
        with pytest.raises(CapacityExceeded, match="Store is full"):
            feed.send((1, 1, 2.0))
    twice = FlatMap(lambda r: F.array(F.struct(r.k.alias("k")), F.struct(r.k.alias("k"))))
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert PIPE.stage(twice, capacity=48).run(df).count() == 48
    for full in (PIPE.stage(twice, capacity=47), Pipeline(("seq",), max_rows=23).stage(twice)):
        with pytest.raises(CapacityExceeded):
            full.run(df)
        feed = Feed(spark, str(tmp_path / f"feed{full.max_rows}"), shape)
        run = full.start(feed.stream(), f"full{full.max_rows}", str(tmp_path / f"cp{full.max_rows}"))
        feed.send(*ROWS)
        run.query.awaitTermination(60)
        assert run.has_failed
        with pytest.raises(CapacityExceeded):
            run.failed()
        run.stop()


def test_progress_and_latency_reports_of_a_stream(spark, tmp_path) -> None:
    lines: list[str] = []
    feed = Feed(spark, str(tmp_path / "feed"), spark.createDataFrame([], SCHEMA).schema)
    timed = Latency("timed", Map(lambda r: {"k": r.k, "v": r.v + 1}), interval=10, log=lines.append)
    run = PIPE.stage(Progress("seen", 10, log=lines.append), timed).start(feed.stream(), "reported", str(tmp_path / "cp"))
    for part in (ROWS[:4], ROWS[4:14], ROWS[14:]):
        feed.send(*part)
        run.query.processAllAvailable()
    end = time.monotonic() + 30
    while len(lines) < 4 and time.monotonic() < end:
        time.sleep(0.1)
    run.stop()
    assert [x.split(",")[0] for x in lines if x.startswith("[seen]")] == ["[seen] 14 records", "[seen] 24 records"]
    assert sum(x.startswith("[timed] count=10 min=") and "p999=" in x for x in lines) == 2
    assert run.monitor.ops.total() == 48


def test_book_in_a_stream(spark, tmp_path) -> None:
    rng = random.Random(3)
    rows = [(i, i, i, rng.randint(1, 9), rng.randint(100, 104), rng.randint(1, 9), rng.randint(1, 2), rng.choice("AAAMMCFFTNR"), rng.choice("AB")) for i in range(120)]
    schema = "seq bigint, ts bigint, ts_recv bigint, order_id bigint, price bigint, size bigint, instrument_id bigint, action string, side string"
    pipeline = Pipeline(("seq",)).stage(orderbook.order_tracker()).stage(*orderbook.levels())
    expected = sorted(key(r) for r in pipeline.receive(spark.createDataFrame(rows, schema)))
    assert sorted(key(r) for r in run_stream(spark, tmp_path, pipeline, [30, 77], schema, rows)) == expected
