"""Journals, cursors, windows, slots and stores."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidefold.operators import Delta, Map, Stateful
from tidefold.plans import Fold
from tidefold.plans.pipeline import CapacityExceeded, Pipeline
from tidefold.sources import Feed, Journal, JournalStore, Slots


def journal(spark, values: list) -> Journal:
    return Journal(spark.createDataFrame(list(enumerate(values)), "seq bigint, x bigint"))


def test_empty(spark) -> None:
    j = journal(spark, [])
    assert j.get_at(0).collect() == j.get_last().collect() == j.get_window(0, 1).collect() == []
    r = j.reader()
    assert r.get() is None and not r.next() and r.get_index() == 0 and j.size() == 0


def test_cursor(spark) -> None:
    r = journal(spark, [42]).reader()
    assert r.get() is None
    assert r.next() and r.get().x == 42
    assert not r.next() and r.get().x == 42 and r.get_index() == 1
    assert r.with_current(lambda row: row.x + 1) == 43


def test_random_access_and_windows(spark) -> None:
    j = journal(spark, [10, 20, 30])
    assert [[x.x for x in j.get_at(i).collect()] for i in range(4)] == [[10], [20], [30], []]
    assert j.get_last().first().x == 30
    assert sorted(x.x for x in j.get_window(0, 3).collect()) == [10, 20, 30]
    assert j.get_window(1, 3).collect() == []


def test_readers_are_independent(spark) -> None:
    j = journal(spark, list(range(1500)))
    assert all([row.x for row in j.reader()] == list(range(1500)) for _ in range(2))


def test_backlog(spark) -> None:
    j, seen = journal(spark, [1, 2, 3]), []
    r = j.reader()
    r.next()
    assert r.handle_remaining(lambda df: seen.extend(sorted(x.x for x in df.collect()))) == 2
    assert seen == [2, 3] and r.handle_remaining(lambda df: seen.append(None)) == 0 and r.get_index() == 3


def test_sliding_windows_cross_blocks(spark) -> None:
    got = journal(spark, list(range(30))).sliding(4, F.col("x"), "total", block=5)
    assert {r.seq: r.total for r in got.collect()} == {i: 4 * i + 6 for i in range(27)}


def test_latest_by_slot(spark) -> None:
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "seq bigint, slot string, x int")
    assert {r.slot: r.x for r in Journal(df).latest("slot").collect()} == {"a": 3, "b": 2}


@pytest.mark.parametrize("stored", [False, True])
def test_store(spark, tmp_path, stored) -> None:
    path = str(tmp_path / "log") if stored else None
    store = JournalStore(spark, "x bigint", path, size=5)
    assert store.journal().size() == 0
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "x bigint")
    assert store.append(rows([3, 1, 2]), ["x"]) == 3
    assert store.append(rows([5, 4]), ["x"]) == 5
    assert [r.x for r in store.journal().reader()] == [1, 2, 3, 4, 5]
    with pytest.raises(CapacityExceeded, match="Store is full"):
        store.append(rows([6]), ["x"])
    if stored:
        assert JournalStore(spark, "x bigint", path).journal().size() == 5


def test_writers_at_once_leave_no_gap(spark, tmp_path) -> None:
    path = str(tmp_path / "log")
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "x bigint")
    parts = [rows(range(10 * i, 10 * i + 3 + i)) for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda p: JournalStore(spark, "x bigint", path).append(p, ["x"]), parts))
    found = JournalStore(spark, "x bigint", path).journal().df.orderBy("seq").collect()
    assert [r.seq for r in found] == list(range(18)) and sorted(r.x for r in found) == sorted(x for i in range(4) for x in range(10 * i, 3 + 11 * i))
    assert JournalStore(spark, "x bigint", path).count() == 18


def test_appends_do_not_read_what_is_there(spark) -> None:
    store = JournalStore(spark, "x bigint")
    for i in range(5):
        assert store.append(spark.createDataFrame([(i,)], "x bigint"), ["x"]) == i + 1
    assert store.count() == 5 and [r.x for r in store.journal().reader()] == list(range(5))
    assert store.append(spark.createDataFrame([], "x bigint"), ["x"]) == 5


def test_slots_that_are_set(spark) -> None:
    slots = Slots(spark, "price double, name string")
    slots.set(3, 1.5, "a")
    slots.set_all([(4, 2.0, "b"), (3, 9.0, "c"), (4, 3.0, "d")])
    assert {r.slot: (r.price, r.name) for r in slots.latest().collect()} == {3: (9.0, "c"), 4: (3.0, "d")}


def test_many_consumers_of_one_source(spark) -> None:
    """A graph built by hand: two pipelines read one journal, a third joins what they make."""
    j = journal(spark, list(range(200)))
    first = Pipeline(("seq",)).stage(Map(lambda r: {"x": r.x, "even": r.x % 2 == 0}))
    source, made = first.intermediates(j.df)
    sums = Pipeline(("x",)).stage(Stateful(["even"], {"x": Fold.last(lambda r: r.x, "bigint"), "s": Fold.sum(lambda r: r.x, "bigint")})).run(made)
    last = Pipeline(("x",)).stage(Delta(["even"], lambda c, p: (p.exists, {"x": c.x, "d": c.x - p.x}))).run(made)
    both = sums.join(last, "x").orderBy("x").collect()
    assert source.count() == 200 and len(both) == 198 and all(r.d == 2 and r.s == sum(range(r.x % 2, r.x + 1, 2)) for r in both)
    assert [row.x for row in j.reader()] == list(range(200))


def test_replay_keeps_the_distances_of_a_recording(spark, tmp_path) -> None:
    df = spark.createDataFrame([(i, int(t * 1e9)) for i, t in enumerate((0.0, 0.01, 0.35, 0.8, 7.0))], "seq bigint, ts bigint")
    feed, waits = Feed(spark, str(tmp_path / "feed"), df.schema), []
    assert feed.replay(df, "ts", 0.1, pause=waits.append) == 4  # spans at 0, 0.3, 0.8 and, after a gap, 7
    assert all(0 <= w <= 0.8 for w in waits) and len(waits) <= 2
    assert spark.read.parquet(feed.path).count() == 5
