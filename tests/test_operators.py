"""Operators on small sequences with known results."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidefold.operators import Custom, DedupBy, Delta, Filter, FilterMap, FlatMap, Inspect, Latency, Latest, Map, Progress, Stateful, TrackPrev, compose
from tidefold.measure import OpCounter
from tidefold.plans import Fold
from tidefold.plans.pipeline import CapacityExceeded, Pipeline

PIPE = Pipeline(("seq",))


def add(n: int) -> Map:
    return Map(lambda r: {"x": r.x + n})


def times(n: int) -> Map:
    return Map(lambda r: {"x": r.x * n})


def values(pipeline: Pipeline, df) -> list:
    return [r.x for r in pipeline.receive(df)]


def test_map_filter_inspect(scalars) -> None:
    assert values(PIPE.stage(times(2)), scalars([21])) == [42]
    assert values(PIPE.stage(Filter(lambda r: r.x > 0)), scalars([10, -5])) == [10]
    seen = Observation("seen")
    out = PIPE.stage(Inspect({"n": F.count("x"), "top": F.max("x")}, seen)).run(scalars([42, 7]))
    assert sorted(r.x for r in out.collect()) == [7, 42]
    assert seen.get == {"n": 2, "top": 42}


def test_composition(scalars) -> None:
    assert values(PIPE.stage(add(1)).stage(times(2)), scalars([10, 20])) == [22, 42]
    assert values(PIPE.stage(compose(add(1), compose(times(2), add(1)))), scalars([10])) == [23]
    assert values(PIPE, scalars([42])) == [42]
    ten = PIPE
    for _ in range(10):
        ten = ten.stage(add(1))
    assert values(ten, scalars(list(range(500)))) == list(range(10, 510))


def test_filter_map_and_flat_map(scalars) -> None:
    even = FilterMap(lambda r: (r.x % 2 == 0, {"x": r.x}))
    assert values(PIPE.stage(even), scalars([1, 2, 3, 4])) == [2, 4]
    pair = FlatMap(lambda r: F.array(F.struct(r.x.alias("x")), F.struct((r.x + 1).alias("x"))))
    assert values(PIPE.stage(pair, add(0)), scalars([10, 5])) == [10, 11, 5, 6]
    assert values(PIPE.stage(pair, pair), scalars([1])) == [1, 2, 2, 3]
    assert values(PIPE.stage(Filter(lambda r: r.x > 10)).stage(times(2)), scalars([5, 15])) == [30]


def test_dedup_compares_records_not_keys(scalars) -> None:
    constant = PIPE.stage(Map(lambda r: {"k": F.lit(0), "x": r.x}), DedupBy(["k"], compare=["x"]))
    assert values(constant, scalars([10, 10, 20, 10])) == [10, 20, 10]


def test_dedup_keeps_nan_and_drops_null(spark) -> None:
    df = spark.createDataFrame([(0, 1, math.nan), (1, 1, math.nan), (2, 1, None), (3, 1, None), (4, 1, 0.0), (5, 1, -0.0)], "seq bigint, k int, v double")
    out = PIPE.stage(DedupBy(["k"], compare=["k", "v"])).run(df)
    assert sorted(r.seq for r in out.collect()) == [0, 1, 2, 4]


def test_delta_has_the_previous_record_of_the_key(spark) -> None:
    df = spark.createDataFrame([(0, 1, 10.0), (1, 2, 5.0), (2, 1, 17.0)], "seq bigint, id bigint, val double")
    jump = Delta(["id"], lambda c, p: (None, {"id": c.id, "x": F.when(p.exists & (c.val >= p.val + 5), 1).otherwise(0)}))
    assert values(PIPE.stage(jump), df) == [0, 0, 1]
    nulls = spark.createDataFrame([(0, 1, None), (1, 1, 2.0)], "seq bigint, id bigint, val double")
    seen = Delta(["id"], lambda c, p: (None, {"x": p.exists, "was": p.val}))
    assert values(PIPE.stage(seen), nulls) == [False, True]


def test_stateful_emits_the_running_state(spark) -> None:
    df = spark.createDataFrame([(0, 1, 10), (1, 2, 5), (2, 1, 20)], "seq bigint, id bigint, v bigint")
    assert values(PIPE.stage(Stateful(["id"], {"x": Fold.sum(lambda r: r.v, "bigint")})), df) == [10, 5, 30]
    assert values(PIPE.stage(Stateful(["id"], {"x": Fold.count()})), df) == [1, 1, 2]


def test_extremes_leave_nan_out(spark) -> None:
    df = spark.createDataFrame([(0, 1, math.nan), (1, 1, 2.0), (2, 1, math.nan)], "seq bigint, id bigint, v double")
    out = PIPE.stage(Stateful(["id"], {"x": Fold.max(lambda r: r.v), "low": Fold.min(lambda r: r.v)}))
    assert values(out, df) == [None, 2.0, 2.0]


def test_track_prev(spark, scalars) -> None:
    keyed = PIPE.stage(Map(lambda r: {"k": r.x % 2, "x": r.x}), TrackPrev(["k"]))
    got = [(r.prev.x if r.prev else None, r.curr.x, r.has_prev) for r in keyed.receive(scalars([2, 3, 4]))]
    assert got == [(None, 2, False), (None, 3, False), (2, 4, True)]
    n = 1000
    got = [(r.prev.x if r.prev else None, r.curr.x) for r in PIPE.stage(Map(lambda r: {"x": r.x}), TrackPrev()).receive(scalars(list(range(n))).repartition(7))]
    assert got == [(i - 1 if i else None, i) for i in range(n)]
    assert list(PIPE.stage(TrackPrev()).receive(scalars([]))) == []


def test_custom_stage_keeps_order_and_many_outputs(scalars) -> None:
    def count(state: dict, r: dict) -> list[dict]:
        state["n"] = state.get("n", 0) + 1
        return [{"k": r["k"], "x": state["n"]}] * (r["x"] % 3)

    stage = Custom(["k"], dict, count, "k bigint, x bigint")
    got = values(PIPE.stage(Map(lambda r: {"k": r.x % 2, "x": r.x}), stage), scalars([1, 2, 3, 4, 5]))
    assert got == [1, 1, 1, 2, 3, 3]


def test_observers_and_checks(scalars) -> None:
    n = Observation("n")
    assert PIPE.stage(Progress("p", 10, n)).run(scalars([1, 2])).count() == 2
    assert n.get == {"records": 2}
    timed = Observation("timed")
    PIPE.stage(Latency("l", add(1), lambda r: r.x, 1, timed)).run(scalars([1, 2])).collect()
    assert timed.get["count"] == 2 and timed.get["max"] == 10**12
    with pytest.raises(ValueError):
        Progress("p", 0)
    with pytest.raises(ValueError):
        Latency("l", add(1), lambda r: r.x, 0)
    with pytest.raises(CapacityExceeded):
        Pipeline(("seq",), max_rows=1).stage(add(1)).run(scalars([1, 2]))


def test_intermediates(scalars) -> None:
    frames = PIPE.stage(add(1)).stage(times(2)).intermediates(scalars([1]))
    assert [f.select("x").first().x for f in frames] == [1, 2, 4]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.none() | st.integers(-5, 5)), min_size=1, max_size=30))
def test_folds_against_plain_python(spark, records) -> None:
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(records)], "seq bigint, k int, v bigint")
    value = lambda r: r.v
    folds = {
        "total": Fold.sum(value, "bigint"), "late": Fold.sum_after_first(value, "bigint"), "low": Fold.min(value, "bigint"), "high": Fold.max(value, "bigint"),
        "first": Fold.first(value, "bigint"), "last": Fold.last(value, "bigint"), "clamped": Fold.clamped_sum(value), "n": Fold.count(),
    }
    states: dict = {}
    expected = []
    for k, v in records:
        old = states.setdefault(k, dict.fromkeys(folds))
        given_ = {"n": 1, "clamped": v or 0}
        states[k] = {n: f.step(old[n], given_.get(n, v)) for n, f in folds.items()}
        expected.append({n: None if states[k][n] is None else f.result(states[k][n]) for n, f in folds.items()})
    got = [{n: r[n] for n in folds} for r in PIPE.stage(Stateful(["k"], folds)).receive(df)]
    assert got == expected


def test_latest_is_one_record_a_key(scalars) -> None:
    final = Latest(["k"], lambda r: {"n": F.count(F.lit(1)), "x": F.max_by(r.x, r.x)})
    out = PIPE.stage(Map(lambda r: {"k": r.x % 2, "x": r.x}), final)
    assert [(r.k, r.n, r.x) for r in out.receive(scalars([4, 1, 3, 2, 5]))] == [(0, 2, 4), (1, 3, 5)]


def test_time_of_a_wrapped_stage(scalars) -> None:
    """Every second record is timed, and what is timed is the stage."""
    slow = Map(lambda r: {"x": F.length(F.repeat(F.sha2(r.x.cast("string"), 512), 2000))})
    stats = {}
    for name, inner in (("fast", add(1)), ("slow", slow), ("keyed", DedupBy(["x"]))):
        seen = Observation(name)
        df = scalars(list(range(300))).coalesce(1)
        assert len(PIPE.stage(Latency(name, inner, sample_rate=2, to=seen)).run(df).collect()) == 300
        stats[name] = seen.get
    for s in stats.values():
        assert (s["count"], s["records"]) == (150, 300) and 1 <= s["min"] <= s["p50"] <= s["p99"] <= s["max"], s


def test_schemas_with_commas(scalars) -> None:
    def step(state: dict, r: dict) -> list[dict]:
        return [{"d": Decimal(r["x"]) / 4, "s": {"a": r["x"], "b": [str(r["x"])]}}]

    out = PIPE.stage(Custom(["x"], dict, step, "d decimal(10, 2), s struct<a: bigint, b: array<string>>"))
    assert [(r.d, r.s.a, r.s.b) for r in out.receive(scalars([1, 2]))] == [(Decimal("0.25"), 1, ["1"]), (Decimal("0.50"), 2, ["2"])]


def test_counters_add_up() -> None:
    ops = OpCounter()
    first, second = ops.new_counter(), ops.new_counter()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: (first if i % 2 else second).add(i), range(100)))
    assert ops.total() == sum(range(100)) and first.value == sum(range(1, 100, 2))
