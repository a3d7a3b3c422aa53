"""Golden traces of the workloads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Observation

from tidefold.plans.pipeline import Pipeline
from tidefold.workloads import health, orderbook, sensor

CYCLE = [(10.0, 10_000), (12.0, 20_000), (20.0, 110_000), (22.0, 120_000)]


def readings(spark, n: int, id_col: str):
    rows = [(i, 1, *CYCLE[i % 4]) for i in range(4 * n)]
    return spark.createDataFrame(rows, f"seq bigint, {id_col} bigint, value double, timestamp bigint")


def test_sensor_alerts(spark) -> None:
    df = readings(spark, 2, "sensor_id")
    got = [r.bucket for r in sensor.pipeline(("seq",)).receive(df)]
    assert got == [0, 100_000, 100_000]
    assert [r.bucket for r in sensor.pipeline(("seq",), true_mean=True).receive(df)] == [100_000, 100_000]


def test_sensor_alerts_of_a_thousand_cycles(spark) -> None:
    df = readings(spark, 1000, "sensor_id")
    assert sensor.pipeline(("seq",)).run(df).count() == 1001
    assert sensor.pipeline(("seq",), true_mean=True).run(df).count() == 1000


def test_health_alerts(spark) -> None:
    rows = [(0, 2, 10.0, 0), (1, 2, 100.0, 1)] + [(i + 2, 1, 10.0, i) for i in range(300_000)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=["seq", "service_id", "value", "timestamp"]))
    got = {(r.service_id, r.bucket) for r in health.pipeline(("seq",)).run(df).collect()}
    assert got == {(2, 0), (1, 0), (1, 100_000), (1, 200_000)}


MESSAGES = [
    ("A", 1, 100, 10, "B"), ("A", 2, 105, 20, "A"), ("A", 3, 101, 5, "B"), ("F", 1, 100, 4, "B"), ("M", 3, 102, 7, "B"), ("M", 9, 99, 3, "B"),
    ("M", 2, 105, 15, "A"), ("C", 1, 100, 6, "B"), ("C", 77, 105, 99, "A"), ("N", 5, 1, 1, "B"), ("R", 0, 0, 0, "B"), ("A", 10, 200, 8, "A"),
]


def messages(spark):
    rows = [(i, i, i, o, p, s, 1, a, side) for i, (a, o, p, s, side) in enumerate(MESSAGES)]
    return spark.createDataFrame(rows, "seq bigint, ts bigint, ts_recv bigint, order_id bigint, price bigint, size bigint, instrument_id bigint, action string, side string")


def test_book_deltas(spark) -> None:
    got = [(r.price, r.delta, r.side) for r in Pipeline(("seq",)).stage(orderbook.order_tracker()).receive(messages(spark))]
    assert got == [
        (100, 10, "B"), (105, 20, "A"), (101, 5, "B"), (100, -4, "B"), (101, -5, "B"), (102, 7, "B"), (99, 3, "B"),
        (105, -5, "A"), (100, -6, "B"), (105, -99, "A"), (0, 0, None), (200, 8, "A"),
    ]


def test_book_levels(spark) -> None:
    pipe = Pipeline(("seq",)).stage(orderbook.order_tracker()).stage(*orderbook.levels())
    got = [(r.side, r.price, r.volume) for r in pipe.receive(messages(spark))]
    assert got == [
        ("B", 100, 10), ("A", 105, 20), ("B", 101, 5), ("B", 100, 6), ("B", 101, 0), ("B", 102, 7), ("B", 99, 3),
        ("A", 105, 15), ("B", 100, 0), ("A", 105, 0), ("B", 0, 0), ("A", 0, 0), ("A", 200, 8),
    ]


def test_imbalance(spark) -> None:
    got = [(r.imbalance, r.bid_vol, r.ask_vol) for r in orderbook.pipeline(("seq",)).receive(messages(spark))]
    expected = [
        (1.0, 10, 0), (-0.3333, 10, 20), (-0.2121, 13, 20), (-0.3423, 9.8, 20), (-0.5385, 6, 20), (-0.2579, 11.8, 20), (-0.1905, 13.6, 20),
        (-0.049, 13.6, 15), (-0.2295, 9.4, 15), (1.0, 9.4, 0), (1.0, 9.4, 0), (1.0, 9.4, 0), (0.0805, 9.4, 8),
    ]
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=5e-5)


def test_a_level_pushed_out_comes_back_with_its_next_update() -> None:
    book = orderbook.new_book()
    for price in (101, 102, 103, 104, 105, 106):
        orderbook.put(book, "B", price, 1)
    assert [p for p, _ in book["B"]] == [106, 105, 104, 103, 102]
    orderbook.put(book, "B", 106, 0)
    assert [p for p, _ in book["B"]] == [105, 104, 103, 102, 0]
    orderbook.put(book, "B", 101, 4)
    assert [p for p, _ in book["B"]] == [105, 104, 103, 102, 101]


def test_tracker_windows_equal_the_state_by_messages(spark) -> None:
    rng = random.Random(5)
    rows = [(i, i, i, 10 * (k := rng.randint(1, 3)) + rng.randint(1, 6), rng.randint(100, 103), rng.randint(0, 6), k, rng.choice("AAMMMCFFFTTNR" if i % 50 else "R"), rng.choice("AB")) for i in range(1500)]
    df = spark.createDataFrame(rows, messages(spark).schema)
    state: dict = {}
    expected = []
    for r in rows:
        m = dict(zip(df.columns, r, strict=True))
        for pos, out in enumerate(orderbook._track(state.setdefault(m["instrument_id"], {}), m)):
            expected.append((m["seq"], pos, out["instrument_id"], out["side"], out["price"], out["delta"], out["is_clear"]))
    got = Pipeline(("seq",)).stage(orderbook.order_tracker()).run(df, keep_order=True).collect()
    assert sorted((r._o0, r._o1, r.instrument_id, r.side, r.price, r.delta, r.is_clear) for r in got if r.side) == [e for e in expected if e[3]]
    assert len(got) == len(expected) and sum(r.is_clear for r in got) == sum(e[6] for e in expected)


def test_a_clear_can_empty_the_book(spark) -> None:
    got = [(r.imbalance, r.bid_vol, r.ask_vol) for r in orderbook.pipeline(("seq",), reset_on_clear=True).receive(messages(spark))]
    assert got[-1] == (-1.0, 0.0, 8.0) and len(got) == 11  # no signals of an empty book


def test_small_readings_raise_alerts_as_large_ones_do(spark) -> None:
    rows = [(i, 1, v, t) for i, (v, t) in enumerate([(1e-7, 10_000), (5e-7, 20_000), (9e-7, 110_000), (2e-6, 120_000)])]
    alerts = []
    for scale in (1.0, 1e7):
        df = spark.createDataFrame([(i, k, v * scale, t) for i, k, v, t in rows], "seq bigint, sensor_id bigint, value double, timestamp bigint")
        alerts.append([r.bucket for r in sensor.pipeline(("seq",)).receive(df)])
    assert alerts[0] == alerts[1] == [0, 100_000]


def test_throttled_log_and_tick_to_signal(spark) -> None:
    lines: list[str] = []
    log = orderbook.ThrottledLog(seconds=1000, log=lines.append)
    signals = orderbook.pipeline(("seq",)).run(messages(spark))
    for k in range(3):
        log.batch(signals, k)
    assert len(lines) == 1 and "High Imbalance: 1.0000 (B:9 A:0)" in lines[0]
    seen = Observation("tts")
    n = orderbook.tick_to_signal(("seq",), every=1, to=seen).run(messages(spark)).count()
    assert n == 13 and seen.get["count"] == 13 and seen.get["min"] >= 1
