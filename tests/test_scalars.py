"""Conversions, formats and measurement."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import bucket, format_duration, format_number, micros, saturating_sub, saturating_unsigned, wrapping_u8
from tidefold.measure import QUANTILES, EndToEnd, LatencyMeasurer, latency_stats, outliers, progress_line


def test_conversions(spark) -> None:
    xs = [1.9, -1.5, math.nan, 1e30, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    assert [r.v for r in df.select(saturating_unsigned(F.col("x")).alias("v")).collect()] == [1, 0, 0, 2**63 - 1, 0]
    one = spark.range(1)
    r = one.select(wrapping_u8(F.lit(300)).alias("w"), saturating_sub(F.lit(3), F.lit(5)).alias("s"), bucket(F.lit(123_456), 100_000).alias("b")).first()
    assert (r.w, r.s, r.b) == (44, 0, 100_000)
    t = spark.createDataFrame([(datetime.datetime(1970, 1, 2, 0, 0, 0, 5),)], "t timestamp_ntz")
    assert t.select(micros(F.col("t")).alias("u")).first().u == 86_400_000_005


@pytest.mark.parametrize(("x", "text"), [(999, "999"), (12.345, "12.35"), (1500, "1.50k"), (2_500_000, "2.50m"), (3e9, "3.00b"), (4e12, "4.00t")])
def test_numbers(x, text) -> None:
    assert format_number(x) == text


@pytest.mark.parametrize(("ns", "text"), [(5, "5.0ns"), (1500, "1.5us"), (2.5e6, "2.5ms"), (3e9, "3.00s")])
def test_durations(ns, text) -> None:
    assert format_duration(ns) == text


def test_latency_stats_and_outliers(spark) -> None:
    df = spark.range(1, 1001).select(F.col("id").alias("ns"))
    stats = latency_stats(df, F.col("ns"))
    r = stats.first()
    assert (r["count"], r["min"], r["max"], r["p50"], r["p90"], r["p999"]) == (1000, 1, 1000, 500, 900, 999)
    assert [x.ns for x in outliers(df, F.col("ns"), stats).collect()] == [1000]
    few = df.limit(50)
    assert outliers(few, F.lit(10**9), latency_stats(few, F.col("ns"))).count() == 0
    sketch = latency_stats(df, F.col("ns"), accuracy=10000).first()
    assert abs(sketch.p50 - 500) <= 1


def test_measurer() -> None:
    m = LatencyMeasurer(sample_rate=2)
    assert m.format() == "No stats collected yet" and not m.is_outlier(10**12)
    for i in range(400):
        m.measure(i)
    assert m.stats()["count"] == 200 and m.is_outlier(10**6) and not m.is_outlier(1)
    m.reset()
    assert m.stats() == {}
    for _ in range(5):
        m.step()
    assert m.stats()["count"] == 2
    with m.scope():
        pass
    e = EndToEnd()
    assert e.measure(e.add_tracker()) >= 0
    with pytest.raises(ValueError):
        LatencyMeasurer(0)
    assert progress_line("x", 2000, 500, 0.5, 2.0) == "[x] 2.00k records, 1.00k/s now, 1.00k/s on average"


def test_exact_quantiles_of_uneven_durations(spark) -> None:
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-5, 70, 500), (10 ** rng.uniform(0, 13, 3000)).astype(np.int64), np.full(700, 123_456_789), 2 ** np.arange(41), 2 ** np.arange(1, 41) - 1])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "ns bigint")
    r = latency_stats(df, F.col("ns")).first()
    cut = np.sort(np.clip(values, 1, 10**12))
    expected = {n: cut[int(np.ceil(q * len(cut) - 1e-9)) - 1] for n, q in QUANTILES.items()}
    assert {n: r[n] for n in expected} == expected and (r["count"], r["min"], r["max"]) == (len(cut), cut[0], cut[-1])
    none = latency_stats(df.limit(0), F.col("ns")).first()
    assert none["count"] == 0 and none["p50"] is None
