"""Latency and throughput: statistics over columns, and timers on the driver."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.format import format_duration, format_number
from tidefold.operators.ops import QUANTILES

LOW, HIGH = 1, 10**12
#: Fewer durations than this tell no outlier.
LEAST = 100


def latency_stats(df: DataFrame, ns: Column, accuracy: int | None = None) -> DataFrame:
    """count, min, max, mean and quantiles of durations, cut to 1 ns .. 1000 s.

    With ``accuracy``, quantiles come from a sketch with a rank error of its
    inverse. Otherwise they are exact, in two passes: a histogram of some 2,500 bins tells
    the bins that the quantiles lie in, and the durations in those are counted.
    """
    cut = F.when(ns.isNotNull(), F.least(F.greatest(ns, F.lit(LOW)), F.lit(HIGH))).cast("long")
    rows = df.select(cut.alias("v"))
    out = [F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")]
    if accuracy:
        return rows.agg(*out, *[F.percentile_approx("v", q, accuracy).alias(n) for n, q in QUANTILES.items()])
    return rows.agg(*out).join(_quantiles(rows), F.lit(True), "left")


def _quantiles(rows: DataFrame) -> DataFrame:
    """One row of the exact quantiles of ``v``: the least value that so large a share is up to."""
    # a bin is an octave's 64th, so bins are in order and few
    octave = F.length(F.bin("v")) - 1
    inside = F.expr("shiftright(v, length(bin(v)) - 7) & 63").cast("int")
    binned = rows.where("v is not null").withColumn("_bin", F.when(octave < 6, F.col("v").cast("int")).otherwise(octave * 64 + inside))
    sizes = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("_bin", "_n", upto.alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = lambda q: F.greatest(F.ceil(F.col("_all") * q - 1e-9), F.lit(1))
    holds = lambda q: (F.col("_upto") >= rank(q)) & (F.col("_upto") - F.col("_n") < rank(q))
    picked = sizes.where(reduce(or_, [holds(q) for q in QUANTILES.values()])).select("_bin", (F.col("_upto") - F.col("_n")).alias("_below"), "_all")
    counted = binned.join(F.broadcast(picked), "_bin").groupBy("_bin", "_below", "_all", "v").agg(F.count(F.lit(1)).alias("_n"))
    place = F.col("_below") + F.sum("_n").over(Window.partitionBy("_bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", place)
    return ranked.agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col("v"))).alias(n) for n, q in QUANTILES.items()])


def outliers(df: DataFrame, ns: Column, stats: DataFrame) -> DataFrame:
    """Rows whose duration is over p99.9; none if there are fewer than 100."""
    one = stats.select(F.col("count").alias("_n"), F.col("p999").alias("_p"))
    return df.join(F.broadcast(one), (F.col("_n") >= LEAST) & (ns > F.col("_p"))).drop("_n", "_p")


@dataclass
class LatencyMeasurer:
    """Durations of every ``sample_rate``-th step on the driver, in nanoseconds."""

    sample_rate: int = 1
    durations: list[int] = field(default_factory=list)
    count: int = 0
    _last: int | None = None

    def __post_init__(self) -> None:
        if self.sample_rate <= 0:
            raise ValueError("sample_rate must be positive")

    def _sampled(self) -> bool:
        self.count += 1
        return self.count % self.sample_rate == 0

    def measure(self, ns: int) -> None:
        """Counts a duration, if it is its turn."""
        if self._sampled():
            self.durations.append(min(max(int(ns), LOW), HIGH))

    @contextmanager
    def scope(self) -> Iterator[None]:
        """Times a block."""
        begin = time.perf_counter_ns()
        try:
            yield
        finally:
            self.measure(time.perf_counter_ns() - begin)

    def step(self) -> None:
        """Times from the previous step to this one."""
        now = time.perf_counter_ns()
        if self._last is not None:
            self.measure(now - self._last)
        self._last = now

    def reset(self) -> None:
        """Forgets all durations."""
        self.durations.clear()
        self.count, self._last = 0, None

    def stats(self) -> dict[str, float]:
        """The statistics of ``latency_stats``; empty without durations."""
        d = sorted(self.durations)
        if not d:
            return {}
        at = lambda q: d[max(0, math.ceil(q * len(d) - 1e-9) - 1)]
        return {"count": len(d), "min": d[0], "max": d[-1], "mean": sum(d) / len(d)} | {n: at(q) for n, q in QUANTILES.items()}

    def is_outlier(self, ns: int) -> bool:
        """Whether a duration is over p99.9; False before 100 durations."""
        return len(self.durations) >= LEAST and ns > self.stats()["p999"]

    def format(self) -> str:
        """The statistics as one line."""
        s = self.stats()
        if not s:
            return "No stats collected yet"
        return f"count={s['count']} " + " ".join(f"{k}={format_duration(v)}" for k, v in s.items() if k != "count")


class OpCounter:
    """Counters of several parts of a program on the driver, and their sum."""

    def __init__(self) -> None:
        self._counters: list[Counter] = []

    def new_counter(self) -> Counter:
        """A counter of its own, from 0, that the sum includes."""
        self._counters.append(Counter())
        return self._counters[-1]

    def total(self) -> int:
        """The sum of all counters."""
        return sum(c.value for c in self._counters)


class Counter:
    """A number that goes up; threads may share it."""

    def __init__(self) -> None:
        self.value = 0
        self._lock = threading.Lock()

    def add(self, n: int = 1) -> int:
        """The number after ``n`` more."""
        with self._lock:
            self.value += n
            return self.value


class EndToEnd:
    """Tokens of the time something came in, measured where it comes out."""

    def __init__(self) -> None:
        self._start = time.perf_counter_ns()
        self.measurer = LatencyMeasurer()

    def add_tracker(self) -> int:
        """A token: nanoseconds since this object was made."""
        return time.perf_counter_ns() - self._start

    def measure(self, token: int) -> int:
        """The delay since the token."""
        delay = time.perf_counter_ns() - self._start - token
        self.measurer.measure(delay)
        return delay


def progress_line(name: str, total: int, recent: int, seconds: float, elapsed: float) -> str:
    """A line of progress: how many, how fast now and on average."""
    now, mean = recent / max(seconds, 1e-9), total / max(elapsed, 1e-9)
    return f"[{name}] {format_number(total)} records, {format_number(now)}/s now, {format_number(mean)}/s on average"
