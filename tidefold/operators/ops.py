"""Operators as immutable specifications.

Records are rows; their order is held in hidden columns that every operator
carries on. An operator states its logic over columns, so that Catalyst sees
through it, and is lowered twice: ``batch`` to windows, ``stream`` to keyed state.
With ``ttl_ms`` a stream drops the state of a key that has been idle for so long;
without, state is kept for ever, as in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidefold.functions.scalars import same_record
from tidefold.plans.fold import PLACE, Fold, ordered, running

PREV = "_prev"
#: The quantiles of durations by name.
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


class Record:
    """Columns of a record by attribute; remembers which were asked for."""

    def __init__(self, prefix: str = "") -> None:
        self._prefix = prefix
        self._seen: list[str] = []

    def __getattr__(self, name: str) -> Column:
        if name not in self._seen:
            self._seen.append(name)
        return F.col(f"{self._prefix}{name}")

    def __getitem__(self, name: str) -> Column:
        return getattr(self, name)

    @property
    def exists(self) -> Column:
        """Whether there is such a record (for a previous one)."""
        return F.col(self._prefix.rstrip(".")).isNotNull()


class Operator:
    """What a pipeline is made of. ``order`` names the hidden order columns."""

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        """The operator on a bounded frame, and the order columns after it."""
        raise NotImplementedError

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        """The operator on a stream; the same as in batch where it keeps no state."""
        return self.batch(df, order)

    def keys(self) -> list[str] | None:
        """Key columns that records must be brought together by; None if it has none."""
        return None

    def reporters(self) -> list[Progress | Latency]:
        """The operators that report on a stream."""
        if isinstance(self, Latency):
            return [self, *self.inner.reporters()]
        return [self] if isinstance(self, Progress) else []


def data_columns(df: DataFrame, order: list[str]) -> list[str]:
    """The columns that are not hidden."""
    return [c for c in df.columns if c not in order]


def _shaped(out: dict[str, Column], order: list[str]) -> list[Column]:
    return [c.alias(n) for n, c in out.items()] + [F.col(o) for o in order]


@dataclass(frozen=True)
class Map(Operator):
    """One output a record: ``fn(record)`` returns name -> column."""

    fn: Callable[[Record], dict[str, Column]]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return df.select(*_shaped(self.fn(Record()), order)), order


@dataclass(frozen=True)
class Filter(Operator):
    """Records for which the predicate is true."""

    fn: Callable[[Record], Column]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return df.where(self.fn(Record())), order


@dataclass(frozen=True)
class FilterMap(Operator):
    """``fn`` returns (condition, columns); records without the condition go."""

    fn: Callable[[Record], tuple[Column, dict[str, Column]]]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        when, out = self.fn(Record())
        return df.where(when).select(*_shaped(out, order)), order


@dataclass(frozen=True)
class FlatMap(Operator):
    """``fn`` returns an array of structs; each is an output, in the array's order."""

    fn: Callable[[Record], Column]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        pos = f"_o{len(order)}"
        hidden = [F.col(o) for o in order]
        return df.select(*hidden, F.posexplode(self.fn(Record())).alias(pos, "_out")).select("_out.*", *order, pos), [*order, pos]


@dataclass(frozen=True)
class Inspect(Operator):
    """Records pass unchanged; aggregates of them are observed on the way.

    ``metrics`` maps names to aggregate columns. Given a name, the metrics of a
    stream appear in its progress; given an ``Observation``, those of a batch
    can be read from it.
    """

    metrics: dict[str, Column]
    to: Observation | str = "inspect"

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return df.observe(self.to, *[c.alias(n) for n, c in self.metrics.items()]), order


def _with_prev(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    held = F.struct(*fields) if fields else F.struct(F.lit(True).alias("_"))
    return df.withColumn(PREV, F.lag(held).over(ordered(keys, order)))


def _stream_prev(ttl_ms: int | None) -> Callable[[DataFrame, list[str], list[str], list[str]], DataFrame]:
    from tidefold.streaming.state import with_previous

    return lambda df, keys, order, fields: with_previous(df, keys, order, fields, PREV, ttl_ms)


@dataclass(frozen=True)
class DedupBy(Operator):
    """Drops a record that equals the previous one of its key in every data column.

    The key's last kept record equals its last seen one, as equality carries on,
    so a lag is exact. Floating NaN equals nothing; records with one stay.
    """

    key: list[str]
    compare: list[str] | None = None
    ttl_ms: int | None = None

    def keys(self) -> list[str]:
        return self.key

    def _apply(self, df: DataFrame, order: list[str], prev: Callable) -> tuple[DataFrame, list[str]]:
        names = data_columns(df, order)
        fields = self.compare or names
        schema = StructType([df.schema[n] for n in fields])
        out = prev(df, self.key, order, fields)
        same = same_record([F.col(n) for n in fields], [F.col(f"{PREV}.{n}") for n in fields], schema)
        return out.where(F.col(PREV).isNull() | ~same).select(*names, *order), order

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return self._apply(df, order, _with_prev)

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return self._apply(df, order, _stream_prev(self.ttl_ms))


@dataclass(frozen=True)
class Delta(Operator):
    """``fn(current, previous)`` returns (condition, columns); null condition: no output.

    ``previous.exists`` tells a key's first record. Only the previous columns that
    the logic reads are carried.
    """

    key: list[str]
    fn: Callable[[Record, Record], tuple[Column | None, dict[str, Column]]]
    ttl_ms: int | None = None

    def keys(self) -> list[str]:
        return self.key

    def _apply(self, df: DataFrame, order: list[str], prev: Callable) -> tuple[DataFrame, list[str]]:
        before = Record(f"{PREV}.")
        when, out = self.fn(Record(), before)
        df = prev(df, self.key, order, before._seen)
        return (df if when is None else df.where(when)).select(*_shaped(out, order)), order

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return self._apply(df, order, _with_prev)

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return self._apply(df, order, _stream_prev(self.ttl_ms))


@dataclass(frozen=True)
class Stateful(Operator):
    """Running folds by key: an output for every record, the keys and the folds' values."""

    key: list[str]
    folds: dict[str, Fold]
    ttl_ms: int | None = None

    def keys(self) -> list[str]:
        return self.key

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        frame = running(self.key, order)
        if any(f.needs_place for f in self.folds.values()):
            df = df.withColumn(PLACE, F.row_number().over(ordered(self.key, order)))
        first = {f"_f_{n}": f.before(f.value(Record()), frame) for n, f in self.folds.items() if f.before}
        df = df.withColumns(first) if first else df
        out = {n: f.window(F.col(f"_f_{n}") if f.before else f.value(Record()), frame) for n, f in self.folds.items()}
        return df.select(*self.key, *_shaped(out, order)), order

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        from tidefold.streaming.state import running_folds

        return running_folds(df, self.key, order, self.folds, self.ttl_ms), order


@dataclass(frozen=True)
class TrackPrev(Operator):
    """Every record with its predecessor: (prev, curr, has_prev), ``prev`` null at first.

    Without a key the order is global. In batch that takes no single partition:
    records are range-partitioned by order, each partition lags within itself, and
    the last record of each partition is handed to the next that has any.
    """

    key: list[str] | None = None
    ttl_ms: int | None = None

    def keys(self) -> list[str] | None:
        return self.key

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        from tidefold.plans.ranged import with_global_previous

        names = data_columns(df, order)
        held = _with_prev(df, self.key, order, names) if self.key else with_global_previous(df, order, names, PREV)
        return self._tracked(held, names, order)

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        names = data_columns(df, order)
        keyed = df if self.key else df.withColumn("_all", F.lit(0))
        return self._tracked(_stream_prev(self.ttl_ms)(keyed, self.key or ["_all"], order, names), names, order)

    def _tracked(self, df: DataFrame, names: list[str], order: list[str]) -> tuple[DataFrame, list[str]]:
        has = F.col(PREV).isNotNull()
        return df.select(F.col(PREV).alias("prev"), F.struct(*names).alias("curr"), has.alias("has_prev"), *order), order


@dataclass(frozen=True)
class Custom(Operator):
    """A keyed stage in Python for logic that no fold expresses.

    ``make()`` returns a fresh state for a key; ``step(state, record)`` changes it and
    returns the outputs for a record (a dict), as dicts of ``schema``'s columns. In
    batch the records of a key come one after another in order, so a task holds
    one key's state and one Arrow batch, however many records a key has.
    """

    key: list[str]
    make: Callable[[], Any]
    step: Callable[[Any, dict], Iterable[dict]]
    schema: str
    ttl_ms: int | None = None

    def keys(self) -> list[str]:
        return self.key

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        shape = StructType.fromDDL(self.schema)
        names, pos = shape.names, f"_o{len(order)}"
        whole = StructType([*shape.fields, *[df.schema[o] for o in order], *StructType.fromDDL(f"{pos} int").fields])
        arrow = to_arrow_schema(whole)
        key, make, step = self.key, self.make, self.step

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, None
            for batch in batches:
                columns = batch.schema.names
                at = [columns.index(k) for k in key]
                hidden = [columns.index(o) for o in order]
                rows: list[list] = []
                for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    this = [values[k] for k in at]
                    if this != current:
                        current, state = this, make()
                    for i, out in enumerate(step(state, dict(zip(columns, values, strict=True)))):
                        rows.append([*[out[n] for n in names], *[values[o] for o in hidden], i])
                made = zip(*rows, strict=True) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

        near = df.repartition(*key).sortWithinPartitions(*key, *order)
        return near.mapInArrow(run, whole), [*order, pos]

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        from tidefold.streaming.state import custom_stage

        return custom_stage(df, self.key, order, self.make, self.step, self.schema, self.ttl_ms)


@dataclass(frozen=True)
class Latest(Operator):
    """The final form of ``Stateful``: one record a key, the folds' values at its end.

    ``folds`` maps names to aggregate columns; their partial results meet, not the
    records, so a key of any size is no burden. The order of the output is that of each
    key's last record. On a stream the result would change without end, so it raises.
    """

    key: list[str]
    folds: Callable[[Record], dict[str, Column]]

    def keys(self) -> list[str]:
        return self.key

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        last = F.max(F.struct(*order)).alias("_last")
        out = df.groupBy(*self.key).agg(*[c.alias(n) for n, c in self.folds(Record()).items()], last)
        return out.select(*data_columns(out, ["_last"]), *[F.col(f"_last.{o}").alias(o) for o in order]), order

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        raise ValueError("a stream has no last record; use Stateful")


@dataclass(frozen=True)
class Progress(Operator):
    """Records pass unchanged; their count is observed as ``name``.

    A stream reports a line, by ``log``, whenever ``interval`` more records have passed:
    how many, how fast since the last line and on average. A batch has its count in ``to``
    at the end, and ``measure.progress_line`` makes the line.
    """

    name: str
    interval: int = 1
    to: Observation | None = field(default=None, compare=False)
    log: Callable[[str], Any] = field(default=print, compare=False)

    def __post_init__(self) -> None:
        if self.interval <= 0:
            raise ValueError("interval must be positive")

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return df.observe(self.to or self.name, F.count(F.lit(1)).alias("records")), order


@dataclass(frozen=True)
class Latency(Operator):
    """The inner operators, with the time of every ``sample_rate``-th record observed.

    Without ``since``, what is timed is the inner operators themselves: a clock is read
    before them and after them for the same record, in nanoseconds of one machine if they
    keep no keys, and in milliseconds of the wall clock if records meet by key on the way.
    With ``since``, a column of the time in microseconds that a record came at, it is the
    age of a record, as for tick-to-signal delays. Samples are each partition's n-th
    records, in a stream those that a hash of their order picks.

    Observed as ``name``: count, min, max, mean and quantiles, cut to 1 ns .. 1000 s. A
    stream reports a line, by ``log``, for every ``interval`` records.
    """

    name: str
    inner: Operator
    since: Callable[[Record], Column] | None = None
    sample_rate: int = 1
    to: Observation | None = field(default=None, compare=False)
    interval: int = 1000
    log: Callable[[str], Any] = field(default=print, compare=False)

    def __post_init__(self) -> None:
        if self.sample_rate <= 0 or self.interval <= 0:
            raise ValueError("sample_rate and interval must be positive")

    def keys(self) -> list[str] | None:
        return self.inner.keys()

    def _observed(self, df: DataFrame, delay: Column) -> DataFrame:
        cut = F.when(delay.isNotNull(), F.least(F.greatest(delay, F.lit(1)), F.lit(10**12)))
        stats = {"count": F.count(cut), "min": F.min(cut), "max": F.max(cut), "mean": F.avg(cut), "records": F.count(F.lit(1))}
        stats |= {n: F.percentile_approx(cut, q, 1000) for n, q in QUANTILES.items()}
        return df.observe(self.to or self.name, *[c.alias(n) for n, c in stats.items()])

    def _run(self, df: DataFrame, order: list[str], sampled: Column, lower: Callable) -> tuple[DataFrame, list[str]]:
        if self.since is not None:
            now = F.unix_micros(F.current_timestamp())
            aged = df.withColumn("_sampled", sampled).withColumn("_age", F.when(F.col("_sampled"), (now - self.since(Record())) * 1000))
            return lower(self._observed(aged, F.col("_age")).drop("_sampled", "_age"), order)
        # a clock is read for each record: as a column of its own, so that nothing folds it
        clock = F.expr("java_method('java.lang.System', 'currentTimeMillis')" if self.keys() else "java_method('java.lang.System', 'nanoTime')")
        unit = 1_000_000 if self.keys() else 1
        begun = df.withColumn("_sampled", sampled).withColumn("_clock", clock)
        begun = begun.withColumn("_begin", F.when(F.col("_sampled"), F.col("_clock").cast("long"))).drop("_sampled", "_clock")
        out, after = lower(begun, [*order, "_begin"])
        kept = [o for o in after if o != "_begin"]
        delay = (F.col("_clock").cast("long") - F.col("_begin")) * unit
        return self._observed(out.withColumn("_clock", clock), delay).drop("_begin", "_clock"), kept

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        sampled = F.lit(True) if self.sample_rate == 1 else (place + 1) % self.sample_rate == 0
        return self._run(df, order, sampled, self.inner.batch)

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        sampled = F.pmod(F.xxhash64(*order), F.lit(self.sample_rate)) == 0
        return self._run(df, order, sampled, self.inner.stream)


@dataclass(frozen=True)
class _Composed(Operator):
    parts: tuple[Operator, ...]

    def keys(self) -> list[str] | None:
        found = [k for p in self.parts if (k := p.keys())]
        return found[0] if found else None

    def reporters(self) -> list[Progress | Latency]:
        return [r for p in self.parts for r in p.reporters()]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        for part in self.parts:
            df, order = part.batch(df, order)
        return df, order

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        for part in self.parts:
            df, order = part.stream(df, order)
        return df, order


def compose(*parts: Operator) -> Operator:
    """The operators one after another; compositions within are flattened."""
    flat: list[Operator] = []
    for p in parts:
        flat += p.parts if isinstance(p, _Composed) else [p]
    return _Composed(tuple(flat))


def flattened(parts: Iterable[Operator]) -> list[Operator]:
    """The simple operators, in order."""
    return list(compose(*parts).parts)
