"""Lowering to ``transformWithState``: the previous record, folds, custom stages.

The records of a key within a micro-batch come in no order, so the handlers sort
them; across batches, arrival order holds. State is kept by RocksDB and survives
restarts. Column logic stays outside: the handlers only carry state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from tidefold.plans.fold import Fold


class _Pickled(StatefulProcessor):
    """One pickled value a key; ``ttl_ms`` drops it when idle, None keeps it."""

    def __init__(self, order: list[str], names: list[str], update: Callable[[Any, Row], tuple[Any, list[tuple]]], ttl_ms: int | None = None) -> None:
        self.order, self.names, self.update, self.ttl_ms = order, names, update, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        out: list[tuple] = []
        for row in sorted(rows, key=lambda r: tuple(r[o] for o in self.order)):
            state, found = self.update(state, row)
            out += found
        self.state.update((_pickled(state),))
        for values in out:
            yield Row(**dict(zip(self.names, values, strict=True)))

    def close(self) -> None:
        pass


def _pickled(state: Any) -> bytes:
    try:
        return pickle.dumps(state)
    except pickle.PicklingError:  # of a class that travelled here with its functions
        return cloudpickle.dumps(state)


def _keyed(df: DataFrame, key: list[str], order: list[str], update: Callable, schema: StructType, ttl_ms: int | None = None) -> DataFrame:
    return df.groupBy(*key).transformWithState(_Pickled(order, schema.names, update, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def with_previous(df: DataFrame, key: list[str], order: list[str], fields: list[str], name: str, ttl_ms: int | None = None) -> DataFrame:
    """Every record with the struct ``name`` of its key's previous record."""
    kept = StructType([df.schema[f] for f in fields]) if fields else StructType([StructField("_", BooleanType())])
    schema = StructType([*df.schema.fields, StructField(name, kept, True)])
    columns = df.columns

    def update(state: tuple | None, row: Row) -> tuple[tuple, list[tuple]]:
        now = tuple(row[f] for f in fields) if fields else (True,)
        before = None if state is None else Row(**dict(zip(kept.names, state, strict=True)))
        return now, [(*[row[c] for c in columns], before)]

    return _keyed(df, key, order, update, schema, ttl_ms)


def running_folds(df: DataFrame, key: list[str], order: list[str], folds: dict[str, Fold], ttl_ms: int | None = None) -> DataFrame:
    """The keys, the folds' values after each record, and the order columns."""
    from tidefold.operators.ops import Record

    inputs = {f"_x{i}": f.value(Record()) for i, f in enumerate(folds.values())}
    slim = df.select(*key, *order, *[c.alias(n) for n, c in inputs.items()])
    named = StructType.fromDDL(", ".join(f"{n} {f.type}" for n, f in folds.items()))
    schema = StructType([*[slim.schema[k] for k in key], *named.fields, *[slim.schema[o] for o in order]])
    names, parts = list(inputs), list(folds.values())

    def update(state: list | None, row: Row) -> tuple[list, list[tuple]]:
        state = [f.step(s, row[n]) for f, n, s in zip(parts, names, state or [None] * len(parts), strict=True)]
        values = [None if s is None else f.result(s) for f, s in zip(parts, state, strict=True)]
        return state, [(*[row[k] for k in key], *values, *[row[o] for o in order])]

    return _keyed(slim, key, order, update, schema, ttl_ms)


def custom_stage(df: DataFrame, key: list[str], order: list[str], make: Callable[[], Any], step: Callable[[Any, dict], Iterable[dict]], schema: str, ttl_ms: int | None = None) -> tuple[DataFrame, list[str]]:
    """A Python stage by key; outputs of one record are numbered in a new order column."""
    pos = f"_o{len(order)}"
    names = StructType.fromDDL(schema).names
    shape = StructType([*StructType.fromDDL(schema).fields, *[df.schema[o] for o in order], *StructType.fromDDL(f"{pos} int").fields])

    def update(state: Any, row: Row) -> tuple[Any, list[tuple]]:
        state = make() if state is None else state
        found = [(*[out[n] for n in names], *[row[o] for o in order], i) for i, out in enumerate(step(state, row.asDict()))]
        return state, found

    return _keyed(df, key, order, update, shape, ttl_ms), [*order, pos]
