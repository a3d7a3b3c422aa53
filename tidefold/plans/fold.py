"""Folds: one definition, lowered to a running window or to a state update.

A fold sees the records of a key in order and has a value after each. ``window``
states it as window expressions, which Catalyst runs inside the JVM; ``step`` is
the same update in Python, for streams, where windows over rows do not exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: A record's place in its key, from 1, while a fold is lowered.
PLACE = "_place"


@dataclass(frozen=True)
class Fold:
    """``window(value, frame)`` gives the running value; ``step(state, value)`` the next
    state (first state: None) and ``result(state)`` its value. ``passes`` counts window
    passes; with two, ``window`` gets the column of the first, ``before(value, frame)``."""

    value: Callable[[Any], Column]
    window: Callable[[Column, WindowSpec], Column]
    step: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]
    type: str
    before: Callable[[Column, WindowSpec], Column] | None = None
    needs_place: bool = False

    @staticmethod
    def count() -> Fold:
        """Records so far."""
        return Fold(lambda r: F.lit(1), lambda v, w: F.count(v).over(w), lambda s, v: (s or 0) + 1, lambda s: s, "bigint")

    @staticmethod
    def sum(value: Callable[[Any], Column], type: str = "double") -> Fold:
        """The running sum; nulls are left out, and before the first value it is null."""
        return Fold(value, lambda v, w: F.sum(v).over(w), _plus, lambda s: s, type)

    @staticmethod
    def sum_after_first(value: Callable[[Any], Column], type: str = "double") -> Fold:
        """The running sum without the key's first record, where it is 0; nulls are left out."""
        zero = 0.0 if type in ("double", "float") else 0
        return Fold(
            value,
            lambda v, w: F.sum(F.when(F.col(PLACE) > 1, v).otherwise(F.lit(0).cast(type))).over(w),
            lambda s, v: zero if s is None else _plus(s, v),
            lambda s: s,
            type,
            needs_place=True,
        )

    @staticmethod
    def mean(value: Callable[[Any], Column]) -> Fold:
        """The running mean; nulls are left out, and before the first value it is null."""
        return Fold(
            value,
            lambda v, w: F.avg(v).over(w),
            lambda s, v: s if v is None else (float(v), 1) if s is None else (s[0] + v, s[1] + 1),
            lambda s: s[0] / s[1],
            "double",
        )

    @staticmethod
    def min(value: Callable[[Any], Column], type: str = "double") -> Fold:
        """The running minimum; NaN is left out."""
        return Fold(value, lambda v, w: F.min(_no_nan(v, type)).over(w), lambda s, v: _least(s, v, False), lambda s: s, type)

    @staticmethod
    def max(value: Callable[[Any], Column], type: str = "double") -> Fold:
        """The running maximum; NaN is left out."""
        return Fold(value, lambda v, w: F.max(_no_nan(v, type)).over(w), lambda s, v: _least(s, v, True), lambda s: s, type)

    @staticmethod
    def first(value: Callable[[Any], Column], type: str) -> Fold:
        """The value of the key's first record."""
        return Fold(value, lambda v, w: F.first(v).over(w), lambda s, v: (v,) if s is None else s, lambda s: s[0], type)

    @staticmethod
    def last(value: Callable[[Any], Column], type: str) -> Fold:
        """The value of the current record."""
        return Fold(value, lambda v, w: v, lambda s, v: (v,), lambda s: s[0], type)

    @staticmethod
    def clamped_sum(delta: Callable[[Any], Column], type: str = "bigint") -> Fold:
        """``max(0, total + delta)`` after each record, from 0; a null changes nothing.

        With S the plain running sum, the clamped one is S less the smallest of 0
        and all S so far: two window passes, no state.
        """
        return Fold(
            lambda r: F.coalesce(delta(r), F.lit(0).cast(type)),
            lambda s, w: s - F.least(F.lit(0).cast(type), F.min(s).over(w)),
            lambda s, v: max(0, (s or 0) + v),
            lambda s: s,
            type,
            before=lambda v, w: F.sum(v).over(w),
        )


def _plus(state: Any, v: Any) -> Any:
    return state if v is None else v if state is None else state + v


def _no_nan(v: Column, type: str) -> Column:
    return F.when(~F.isnan(v), v) if type in ("double", "float") else v


def _least(state: Any, v: Any, largest: bool) -> Any:
    if v is None or v != v:
        return state
    return v if state is None or (v > state if largest else v < state) else state


def running(keys: list[str], order: list[str]) -> WindowSpec:
    """From the first record of a key to the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    """The records of a key in order."""
    return Window.partitionBy(*keys).orderBy(*order)
