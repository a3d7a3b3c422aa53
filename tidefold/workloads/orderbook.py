"""Order book: messages to level changes, level volumes, top levels and imbalance."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.operators import Custom, FilterMap, FlatMap, Latency, Map, Operator, Stateful
from tidefold.plans import Fold
from tidefold.plans.fold import ordered, running
from tidefold.plans.pipeline import Pipeline

DEPTH = 5
# The weight of each level, best first.
WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.2)
DELTAS = "instrument_id bigint, ts bigint, ts_recv bigint, side string, price bigint, delta bigint, is_clear boolean"
TOPS = "symbol bigint, ts bigint, ts_recv bigint, ask_price array<bigint>, ask_size array<bigint>, bid_price array<bigint>, bid_size array<bigint>"


def _changes(live: dict[int, tuple[int, int]], m: dict) -> Iterator[tuple[int, int]]:
    """(price, change of volume) for a message; ``live`` has the price and size of each order."""
    order, price, size = m["order_id"], m["price"], m["size"]
    action = m["action"]
    if action == "A":
        live[order] = price, size
        yield price, size
    elif action == "C":
        live.pop(order, None)
        yield price, -size
    elif action in ("F", "T"):
        if order in live:
            was, left = live[order]
            live[order] = was, max(0, left - size)
            if left <= size:
                del live[order]
        yield price, -size
    elif action == "M":
        old = live.get(order)
        live[order] = price, size
        if old is None:
            yield price, size
        elif old[0] == price:
            yield price, size - old[1]
        else:
            yield old[0], -old[1]
            yield price, size


def _track(live: dict, m: dict) -> Iterator[dict]:
    base = {"instrument_id": m["instrument_id"], "ts": m["ts"], "ts_recv": m["ts_recv"]}
    if m["action"] == "R":
        live.clear()
        yield base | {"side": None, "price": 0, "delta": 0, "is_clear": True}
        return
    for price, delta in _changes(live, m):
        yield base | {"side": m["side"], "price": price, "delta": delta, "is_clear": False}


@dataclass(frozen=True)
class OrderTracker(Operator):
    """Messages to level changes: one, two or none each; a clear gives a clear row.

    Orders are tracked by instrument, so an order id must not move between them. Only a
    modification needs an order's past: its last message that set or ended it, and what
    was filled since. In batch those are windows over the order's messages since the last
    clear; a stream keeps the live orders of an instrument.
    """

    def keys(self) -> list[str]:
        return ["instrument_id"]

    def batch(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        pos = f"_o{len(order)}"
        action, price, size = F.col("action"), F.col("price"), F.col("size")
        filled = F.when(action.isin("F", "T"), size)
        clears = F.sum(F.when(action == "R", 1).otherwise(0)).over(running(["instrument_id"], order))
        one = ordered(["instrument_id", "_epoch", "order_id"], order)
        upto, before = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(Window.unboundedPreceding, -1)
        held = df.withColumn("_epoch", clears)
        held = held.withColumns({"_filled": F.coalesce(F.sum(filled).over(upto), F.lit(0)), "_fills": F.count(filled).over(upto)})
        setting = F.when(action.isin("A", "M", "C"), F.struct("action", "price", "size", "_filled", "_fills"))
        held = held.withColumn("_last", F.last(setting, ignorenulls=True).over(before))
        left = F.greatest(F.col("_last.size") - (F.col("_filled") - F.col("_last._filled")), F.lit(0))
        live = F.coalesce((F.col("_last.action") != "C") & ((left > 0) | (F.col("_fills") == F.col("_last._fills"))), F.lit(False))
        change = lambda price, delta: F.struct(price.alias("price"), delta.alias("delta"))
        whole = change(price, size)
        moved = F.when(F.col("_last.price") == price, F.array(change(price, size - left))).otherwise(F.array(change(F.col("_last.price"), -left), whole))
        zero = F.lit(0).cast("bigint")
        none = F.array().cast("array<struct<price:bigint,delta:bigint>>")
        changes = F.when(action == "A", F.array(whole)).when(action.isin("C", "F", "T"), F.array(change(price, -size)))
        changes = changes.when(action == "M", F.when(live, moved).otherwise(F.array(whole))).when(action == "R", F.array(change(zero, zero))).otherwise(none)
        out = held.select("instrument_id", "ts", "ts_recv", F.when(action != "R", F.col("side")).alias("side"), (action == "R").alias("is_clear"), *order, F.posexplode(changes).alias(pos, "_c"))
        return out.select("instrument_id", "ts", "ts_recv", "side", F.col("_c.price").alias("price"), F.col("_c.delta").alias("delta"), "is_clear", *order, pos), [*order, pos]

    def stream(self, df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
        return Custom(["instrument_id"], dict, _track, DELTAS).stream(df, order)


def order_tracker() -> Operator:
    """Messages to level changes; see ``OrderTracker``."""
    return OrderTracker()


def levels() -> list[Operator]:
    """Level changes to volumes: max(0, volume + change) by instrument, side and price.

    A clear starts all levels of the instrument anew and gives two rows of price 0.
    The epoch of clears is a running count, and the clamped sum is two windows.
    """
    pair = F.array(F.lit("B"), F.lit("A"))

    def sides(r: object) -> Column:
        both = F.transform(pair, lambda s: F.struct(s.alias("side"), F.lit(0).cast("bigint").alias("price"), F.lit(0).cast("bigint").alias("delta")))
        one = F.array(F.struct(F.col("side").alias("side"), F.col("price").alias("price"), F.col("delta").alias("delta")))
        kept = F.when(F.col("is_clear"), both).otherwise(one)
        return F.transform(
            kept,
            lambda s: F.struct(
                F.col("instrument_id").alias("instrument_id"), F.col("ts").alias("ts"), F.col("ts_recv").alias("ts_recv"), F.col("epoch").alias("epoch"),
                s["side"].alias("side"), s["price"].alias("price"), s["delta"].alias("delta"),
            ),
        )

    names = ("ts", "ts_recv", "side", "price", "delta")
    kinds = {"ts": "bigint", "ts_recv": "bigint", "side": "string", "price": "bigint", "delta": "bigint"}
    carried = {n: Fold.last((lambda n: lambda r: r[n])(n), kinds[n]) for n in names}
    epochs = Fold.sum(lambda r: F.when(r.is_clear, 1).otherwise(0).cast("bigint"), "bigint")
    return [
        Stateful(["instrument_id"], carried | {"epoch": epochs, "is_clear": Fold.last(lambda r: r.is_clear, "boolean")}),
        FlatMap(sides),
        Stateful(
            ["instrument_id", "epoch", "side", "price"],
            {"ts": carried["ts"], "ts_recv": carried["ts_recv"], "volume": Fold.clamped_sum(lambda r: r.delta)},
        ),
        Map(lambda r: {"symbol": r.instrument_id, "ts": r.ts, "ts_recv": r.ts_recv, "side": r.side, "price": r.price, "volume": r.volume}),
    ]


def new_book() -> dict[str, list[tuple[int, int]]]:
    """The five best (price, volume) of asks and bids; price 0 is an empty slot."""
    return {"A": [(0, 0)] * DEPTH, "B": [(0, 0)] * DEPTH}


def put(book: dict[str, list[tuple[int, int]]], side: str, price: int, volume: int, reset_on_clear: bool = False) -> None:
    """One level's new volume.

    A level that falls off the end comes back only with its own next update. A clear,
    which comes as price 0, leaves the book as it is, unless ``reset_on_clear``.
    """
    rows = book.get(side)
    if rows is None:
        return
    if price == 0:
        if reset_on_clear:
            book[side] = [(0, 0)] * DEPTH
        return
    prices = [p for p, _ in rows]
    if price in prices:
        i = prices.index(price)
        rows[i : i + 1] = [(price, volume)] if volume else []
        rows += [(0, 0)] * (DEPTH - len(rows))
    elif volume > 0:
        worse = (i for i, p in enumerate(prices) if p == 0 or (price < p if side == "A" else price > p))
        i = next(worse, None)
        if i is not None:
            rows.insert(i, (price, volume))
            rows.pop()


def _top(book: dict, level: dict, reset_on_clear: bool = False) -> Iterator[dict]:
    put(book, level["side"], level["price"], level["volume"], reset_on_clear)
    asks, bids = book["A"], book["B"]
    yield {
        "symbol": level["symbol"], "ts": level["ts"], "ts_recv": level["ts_recv"],
        "ask_price": [p for p, _ in asks], "ask_size": [s for _, s in asks],
        "bid_price": [p for p, _ in bids], "bid_size": [s for _, s in bids],
    }


def top_levels(reset_on_clear: bool = False) -> Operator:
    """Level volumes to the top of the book after each."""
    return Custom(["symbol"], new_book, partial(_top, reset_on_clear=reset_on_clear), TOPS)


def imbalance() -> Operator:
    """(bid - ask) / (bid + ask) of the weighted volumes; no row for an empty book."""

    def weighted(sizes: Column) -> Column:
        w = F.array(*[F.lit(x) for x in WEIGHTS])
        return F.aggregate(F.zip_with(sizes, w, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)

    def logic(r: object) -> tuple[Column, dict[str, Column]]:
        bid, ask = weighted(F.col("bid_size")), weighted(F.col("ask_size"))
        out = {"symbol": F.col("symbol"), "ts": F.col("ts"), "ts_recv": F.col("ts_recv"), "imbalance": (bid - ask) / (bid + ask), "bid_vol": bid, "ask_vol": ask}
        return bid + ask > 0, out

    return FilterMap(logic)


def high_imbalance(signals: Pipeline, above: float = 0.98) -> Pipeline:
    """Only signals whose imbalance is over ``above`` in size, for a log."""
    return signals.stage(FilterMap(lambda r: (F.abs(r.imbalance) > above, {n: r[n] for n in ("symbol", "ts", "imbalance")})))


class ThrottledLog:
    """Writes high imbalances of a stream's results to ``log``, one line in ``seconds`` at most.

    ``batch`` is what ``foreachBatch`` takes; the newest signal of a batch is written.
    """

    def __init__(self, above: float = 0.98, seconds: float = 0.5, log: Callable[[str], object] = print) -> None:
        self.above, self.seconds, self.log = above, seconds, log
        self._last = -math.inf

    def batch(self, signals: DataFrame, number: int) -> None:
        """One micro-batch of signals."""
        if time.monotonic() - self._last <= self.seconds:
            return
        row = signals.where(F.abs("imbalance") > self.above).orderBy(F.desc("ts"), "symbol").limit(1).collect()
        for r in row:
            self.log(f"[Sym:{r.symbol}] High Imbalance: {r.imbalance:.4f} (B:{r.bid_vol:.0f} A:{r.ask_vol:.0f})")
            self._last = time.monotonic()


def tick_to_signal(order: tuple[str, ...], every: int = 1000, **report: Any) -> Pipeline:
    """``pipeline`` with the age of every ``every``-th level change observed, from
    ``ts_recv`` in nanoseconds of the wall clock."""
    timed = Latency("tick-to-signal", top_levels(), lambda r: (r.ts_recv / 1000).cast("bigint"), sample_rate=every, **report)
    return Pipeline(order).stage(order_tracker()).stage(*levels()).stage(timed, imbalance())


def pipeline(order: tuple[str, ...], reset_on_clear: bool = False) -> Pipeline:
    """Messages (ts, ts_recv, order_id, price, size, instrument_id, action, side) to signals."""
    return Pipeline(order).stage(order_tracker()).stage(*levels()).stage(top_levels(reset_on_clear), imbalance())
