"""Sensor anomalies: bucketed summaries by sensor, and alerts on a jump of the mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidefold.functions import bucket
from tidefold.operators import Delta, Map, Stateful
from tidefold.operators.ops import Record
from tidefold.plans import Fold
from tidefold.plans.pipeline import Pipeline

JUMP = 1.5


def summaries(id_col: str, true_mean: bool) -> Stateful:
    """Running count, extremes and sum or mean of ``value`` by id and bucket.

    Unless ``true_mean``, the sum leaves out a bucket's first value, which its count
    includes.
    """
    value = lambda r: r.value
    folds = {"n": Fold.count(), "low": Fold.min(value), "high": Fold.max(value)}
    folds |= {"total": Fold.sum(value)} if true_mean else {"total": Fold.sum_after_first(value)}
    return Stateful([id_col, "bucket"], folds)


def average(r: Record) -> Column:
    """The summary's mean."""
    return r.total / r.n


def alerts(id_col: str) -> Delta:
    """A row where the mean is over ``JUMP`` times that of the id's previous summary."""

    def logic(c: Record, p: Record) -> tuple[Column, dict[str, Column]]:
        rises = p.exists & (c.avg > p.avg * JUMP)
        return rises, {id_col: c[id_col], "bucket": c.bucket, "severity": F.lit(1)}

    return Delta([id_col], logic)


def pipeline(order: tuple[str, ...], id_col: str = "sensor_id", width: int = 100_000, true_mean: bool = False) -> Pipeline:
    """Readings (id, value, timestamp) to alerts (id, bucket, severity)."""
    return (
        Pipeline(order)
        .stage(Map(lambda r: {id_col: r[id_col], "bucket": bucket(r.timestamp, width), "value": r.value}))
        .stage(summaries(id_col, true_mean), Map(lambda r: {id_col: r[id_col], "bucket": r.bucket, "avg": average(r)}))
        .stage(alerts(id_col))
    )
