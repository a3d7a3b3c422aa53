"""Service health: noise filter, bucketed summaries, alerts, and alerts once each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.functions import bucket, saturating_unsigned
from tidefold.operators import DedupBy, Map
from tidefold.plans.pipeline import Pipeline
from tidefold.workloads.sensor import alerts, average, summaries


def pipeline(order: tuple[str, ...], id_col: str = "service_id", width: int = 100_000) -> Pipeline:
    """Readings (id, value, timestamp) to alerts (id, bucket, severity), repeats dropped."""
    rounded = saturating_unsigned(F.col("value") * 1000)
    return (
        Pipeline(order)
        .stage(
            Map(lambda r: {id_col: r[id_col], "value": r.value, "timestamp": r.timestamp, "step": rounded}),
            DedupBy([id_col, "step"], compare=[id_col, "value", "timestamp"]),
            Map(lambda r: {id_col: r[id_col], "bucket": bucket(r.timestamp, width), "value": r.value}),
        )
        .stage(summaries(id_col, False), Map(lambda r: {id_col: r[id_col], "bucket": r.bucket, "avg": average(r)}))
        .stage(alerts(id_col), DedupBy([id_col]))
    )
