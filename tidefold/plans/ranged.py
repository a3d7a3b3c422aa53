"""The previous record in a global order, without a single partition."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder, so that later reads agree."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidefold-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def with_global_previous(df: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
    """``name``: the struct of ``fields`` of the record before, null for the first.

    Range bounds are sampled, so the ranges are written before they are used. Each
    range lags within itself; its last record goes to the next range that is not
    empty by a table with a row a range.
    """
    held = F.struct(*fields)
    ranges = materialised(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    place = F.struct(*order)
    tails = ranges.groupBy("_part").agg(F.max_by(held, place).alias("_tail"))
    handed = tails.select("_part", F.lag("_tail").over(Window.orderBy("_part")).alias("_tail"))
    inside = Window.partitionBy("_part").orderBy(*order)
    lagged = ranges.withColumn(name, F.lag(held).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    out = lagged.join(handed, "_part").withColumn(name, F.when(F.col("_first"), F.col("_tail")).otherwise(F.col(name)))
    return out.drop("_part", "_first", "_tail")
