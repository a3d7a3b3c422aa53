"""Session factory. Everything else takes the session it is given."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_spark(
    app_name: str = "tidefold", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution, UTC and the RocksDB state store.

    ``master`` is left to spark-submit unless given. Further settings are
    keyword arguments with dots written as double underscores.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
