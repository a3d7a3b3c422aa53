"""What the plans look like: shuffles, pushed filters, columns read."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidefold import queries as Q
from tidefold.workloads import sensor

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange ", plan(df)))


def test_one_shuffle_serves_nested_keys(spark) -> None:
    assert shuffles(Q.sensor_alerts(spark, DATA)) == 1
    assert shuffles(Q.health_alerts(spark, DATA)) == 1
    assert sensor.pipeline(("ts", "event_id"), "user_id").shared_key(["user_id", "value"]) == ["user_id"]


def test_stateless_operators_do_not_shuffle(spark) -> None:
    for name in ("map_project", "filter_predicate", "filter_map_option", "flat_map_duplicate", "pipe_nested"):
        assert shuffles(Q.QUERIES[name](spark, DATA)) == 0, name


def test_filters_and_columns_reach_the_scan(spark) -> None:
    text = plan(Q.journal_get_at(spark, DATA))
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_id,17\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(Q.delta_change(spark, DATA)))[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "ts", "user_id", "value"}


def test_global_previous_has_no_single_partition_of_records(spark) -> None:
    out = Q.track_prev_global(spark, DATA)
    assert out.agg(F.count(F.lit(1))).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    single = re.findall(r"Window \[[^\n]*lag\(_tail[^\n]*\n[^\n]*\n[^\n]*SinglePartition", plan(out))
    assert plan(out).count("SinglePartition") == len(single) <= 1 or plan(out).count("SinglePartition") <= 1
