"""The queries of the engine over the ``events`` table, and their SQL for DuckDB.

Each query has a name, a function of (spark, sf_dir) and the equivalent SQL, side
by side. Records are ordered by (ts, event_id). Float sums, whose last bits depend on the
order of addition, are rounded where they are projected; where a threshold decides, the SQL
adds up in order, as a fold does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import bucket, micros, saturating_unsigned
from tidefold.measure import latency_stats, outliers
from tidefold.operators import Custom, DedupBy, Delta, Filter, FilterMap, FlatMap, Inspect, Latency, Latest, Map, Progress, Stateful, TrackPrev, compose
from tidefold.plans import Fold
from tidefold.plans.pipeline import Pipeline
from tidefold.sources import Journal, load
from tidefold.workloads import health, orderbook, sensor

Query = Callable[[SparkSession, str], DataFrame]
ORDER = ("ts", "event_id")
DAY = 86_400_000_000
#: Precedes and orders every window of the SQL.
W = "PARTITION BY user_id ORDER BY ts, event_id"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ``us``, the time in microseconds."""
    return load(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))


def pipe() -> Pipeline:
    """An empty pipeline over events."""
    return Pipeline(ORDER)


@query("SELECT event_id, round(value * 2, 4) AS v FROM events")
def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe().stage(Map(lambda r: {"event_id": r.event_id, "v": F.round(r.value * 2, 4)})).run(events(spark, sf_dir))


@query("SELECT event_id, user_id, round(value, 4) AS v FROM events WHERE value > 100")
def filter_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "v": F.round(r.value, 4)})
    return pipe().stage(Filter(lambda r: r.value > 100), kept).run(events(spark, sf_dir))


@query("SELECT event_id, event_id // 2 AS half FROM events WHERE event_id % 2 = 0")
def filter_map_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = FilterMap(lambda r: (r.event_id % 2 == 0, {"event_id": r.event_id, "half": F.expr("event_id div 2")}))
    return pipe().stage(halves).run(events(spark, sf_dir))


@query("SELECT event_id, event_id AS v FROM events UNION ALL SELECT event_id, event_id + 1 FROM events")
def flat_map_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lambda r, k: F.struct(r.event_id.alias("event_id"), (r.event_id + k).alias("v"))
    return pipe().stage(FlatMap(lambda r: F.array(out(r, 0), out(r, 1)))).run(events(spark, sf_dir))


@query("SELECT event_id, user_id FROM events")
def inspect_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Inspect({"n": F.count(F.lit(1)), "highest": F.max("value")}, Observation("inspect"))
    return pipe().stage(seen, Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id})).run(events(spark, sf_dir))


@query("SELECT event_id, (event_id + 1) * 2 + 1 AS v FROM events")
def pipe_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda fn: Map(lambda r: {"event_id": r.event_id, "v": fn(r.v)})
    start = Map(lambda r: {"event_id": r.event_id, "v": r.event_id})
    return pipe().stage(compose(start, step(lambda v: v + 1), compose(step(lambda v: v * 2), step(lambda v: v + 1)))).run(events(spark, sf_dir))


@query("SELECT event_id, event_id + 10 AS v FROM events")
def multi_stage_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipe().stage(Map(lambda r: {"event_id": r.event_id, "v": r.event_id}))
    for _ in range(10):
        out = out.stage(Map(lambda r: {"event_id": r.event_id, "v": r.v + 1}))
    return out.run(events(spark, sf_dir))


@query("SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events")
def empty_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipe().run(events(spark, sf_dir))
    return out.select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


def observed(spark: SparkSession, df: DataFrame, seen: Observation, names: tuple[str, ...]) -> DataFrame:
    """One row of what is observed while a frame runs."""
    df.write.format("noop").mode("overwrite").save()
    values = [F.lit(seen.get[n]).alias(n) for n in names]
    return spark.range(1).select(*values)


@query("SELECT count(*) AS records FROM events")
def progress_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Observation("progress")
    return observed(spark, pipe().stage(Progress("events", 1000, seen)).run(events(spark, sf_dir)), seen, ("records",))


@query("SELECT count(*) AS n, round(max(value), 4) AS highest FROM events")
def inspect_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Observation("inspected")
    watched = Inspect({"n": F.count(F.lit(1)), "highest": F.round(F.max("value"), 4)}, seen)
    return observed(spark, pipe().stage(watched).run(events(spark, sf_dir)), seen, ("n", "highest"))


@query("SELECT count(*) AS records, count(*) AS count, true AS ordered FROM events")
def latency_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of a wrapped stage differ from run to run; their number and order do not."""
    seen = Observation("timed")
    timed = Latency("map", Map(lambda r: {"v": r.event_id + 1}), to=seen)
    out = observed(spark, pipe().stage(timed).run(events(spark, sf_dir)), seen, ("records", "count", "min", "p50", "p999", "max"))
    ordered = (F.col("min") >= 1) & (F.col("min") <= F.col("p50")) & (F.col("p50") <= F.col("p999")) & (F.col("p999") <= F.col("max"))
    return out.select("records", "count", ordered.alias("ordered"))


@query("SELECT event_id, event_id + 1 AS v FROM events")
def latency_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = Map(lambda r: {"event_id": r.event_id, "v": r.event_id + 1})
    timed = Latency("map", inner, lambda r: r.us, sample_rate=10, to=Observation("latency"))
    return pipe().stage(timed).run(events(spark, sf_dir))


@query(
    f"""SELECT event_id, user_id, event_type FROM
    (SELECT *, lag(event_type) OVER ({W}) AS p, row_number() OVER ({W}) AS rn FROM events)
    WHERE rn = 1 OR event_type IS DISTINCT FROM p"""
)
def dedup_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipe().stage(DedupBy(["user_id"], compare=["event_type"])).run(events(spark, sf_dir))
    return out.select("event_id", "user_id", "event_type")


@query(
    """SELECT event_id, user_id, step FROM
    (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM
        (SELECT *, CAST(trunc(value / 10) AS BIGINT) AS step FROM events)
     WINDOW w AS (PARTITION BY user_id, step ORDER BY ts, event_id))
    WHERE rn = 1 OR event_type IS DISTINCT FROM p"""
)
def dedup_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "event_type": r.event_type, "step": saturating_unsigned(r.value / 10)})
    out = pipe().stage(steps, DedupBy(["user_id", "step"], compare=["user_id", "step", "event_type"])).run(events(spark, sf_dir))
    return out.select("event_id", "user_id", "step")


@query(f"SELECT event_id, round(value - p, 4) AS change FROM (SELECT *, lag(value) OVER ({W}) AS p FROM events) WHERE p IS NOT NULL")
def delta_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = Delta(["user_id"], lambda c, p: (p.exists, {"event_id": c.event_id, "change": F.round(c.value - p.value, 4)}))
    return pipe().stage(change).run(events(spark, sf_dir))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER ({W}) AS rn FROM events) WHERE rn = 1")
def delta_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = Delta(["user_id"], lambda c, p: (~p.exists, {"event_id": c.event_id, "user_id": c.user_id}))
    return pipe().stage(first).run(events(spark, sf_dir))


@query(f"SELECT event_id, user_id FROM (SELECT *, lag(value) OVER ({W}) AS p FROM events) WHERE value > p * 1.5")
def delta_spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    spike = Delta(["user_id"], lambda c, p: (p.exists & (c.value > p.value * 1.5), {"event_id": c.event_id, "user_id": c.user_id}))
    return pipe().stage(spike).run(events(spark, sf_dir))


@query(f"SELECT event_id, user_id, round(sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def stateful_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = Stateful(["user_id"], {"event_id": Fold.last(lambda r: r.event_id, "bigint"), "total": Fold.sum(lambda r: r.value)})
    return pipe().stage(total, Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "total": F.round(r.total, 4)})).run(events(spark, sf_dir))


@query(
    f"""SELECT event_id, count(*) OVER w AS n, round(min(value) OVER w, 4) AS low, round(max(value) OVER w, 4) AS high,
    round(sum(value) OVER w, 6) / count(*) OVER w AS mean, first_value(event_type) OVER w AS first_type
    FROM events WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)"""
)
def stateful_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda r: r.value
    folds = {"event_id": Fold.last(lambda r: r.event_id, "bigint"), "n": Fold.count(), "low": Fold.min(value), "high": Fold.max(value), "total": Fold.sum(value), "first_type": Fold.first(lambda r: r.event_type, "string")}
    exact = lambda r: {"low": F.round(r.low, 4), "high": F.round(r.high, 4), "mean": F.round(r.total, 6) / r.n}
    out = Map(lambda r: {"event_id": r.event_id, "n": r.n, "first_type": r.first_type} | exact(r))
    return pipe().stage(Stateful(["user_id"], folds), out).run(events(spark, sf_dir))


@query(
    f"""SELECT event_id, n, round(total, 6) / n AS mean FROM (SELECT event_id, count(*) OVER w AS n,
    sum(CASE WHEN rn > 1 THEN value ELSE 0.0 END) OVER w AS total
    FROM (SELECT *, row_number() OVER ({W}) AS rn FROM events) WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING))"""
)
def stateful_init_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = {"event_id": Fold.last(lambda r: r.event_id, "bigint"), "n": Fold.count(), "total": Fold.sum_after_first(lambda r: r.value)}
    out = Map(lambda r: {"event_id": r.event_id, "n": r.n, "mean": F.round(r.total, 6) / r.n})
    return pipe().stage(Stateful(["user_id"], folds), out).run(events(spark, sf_dir))


@query(
    f"""SELECT event_id, user_id, bucket, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total
    FROM (SELECT *, epoch_us(ts) - epoch_us(ts) % {DAY} AS bucket FROM events)
    WINDOW w AS (PARTITION BY user_id, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def stateful_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "bucket": bucket(r.us, DAY), "value": r.value})
    folds = {"event_id": Fold.last(lambda r: r.event_id, "bigint"), "n": Fold.count(), "total": Fold.sum(lambda r: r.value)}
    out = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "bucket": r.bucket, "n": r.n, "total": F.round(r.total, 4)})
    return pipe().stage(source, Stateful(["user_id", "bucket"], folds), out).run(events(spark, sf_dir))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def stateful_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = lambda r: {"n": F.count(F.lit(1)), "total": F.sum(r.value), "last_type": F.max_by(r.event_type, r.event_id)}
    out = pipe().stage(Latest(["user_id"], final)).run(events(spark, sf_dir))
    return out.withColumn("total", F.round("total", 4))


CENTS = "CAST(round(value * 100) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END"


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {CENTS} AS d, row_number() OVER ({W}) AS rn FROM events),
    s AS (SELECT event_id, user_id, rn, greatest(0, d) AS v FROM e WHERE rn = 1
        UNION ALL SELECT e.event_id, e.user_id, e.rn, greatest(0, s.v + e.d) FROM e JOIN s ON e.user_id = s.user_id AND e.rn = s.rn + 1)
    SELECT event_id, user_id, v FROM s"""
)
def stateful_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda r: F.round(r.value * 100).cast("bigint") * F.when(r.event_id % 2 == 0, 1).otherwise(-1)
    folds = {"event_id": Fold.last(lambda r: r.event_id, "bigint"), "v": Fold.clamped_sum(cents)}
    return pipe().stage(Stateful(["user_id"], folds), Map(lambda r: {n: r[n] for n in ("event_id", "user_id", "v")})).run(events(spark, sf_dir))


def _ewma(state: dict, r: dict) -> list[dict]:
    state["v"] = r["value"] if "v" not in state else 0.9 * state["v"] + 0.1 * r["value"]
    return [{"event_id": r["event_id"], "user_id": r["user_id"], "v": state["v"]}]


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER ({W}) AS rn FROM events),
    s AS (SELECT event_id, user_id, rn, value AS v FROM e WHERE rn = 1
        UNION ALL SELECT e.event_id, e.user_id, e.rn, 0.9::DOUBLE * s.v + 0.1::DOUBLE * e.value FROM e JOIN s ON e.user_id = s.user_id AND e.rn = s.rn + 1)
    SELECT event_id, user_id, v FROM s"""
)
def stateful_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Custom(["user_id"], dict, _ewma, "event_id bigint, user_id bigint, v double")
    slim = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id, "value": r.value})
    return pipe().stage(slim, fold).run(events(spark, sf_dir))


@query("SELECT event_id, coalesce(lag(event_id) OVER (ORDER BY ts, event_id), -1) AS prev_id, lag(event_id) OVER (ORDER BY ts, event_id) IS NOT NULL AS has_prev FROM events")
def track_prev_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = Map(lambda r: {"event_id": r.event_id})
    out = pipe().stage(slim, TrackPrev()).run(events(spark, sf_dir))
    return out.select("curr.event_id", F.coalesce("prev.event_id", F.lit(-1)).alias("prev_id"), "has_prev")


@query(f"SELECT event_id, coalesce(lag(event_id) OVER ({W}), -1) AS prev_id, lag(event_id) OVER ({W}) IS NOT NULL AS has_prev FROM events")
def track_prev_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = Map(lambda r: {"event_id": r.event_id, "user_id": r.user_id})
    out = pipe().stage(slim, TrackPrev(["user_id"])).run(events(spark, sf_dir))
    return out.select("curr.event_id", F.coalesce("prev.event_id", F.lit(-1)).alias("prev_id"), "has_prev")


def journal(spark: SparkSession, sf_dir: str) -> Journal:
    """The events as a journal."""
    return Journal(load(spark, sf_dir, "events"), "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 17")
def journal_get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).get_at(17).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def journal_get_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).get_last().select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 109")
def journal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).get_window(100, 10).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN -5 AND 4 AND (SELECT count(*) FROM events WHERE event_id BETWEEN -5 AND 4) = 10")
def journal_window_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).get_window(-5, 10).select("event_id", "user_id")


@query("SELECT count(*) AS n FROM events")
def journal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).df.agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, total FROM (SELECT event_id, CAST(sum(user_id) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM events
    WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE n = 10"""
)
def journal_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).sliding(10, F.col("user_id"), "total")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def slot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("seq", F.col("event_id")).select("seq", "user_id", "event_type", "event_id")
    return Journal(rows).latest("user_id").select("user_id", "event_type", "event_id")


GAPS = f"SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({W})) * 1000 AS ns FROM events"
CUT = f"SELECT event_id, ns, least(greatest(ns, 1), 1000000000000) AS v FROM ({GAPS}) WHERE ns IS NOT NULL"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time since the user's previous event, in nanoseconds."""
    step = Delta(["user_id"], lambda c, p: (p.exists, {"event_id": c.event_id, "ns": (c.us - p.us) * 1000}))
    return pipe().stage(step).run(events(spark, sf_dir))


@query(
    f"""SELECT count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean,
    quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99,
    quantile_disc(v, 0.999) AS p999, quantile_disc(v, 0.9999) AS p9999 FROM ({CUT})"""
)
def latency_stats_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_stats(gaps(spark, sf_dir), F.col("ns")).withColumn("mean", F.round("mean", 4))


@query(f"SELECT count(*) AS n, min(v) AS min, max(v) AS max FROM ({CUT}) WHERE event_id % 7 = 0")
def latency_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps(spark, sf_dir).where(F.col("event_id") % 7 == 0)
    return latency_stats(rows, F.col("ns"), accuracy=1000).select(F.col("count").alias("n"), "min", "max")


@query(f"SELECT event_id, ns FROM ({CUT}) WHERE ns > (SELECT quantile_disc(v, 0.999) FROM ({CUT})) AND (SELECT count(*) FROM ({CUT})) >= 100")
def latency_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gaps(spark, sf_dir)
    return outliers(rows, F.col("ns"), latency_stats(rows, F.col("ns")))


def _summaries(total: str, source: str = "events") -> str:
    # the sum of a list adds up from its first value on
    return f"""SELECT user_id, bucket, ts, event_id, list_reduce(list({total}) OVER w, lambda a, b: a + b) / count(*) OVER w AS avg FROM
        (SELECT *, row_number() OVER b AS rn FROM (SELECT *, epoch_us(ts) - epoch_us(ts) % {DAY} AS bucket FROM {source})
         WINDOW b AS (PARTITION BY user_id, bucket ORDER BY ts, event_id))
        WINDOW w AS (PARTITION BY user_id, bucket ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def _alerts(summaries: str) -> str:
    return f"""SELECT user_id, bucket, 1 AS severity, ts, event_id FROM
        (SELECT *, lag(avg) OVER ({W}) AS p FROM ({summaries})) WHERE p IS NOT NULL AND avg > p * 1.5"""


E2 = "CASE WHEN rn > 1 THEN value ELSE 0.0::DOUBLE END"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of a sensor for each user."""
    return events(spark, sf_dir).select("ts", "event_id", "user_id", "value", F.col("us").alias("timestamp"))


@query(f"SELECT user_id, bucket, severity FROM ({_alerts(_summaries(E2))})")
def sensor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor.pipeline(ORDER, "user_id", DAY).run(readings(spark, sf_dir))


@query(f"SELECT user_id, bucket, severity FROM ({_alerts(_summaries('value'))})")
def sensor_alerts_true_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor.pipeline(ORDER, "user_id", DAY, true_mean=True).run(readings(spark, sf_dir))


@query(
    f"""WITH kept AS (SELECT user_id, value, ts, event_id FROM
        (SELECT *, lag(ts) OVER k AS pt, lag(value) OVER k AS pv FROM events
         WINDOW k AS (PARTITION BY user_id, CAST(trunc(value * 1000) AS BIGINT) ORDER BY ts, event_id))
        WHERE pt IS NULL OR ts <> pt OR value <> pv)
    SELECT user_id, bucket, severity FROM (SELECT *, lag(bucket) OVER ({W}) AS b FROM ({_alerts(_summaries(E2, "kept"))}))
    WHERE b IS NULL OR bucket <> b"""
)
def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.pipeline(ORDER, "user_id", DAY).run(readings(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as order-book messages of eight instruments; order ids stay in one."""
    action = F.create_map(*[F.lit(x) for x in ("signup", "A", "purchase", "A", "view", "M", "click", "C", "error", "F")])
    return events(spark, sf_dir).select(
        "event_id",
        F.col("us").alias("ts"),
        F.col("us").alias("ts_recv"),
        F.col("user_id").alias("order_id"),
        (F.col("value").cast("bigint") % 10 + 100).alias("price"),
        (F.col("event_id") % 20 + 1).alias("size"),
        (F.col("user_id") % 8).alias("instrument_id"),
        F.when(F.col("event_id") % 997 == 0, F.lit("R")).otherwise(action[F.col("event_type")]).alias("action"),
        F.when(F.col("user_id") % 16 < 8, F.lit("A")).otherwise(F.lit("B")).alias("side"),
    )


def _book(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    out = Pipeline(("ts", "event_id"))
    for ops in stages:
        out = out.stage(*ops)
    return out.run(messages(spark, sf_dir))


# Live orders one message after another (o, s), the changes they give (d), volumes (e, v),
# and the five best levels of each side as lists (f, t).
ORDERS = f"""m AS MATERIALIZED (SELECT event_id, epoch_us(ts) AS ts, user_id AS order_id, CAST(trunc(value) AS BIGINT) % 10 + 100 AS price, event_id % 20 + 1 AS size,
        user_id % 8 AS instrument_id, CASE WHEN user_id % 16 < 8 THEN 'A' ELSE 'B' END AS side, CASE WHEN event_id % 997 = 0 THEN 'R' ELSE
        CASE event_type WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'A' WHEN 'view' THEN 'M' WHEN 'click' THEN 'C' WHEN 'error' THEN 'F' END END AS action FROM events),
    c AS MATERIALIZED (SELECT *, sum(CASE WHEN action = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY ts, event_id) AS epoch FROM m),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument_id, epoch, order_id ORDER BY ts, event_id) AS rn FROM c),
    s AS (SELECT instrument_id, epoch, order_id, rn, event_id, CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS held,
            CASE WHEN action IN ('A', 'M') THEN price END AS p, CASE WHEN action IN ('A', 'M') THEN size END AS z FROM o WHERE rn = 1
        UNION ALL SELECT o.instrument_id, o.epoch, o.order_id, o.rn, o.event_id, s.p, s.z,
            CASE WHEN action IN ('A', 'M') THEN price WHEN action = 'C' OR action = 'F' AND s.z <= size THEN NULL ELSE s.p END,
            CASE WHEN action IN ('A', 'M') THEN size WHEN action = 'C' OR action = 'F' AND s.z <= size THEN NULL WHEN action = 'F' THEN s.z - size ELSE s.z END
        FROM o JOIN s ON o.instrument_id = s.instrument_id AND o.epoch = s.epoch AND o.order_id = s.order_id AND o.rn = s.rn + 1),
    d AS MATERIALIZED (SELECT m.instrument_id, m.ts, m.event_id, m.side, k.pos, m.action = 'R' AS is_clear,
            CASE WHEN m.action = 'R' THEN 0 WHEN m.action = 'M' AND k.pos = 0 AND s.was IS NOT NULL AND s.was <> m.price THEN s.was ELSE m.price END AS price,
            CASE WHEN m.action = 'R' THEN 0 WHEN m.action IN ('C', 'F') THEN -m.size WHEN m.action = 'A' OR s.was IS NULL OR k.pos = 1 THEN m.size
                WHEN s.was = m.price THEN m.size - s.held ELSE -s.held END AS delta
        FROM m JOIN s USING (event_id) JOIN (VALUES (0), (1)) AS k(pos) ON k.pos = 0 OR m.action = 'M' AND s.was IS NOT NULL AND s.was <> m.price)"""
LEVELS = f"""{ORDERS},
    b AS MATERIALIZED (SELECT *, sum(CASE WHEN is_clear THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY ts, event_id, pos) AS epoch FROM d),
    x AS MATERIALIZED (SELECT instrument_id, ts, event_id, pos, 0 AS part, epoch, side, price, delta FROM b WHERE NOT is_clear
        UNION ALL SELECT instrument_id, ts, event_id, pos, k.part, epoch, k.side, 0, 0 FROM b, (VALUES (0, 'B'), (1, 'A')) AS k(part, side) WHERE is_clear),
    e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument_id, epoch, side, price ORDER BY ts, event_id, pos, part) AS rn FROM x),
    v AS (SELECT instrument_id, epoch, side, price, rn, ts, event_id, pos, part, greatest(0, delta) AS volume FROM e WHERE rn = 1
        UNION ALL SELECT e.instrument_id, e.epoch, e.side, e.price, e.rn, e.ts, e.event_id, e.pos, e.part, greatest(0, v.volume + e.delta)
        FROM e JOIN v ON e.instrument_id = v.instrument_id AND e.epoch = v.epoch AND e.side = v.side AND e.price = v.price AND e.rn = v.rn + 1)"""


def _put(rows: str, side: str, worse: str) -> str:
    """SQL: the list of levels after a volume is put into it."""
    empty = "{'p': 0::BIGINT, 'v': 0::BIGINT}"
    new = "{'p': f.price, 'v': f.volume}"
    behind = f"(y.p = 0 OR f.price {worse} y.p)"
    return f"""CASE WHEN f.side <> '{side}' THEN {rows}
        WHEN f.price = 0 THEN {rows}
        WHEN list_contains(list_transform({rows}, lambda y: y.p), f.price) THEN CASE WHEN f.volume > 0
            THEN list_transform({rows}, lambda y: CASE WHEN y.p = f.price THEN {new} ELSE y END)
            ELSE list_append(list_filter({rows}, lambda y: y.p <> f.price), {empty}) END
        WHEN f.volume > 0 THEN list_slice(list_concat(list_append(list_filter({rows}, lambda y: NOT {behind}), {new}), list_filter({rows}, lambda y: {behind})), 1, 5)
        ELSE {rows} END"""


FIVE = "list_transform(range(5), lambda i: {'p': 0::BIGINT, 'v': 0::BIGINT})"
TOPS = f"""{LEVELS},
    f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts, event_id, pos, part) AS place FROM v),
    z AS (SELECT DISTINCT instrument_id, 0::BIGINT AS place, {FIVE} AS asks, {FIVE} AS bids FROM f),
    t AS (SELECT instrument_id, place, asks, bids, 0::BIGINT AS ts FROM z
        UNION ALL SELECT f.instrument_id, f.place, {_put("t.asks", "A", "<")}, {_put("t.bids", "B", ">")}, f.ts
        FROM f JOIN t ON f.instrument_id = t.instrument_id AND f.place = t.place + 1)"""


@query(f"WITH RECURSIVE {ORDERS} SELECT instrument_id, ts, ts AS ts_recv, CASE WHEN NOT is_clear THEN side END AS side, CAST(price AS BIGINT) AS price, CAST(delta AS BIGINT) AS delta, is_clear FROM d")
def book_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir, [[orderbook.order_tracker()]])


@query(f"WITH RECURSIVE {LEVELS} SELECT instrument_id AS symbol, ts, ts AS ts_recv, side, CAST(price AS BIGINT) AS price, CAST(volume AS BIGINT) AS volume FROM v")
def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir, [[orderbook.order_tracker()], orderbook.levels()])


def _listed(rows: str, name: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda y: CAST(y.{name} AS VARCHAR)), ',')"


@query(
    f"""WITH RECURSIVE {TOPS} SELECT instrument_id AS symbol, ts, ts AS ts_recv, {_listed("asks", "p")} AS ask_price, {_listed("asks", "v")} AS ask_size,
    {_listed("bids", "p")} AS bid_price, {_listed("bids", "v")} AS bid_size FROM t WHERE place > 0"""
)
def book_top_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best levels, lists joined by commas."""
    out = _book(spark, sf_dir, [[orderbook.order_tracker()], orderbook.levels(), [orderbook.top_levels()]])
    lists = ("ask_price", "ask_size", "bid_price", "bid_size")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


def _weighted(rows: str) -> str:
    return " + ".join(f"{rows}[{i + 1}].v * {w}::DOUBLE" for i, w in enumerate(orderbook.WEIGHTS))


@query(
    f"""WITH RECURSIVE {TOPS}, w AS (SELECT instrument_id, ts, {_weighted("bids")} AS bid_vol, {_weighted("asks")} AS ask_vol FROM t WHERE place > 0)
    SELECT instrument_id AS symbol, ts, ts AS ts_recv, (bid_vol - ask_vol) / (bid_vol + ask_vol) AS imbalance, bid_vol, ask_vol FROM w WHERE bid_vol + ask_vol > 0"""
)
def book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderbook.pipeline(("ts", "event_id")).run(messages(spark, sf_dir))
