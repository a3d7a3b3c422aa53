"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text and rows handled at once by vectorised code, to bound its memory.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 256
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir``; its session gets Arrow batches of bounded size."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is missing, a local session
    gets a temporary folder, and a cluster an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidefold-")
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder.

    The shuffle files that made the frame go at once; ``df`` itself is not to be run again.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _drop_shuffles(df)
    return out


def _drop_shuffles(df: DataFrame) -> None:
    """Removes the shuffle files of a frame that was run, instead of leaving them until the
    driver collects its garbage."""
    held = df.sparkSession.sparkContext._jsc.sc().cleaner()
    if not held.isDefined():
        return
    plans = [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif kind == "ReusedExchangeExec":
            continue
        elif kind == "ShuffleExchangeExec":
            held.get().doCleanupShuffle(plan.shuffleDependency().shuffleId(), True)
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder as Parquet and read again.

    Unlike a checkpoint it has the size of what was written, so estimates do not
    multiply from round to round of an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark can write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Removes the tables of frames that ``stored`` gave and nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, whose worker gives its free memory back at the end.

    Workers outlive their tasks, and several share an executor's memory.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have no fold."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(sizes: list[int], most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``rows`` items and ``most`` bytes at most, one item at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows from the driver, by way of one literal and no Python worker."""
    kind = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in (c.split() for c in schema.split(", "))) + ">>"
    table = F.from_json(F.lit(json.dumps(rows)), kind)
    return spark.range(1).select(F.explode(table).alias("r")).select("r.*")
