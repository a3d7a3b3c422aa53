"""A corpus pipeline: documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
``run`` writes each result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontaminate, language, pii, sentencepiece, simhash
from tidefold.llm.common import delete, load, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose cosine with the nearest language is lower are in no known one.
LEAST_COSINE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or unlike every language of the corpus."""
    return language.keep_known(docs, language.fit(docs), LEAST_COSINE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars``, if there is such a column, is counted anew."""
    out = pii.redact(docs, pii.fit(spark, docs))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    found = sentencepiece.encode(docs, sentencepiece.read_model())
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot state near-duplicates, alignment and sampling.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result, the only table that stays."""
    docs, before = load(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
