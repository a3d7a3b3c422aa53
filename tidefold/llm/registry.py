"""The queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontaminate, embeddings, language, licenses, pii, quality, sentencepiece, simhash, substrings, toxicity
from tidefold.llm.common import fold_of, load


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five labelled folds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, load(spark, sf_dir, "labels").where(~held))
    found = toxicity.predict(docs, model, keep=[held.alias("held_out")])
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    docs = load(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(spark, docs))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, its language the path."""
    docs = load(spark, sf_dir, "documents")
    learn = F.coalesce(fold_of(F.col("doc_id"), 5) != 0, F.lit(False))
    found = quality.score(docs, load(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), learn=learn)
    return found.withColumnRenamed("id", "doc_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of earlier ones."""
    found = substrings.remove_repeats(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    prototypes = language.fit(docs.where(~held))
    found = language.predict(docs, prototypes, keep=[held.alias("held_out")])
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or edited."""
    found = decontaminate.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "first_word", "n_words")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    found = sentencepiece.encode(load(spark, sf_dir, "documents"), sentencepiece.read_model())
    return found.withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence text and notices of every document."""
    found = licenses.scan(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "digest", "license", F.array_join("notices", ",").alias("notices"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every embedding."""
    found = embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query(spark, sf_dir)."""
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii": op2_pii,
        "op3_quality": op3_quality,
        "op4_substrings": op4_substrings,
        "op5_language": op5_language,
        "op6_decontaminate": op6_decontaminate,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_licenses": op8_licenses,
        "op9_simhash": op9_simhash,
        "op10_embeddings": op10_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB, for the queries that SQL can state."""
    return {"op8_licenses": licenses.oracle()}
