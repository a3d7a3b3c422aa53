"""Toxicity: a linear classifier over character n-grams with NB-scaled features.

A feature is the presence of a hashed character n-gram. Its value is the naive
Bayes log-count ratio of the n-gram between toxic and other documents, and a
logistic regression weighs the scaled features. N-grams whose shares differ most
significantly between the classes are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, chunks, frugal

GRAMS = (3, 4, 5)
BUCKETS = 1 << 20
#: Between the texts of a chunk, so that no n-gram spans two of them.
GAP = "\0" * (max(GRAMS) - 1)


@dataclass
class Model:
    """Sparse weights over buckets: a text's logit is bias plus those present."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def buckets_of(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document at each place (-1 between texts), and the bucket of the n-gram from
    there on, for each n; the last ones of a text run on into what follows it."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((GAP.join(lowered) + GAP).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.column_stack([np.arange(len(texts)), np.full(len(texts), -1)]).ravel(), [k for t in lowered for k in (len(t), len(GAP))])
    state = points.copy()
    out = []
    for n in range(2, max(GRAMS) + 1):
        state = state[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in GRAMS:
            mixed = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            out.append(mixed >> np.uint32(12))
    return owner, out


def present(texts: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) once for each wanted bucket present; ``wanted`` is a mask."""
    owner, found = buckets_of(texts)
    pairs = [np.zeros(0, np.int64)]
    for b in found:
        at = np.flatnonzero(wanted[b])
        at = at[owner[at] >= 0]
        pairs.append(owner[at] * BUCKETS + b[at])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // BUCKETS, pairs % BUCKETS


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps over sparse rows."""
    w, bias = np.zeros(n), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    # a bound on the curvature: a quarter of the largest squared row norm
    norms = np.bincount(rows, values**2, len(y))
    rate = 4 / (norms.mean() * 4 + 1) / len(y)
    ahead, ahead_b, t = w.copy(), bias, 1.0
    before, rise = np.inf, 0
    for _ in range(steps):
        z = np.bincount(rows, values * ahead[cols], len(y)) + ahead_b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum() + l2 / 2 * (ahead**2).sum()
        if loss > before:  # too long a step
            rate, rise = rate / 2, rise + 1
            ahead, ahead_b, t = w.copy(), bias, 1.0
            before = np.inf
            continue
        before = loss
        g = p - y
        new = ahead - rate * (np.bincount(cols, values * g[rows], n) + l2 * ahead)
        new_b = ahead_b - rate * g.sum()
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        k = (last - 1) / t
        ahead, ahead_b = new + k * (new - w), new_b + k * (new_b - bias)
        w, bias = new, new_b
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", rows_per_class: int = 4000, features: int = 4096, smoothing: float = 1.0, l2: float = 1.0, steps: int = 150) -> Model:
    """A model from the texts of ``docs`` whose id has a label 0 or 1 in ``labels``.

    Other labels and null ids are left out; of several labels of an id the largest
    counts. The ``rows_per_class`` ids of each class that come first by hash are
    used; that many go to every task, to pick their texts without a shuffle.
    Counts of n-grams are aggregated over tasks; the driver gets the counts of the
    ``features`` most significant n-grams and which sampled row has which of them,
    both bounded by the parameters. With one class only, or none, the score is
    constant: that class, or 0.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    first = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for y in (0, 1)]
    wanted = F.broadcast(first[0].union(first[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, math.ceil(2 * rows_per_class / 2000))
    sample = checkpoint(rows.join(wanted, "id").select("text", "y").repartition(parts))
    total = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 10.0 if 1 in total else -10.0)
    n1, n0 = total[1], total[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        every = np.ones(BUCKETS, bool)
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for i, j in chunks([len(t) for t in texts]):
                owner, b = present(texts[i:j], every)
                toxic = y[i:j][owner] == 1
                for k in (0, 1):
                    seen[k] += np.bincount(b[toxic == k], minlength=BUCKETS).astype(np.int32)
        b = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(b), pa.array(seen[1, b]), pa.array(seen[0, b])], ["b", "n1", "n0"])

    counts = sample.mapInArrow(frugal(count), "b long, n1 int, n0 int").groupBy("b").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    share = (F.col("n1") + F.col("n0")) / float(n1 + n0)
    z = F.abs(F.col("n1") / float(n1) - F.col("n0") / float(n0)) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    top = counts.select("b", "n1", "n0", z.alias("z")).orderBy(F.desc("z"), "b").limit(features).collect()
    buckets = np.array(sorted(r.b for r in top), np.int64)
    by = {r.b: (r.n1, r.n0) for r in top}
    # smoothing in proportion to the classes: an n-gram that was not seen has ratio 1
    ratio = np.array([math.log((by[b][0] + smoothing * n1 / (n1 + n0)) / (n1 + smoothing)) - math.log((by[b][1] + smoothing * n0 / (n1 + n0)) / (n0 + smoothing)) for b in buckets.tolist()])

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[buckets] = True
        for batch in batches:
            texts, y = batch.column(0).to_pylist(), batch.column(1)
            found: list[list[int]] = []
            for i, j in chunks([len(t) for t in texts]):
                owner, b = present(texts[i:j], wanted)
                cols = np.searchsorted(buckets, b)
                found += [c.tolist() for c in np.split(cols, np.searchsorted(owner, np.arange(1, j - i)))]
            yield pa.record_batch([y, pa.array(found, pa.list_(pa.int32()))], ["y", "cols"])

    seen = sample.mapInArrow(frugal(spot), "y int, cols array<int>").toPandas()
    y = seen.y.to_numpy(float)
    rows_at = np.repeat(np.arange(len(seen)), [len(c) for c in seen.cols])
    cols = np.concatenate([np.asarray(c, np.int64) for c in seen.cols]) if len(seen) else np.zeros(0, np.int64)
    w, bias = _logistic(rows_at, cols, ratio[cols], y, len(buckets), l2, steps)
    return Model(buckets, w * ratio, bias)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """(id, score, predicted) and the columns ``keep`` for every row.

    ``score`` is the probability of the toxic class from the whole text; a null
    text counts as empty, and an empty one gets the score of no n-gram at all.
    """
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"), *(keep or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
        weight[model.buckets], wanted[model.buckets] = model.weights, True
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            logit = np.full(len(texts), model.bias)
            for i, j in chunks([len(t) for t in texts]):
                owner, b = present(texts[i:j], wanted)
                logit[i:j] += np.bincount(owner, weight[b], j - i)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.record_batch([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    return chosen.mapInArrow(frugal(run), chosen.drop("_text").schema.add("score", "double").add("predicted", "integer"))
