"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import discard, frugal, stored

#: Edges that one task finishes; more are contracted first.
FEW = 1 << 20


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) with the components of the edges ``a``-``b``.

    Roots are the smallest members. Used inside a task, so that a dense group
    leaves it as one edge a member.
    """
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(x):
        low = np.minimum(label[x], label[y])
        best = label.copy()
        np.minimum.at(best, label[x], low)
        np.minimum.at(best, label[y], low)
        while True:
            jumped = best[best]
            if np.array_equal(jumped, best):
                break
            best = jumped
        label = best[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    member = np.flatnonzero(label != np.arange(len(names)))
    return names[label[member]], names[member]


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges (a, b) as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = np.append(a, batch.column(0).to_numpy()), np.append(b, batch.column(1).to_numpy())
            if len(a) > FEW:
                a, b = spanning_forest(a, b)
        a, b = spanning_forest(a, b)
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.mapInArrow(frugal(run), "a long, b long")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node.

    Each round hooks every node to its smallest neighbour, halves the paths that
    gives, and contracts the edges to the roots found, so edges shrink by a
    factor a round and a chain takes a logarithmic number of rounds. All steps
    are aggregations with partial sums and joins that can be split when skewed;
    nothing is gathered. ``few`` edges that are left, 16 MB, are finished by one
    task. Null ends and loops are ignored. The result is a table that ``discard``
    takes.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    live = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while (left := live.count()) > few:
        if labels is None:
            labels = stored(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().select("node", F.col("node").alias("root")))
        # the smallest neighbour of each node; nodes without a smaller one are roots
        near = stored(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        up = near
        for _ in range(3):
            above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = up.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        up = stored(up)
        before = live, labels
        labels = stored(_raised(labels, "root", up))
        ends = _raised(_raised(live, "a", up), "b", up).where("a != b")
        live = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(near, up, *before)
    last = _forest(live.coalesce(1)) if left else live
    roots = last.select(F.col("b").alias("node"), F.col("a").alias("up"))
    if labels is None:
        out = stored(roots.unionByName(last.select(F.col("a").alias("node"), F.col("a").alias("up")).distinct()).select("node", F.col("up").alias("root")))
        discard(live)
    else:
        out = stored(_raised(labels, "root", roots))
        discard(live, labels)
    return out


def _raised(df: DataFrame, name: str, up: DataFrame) -> DataFrame:
    named = up.select(F.col("node").alias(name), F.col("up").alias("_up"))
    return df.join(named, name, "left").withColumn(name, F.coalesce("_up", name)).drop("_up")
