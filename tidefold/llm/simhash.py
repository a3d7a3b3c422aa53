"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits.

Fingerprints are computed row by row. Equal ones are folded into one row each
by a partial aggregation, so a group of copies of any size costs one row from
there on. Distinct fingerprints are dealt to buckets by every choice of exact
blocks that a close pair must share (pigeonhole), and each task lays a Gray-order
hierarchical index over its rows: codes sorted by Gray rank, groups of them under
a node that keeps the bits all its codes share. Two nodes can hold a close pair
only if their shared bits differ in few places, so the descent drops whole groups
of pairs. The links found leave a task as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, chunks, discard, frugal, utf8
from tidefold.llm.graph import components, spanning_forest
from tidefold.llm.hashing import xxh64

#: Codes under a node of the index, and nodes under an upper node.
FAN = 8
#: Node pairs held at once in the descent.
FRONTIER = 1 << 18
#: Rows of one side in a task; larger buckets are joined slice by slice.
SLICE = 1024


def fingerprints_of(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """One uint64 a text; see ``fingerprints``."""
    out = np.zeros(len(texts), np.uint64)
    words = [(t or b"").lower().split() for t in texts]
    flat = b" ".join(b" ".join(w) for w in words if w)
    if not flat:
        return out
    data = np.frombuffer(flat, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.array([len(w) for w in words])
    full = np.flatnonzero(counts)
    n = np.maximum(counts[full] - shingle + 1, 1)  # a short text is one shingle
    first = np.cumsum(counts[full]) - counts[full]
    base = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(base - first, n)
    last = np.minimum(at + shingle - 1, np.repeat(first + counts[full] - 1, n))
    h = xxh64(flat, starts[at], ends[last])
    for i, k, m in zip(full, base, n, strict=True):
        bits = np.unpackbits(h[k : k + m].view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
        over = bits.sum(axis=0, dtype=np.int64) * 2 > m
        out[i] = np.packbits(over, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, text_hash, fp): the SimHash of each whole text as a signed 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are
    ``shingle`` words joined by a blank, repeats included; a shorter text is one
    shingle, a text without words (empty, null) has fingerprint zero. A bit is set
    if it is set in over half the XXH64 (seed 42) values, so a tie leaves it
    unset. Repeated ids keep a row each; null ids stay null. ``text_hash`` tells apart the
    texts of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            fp = np.zeros(len(texts), np.uint64)
            for i, j in chunks([len(t or b"") for t in texts]):
                fp[i:j] = fingerprints_of(texts[i:j], shingle)
            yield pa.record_batch([*batch.columns[:2], pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text).alias("text_hash"), text.alias("text"))
    return chosen.mapInArrow(frugal(run), "id long, text_hash long, fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(bucket: np.ndarray, codes: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The index, leaves first. Nodes never mix buckets; a node's children are consecutive."""
    level = {"bucket": bucket, "ones": codes, "zeros": ~codes, "first": np.arange(len(codes)), "n": np.ones(len(codes), int)}
    out = [level]
    while True:
        _, begin, size = np.unique(level["bucket"], return_index=True, return_counts=True)
        if size.max(initial=0) <= 1:
            return out
        inside = np.arange(len(level["bucket"])) - np.repeat(begin, size)
        first = np.flatnonzero(inside % FAN == 0)
        level = {
            "bucket": level["bucket"][first],
            "ones": np.bitwise_and.reduceat(level["ones"], first),
            "zeros": np.bitwise_and.reduceat(level["zeros"], first),
            "first": first,
            "n": np.diff(np.append(first, len(inside))),
        }
        out.append(level)


def close_pairs(bucket: np.ndarray, codes: np.ndarray, side: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of codes of one bucket that differ in ``bits`` places at most.

    ``side`` is 0, or marks the two slices of a bucket: there, only pairs across
    are wanted (1 with 2), as each slice meets itself elsewhere.
    """
    order = np.lexsort((gray_rank(codes), bucket))
    codes, side = codes[order], side[order]
    levels = _levels(bucket[order], codes)
    top = np.arange(len(levels[-1]["bucket"]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        level = levels[depth]
        if not depth:
            keep = (a < b) & ((side[a] != side[b]) | (side[a] == 0))
            if keep.any():
                yield codes[a[keep]], codes[b[keep]]
            continue
        below = levels[depth - 1]
        for i in range(0, len(a), FRONTIER // FAN**2):
            x, y = a[i : i + FRONTIER // FAN**2], b[i : i + FRONTIER // FAN**2]
            grid = np.arange(FAN)
            left = np.repeat(level["first"][x][:, None] + grid, FAN, axis=1)
            right = np.tile(level["first"][y][:, None] + grid, (1, FAN))
            real = np.repeat(grid < level["n"][x][:, None], FAN, axis=1) & np.tile(grid < level["n"][y][:, None], (1, FAN))
            real &= left <= right
            p, q = left[real], right[real]
            apart = (below["ones"][p] & below["zeros"][q]) | (below["zeros"][p] & below["ones"][q])
            near = np.bitwise_count(apart) <= bits
            if near.any():
                stack.append((depth - 1, p[near], q[near]))


def _blocks(n: int, bits: int) -> list[int]:
    """Masks such that codes ``bits`` apart agree on one of them at least.

    64 bits are cut into blocks, and a mask joins all but ``bits`` of them; there
    are as many blocks as keep a mask's values rarer than the codes.
    """
    for blocks in range(bits + 1, bits + 5):
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        if n <= 64 << (64 * (blocks - bits) // blocks):
            break
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(codes: DataFrame, bits: int = 3, slice_rows: int = SLICE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs ``bits`` apart at most.

    ``codes`` has distinct ``fp``. A bucket of over ``slice_rows`` codes is cut
    into slices; each pair of slices is a task's work of its own, so no task
    holds a large bucket and no pair is lost.
    """
    masks = _blocks(codes.count(), bits)
    table = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    dealt = codes.select("fp", F.explode(table).alias("key")).select("fp", "key.k", "key.v")
    sizes = dealt.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = sizes.select("k", "v", F.ceil(F.col("n") / slice_rows).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("fp", F.lit("slice")), F.col("cuts")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.struct(F.least(F.col("s"), j).alias("i"), F.greatest(F.col("s"), j).alias("j")),
    )
    rows = (
        dealt.join(cut, ["k", "v"])
        .withColumn("s", mine)
        .withColumn("meet", F.explode(meets))
        .select(
            F.xxhash64("k", "v", "meet.i", "meet.j").alias("bucket"),
            F.when(F.col("meet.i") == F.col("meet.j"), 0).otherwise(F.when(F.col("s") == F.col("meet.i"), 1).otherwise(2)).alias("side"),
            "fp",
        )
        .repartition("bucket")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for bucket, side, fp in _whole_buckets(batches):
            for a, b in close_pairs(bucket, fp.view(np.uint64), side, bits):
                held.append(np.array([a.view(np.int64), b.view(np.int64)]))
                if sum(x.shape[1] for x in held) > 4 * FRONTIER:
                    held = [np.array(spanning_forest(*np.hstack(held)))]
        if held:
            a, b = spanning_forest(*np.hstack(held))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.sortWithinPartitions("bucket").mapInArrow(frugal(run), "a long, b long")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, side, fp) of some ``FRONTIER`` rows at a time, a bucket's rows together.

    Rows come sorted by bucket, and a bucket has two slices at most, so what is held
    does not grow with the partition.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(n).to_numpy() for n in ("bucket", "side", "fp")))
        size += batch.num_rows
        if size >= FRONTIER:
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield tuple(c[:cut] for c in rows)
            held, size = [tuple(c[cut:] for c in rows)], len(rows[0]) - cut
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _classes(prints: DataFrame, bits: int) -> DataFrame:
    """(fp, least, root): the least (id, text_hash) of each fingerprint, null ids last,
    and the name of the fingerprint's component."""
    least = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    codes = checkpoint(prints.groupBy("fp").agg(least.alias("least")))
    roots = components(links(codes, bits))
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    out = checkpoint(named.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    discard(roots)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(id, fp, component): the smallest id that each row reaches by links.

    Rows link when their fingerprints differ in ``bits`` places at most; texts
    without words share fingerprint zero and link like any other. Null ids take
    part, and a component of null ids only is null. No rows give no rows.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    named = _classes(prints, bits)
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    classes = named.join(least, "root").select("fp", F.col("first.id").alias("component"))
    return prints.select("id", "fp").join(classes, "fp").select("id", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row of each near-duplicate group, all columns: that of the smallest id.

    Rows are known by id and text: those of one id with texts of different groups
    stand for themselves, and of rows that repeat both, one stays. Rows without an id
    come last in their group; if it has no other, the one whose text has the
    least hash stays. The texts are shuffled once, to meet the survivors' names.
    """
    names = [_free(n, docs) for n in ("_unnamed", "_id", "_text_hash", "_place")]
    keys, number = names[:3], names[3]

    def named(unnamed: Column, id_: Column, text_hash: Column) -> dict[str, Column]:
        """The keys without nulls, so that the join and the numbering share one shuffle."""
        return dict(zip(keys, (unnamed, F.coalesce(id_, F.lit(0)), text_hash), strict=True))

    prints = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    first = _classes(prints, bits).groupBy("root").agg(F.min("least").alias("first")).select("first.*")
    first = first.select(*[c.alias(n) for n, c in named(F.col("unnamed"), F.col("id"), F.col("text_hash")).items()])
    id_ = F.col(id_col).cast("long")
    kept = docs.withColumns(named(id_.isNull(), id_, _text_hash(F.col(text_col).cast("string")))).join(first, keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return kept.withColumn(number, place).where(F.col(number) == 1).select(*docs.columns)


def _free(name: str, docs: DataFrame) -> str:
    """``name``, longer if ``docs`` has such a column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
