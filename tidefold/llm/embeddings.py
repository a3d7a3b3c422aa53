"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, so a cosine bound is a bound on the Euclidean
distance (epsilon). Equal vectors of a label are folded into one representative.
Representatives are put in epsilon grid order: sorted by label and by the grid
cell of their coordinates on leading principal dimensions. The sorted sequence is
cut into intervals that carry their bounding boxes. Two intervals meet only if they
share a label and a neighbourhood of cells on several dimensions, and their boxes are
within epsilon. They are joined recursively, by halving both, level by level; every
pair of parts whose boxes are provably farther apart is dropped. Pairs of vectors in
what is left are compared by their exact cosine.

Intervals lie in groups of consecutive ones, and a task joins two groups: each interval
travels once to every group that holds a partner of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, discard, frugal, stored
from tidefold.llm.graph import components, spanning_forest

#: Vectors that the principal dimensions are fitted on, at most.
FIT_ROWS = 4096
#: Leading principal dimensions of the grid, and those of them whose cells intervals meet on.
GRID_DIMS = 8
CELL_DIMS = 3
#: Numbers in an interval, and intervals in a group.
INTERVAL_NUMBERS = 1 << 17
GROUP = 8
#: Vectors in an interval that is compared outright.
LEAF = 32
#: Pairs of parts looked at together.
PARTS = 1 << 16


def _usable(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & sound & F.exists(wide, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe from overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Orthonormal directions of most variance, largest first, as columns."""
    centred = vectors - vectors.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :dims]


def _halved(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The boxes of an interval's parts by level, leaves first: (starts, lows, highs).

    A leaf has ``LEAF`` vectors, a part of the next level two parts of the one below.
    """
    starts = np.arange(0, len(points), LEAF)
    out = [(starts, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))]
    while len(out[-1][0]) > 1:
        below, low, high = out[-1]
        pick = np.arange(0, len(below), 2)
        out.append((below[pick], np.minimum.reduceat(low, pick), np.maximum.reduceat(high, pick)))
    return out


def ego_join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``x`` and ``y`` (unit vectors) with at least ``cosine``.

    ``px`` and ``py`` are their coordinates on the grid dimensions. If ``same``,
    both are one sequence and each pair comes once.
    """
    reach = epsilon_of(cosine) ** 2
    left, right = _halved(px), _halved(py)
    top = max(len(left), len(right)) - 1
    work = [(top, np.zeros(1, int), np.zeros(1, int))]
    while work:
        level, i, j = work.pop()
        (_, low, high), (_, low2, high2) = left[min(level, len(left) - 1)], right[min(level, len(right) - 1)]
        gap = np.maximum(0, np.maximum(low[i] - high2[j], low2[j] - high[i]))
        near = (gap * gap).sum(axis=1) <= reach
        i, j = i[near], j[near]
        if not len(i):
            continue
        if level:
            # both sides are halved, each while it has halves
            i, j = _children(i, left, level), _children(j, right, level)
            a = np.repeat(i, 2, axis=1).ravel()
            b = np.tile(j, 2).ravel()
            real = (a >= 0) & (b >= 0)
            if same:
                real &= a <= b
            a, b = a[real], b[real]
            work += [(level - 1, a[k : k + PARTS], b[k : k + PARTS]) for k in range(0, len(a), PARTS)]
        else:
            yield from _compared(x, y, i, j, cosine, same)


def _children(at: np.ndarray, levels: list, level: int) -> np.ndarray:
    """The two parts below of each part, -1 for one that is not there."""
    if level >= len(levels):  # the whole interval stands for itself
        return np.stack([at, np.full(len(at), -1)], axis=1)
    both = np.stack([2 * at, 2 * at + 1], axis=1)
    return np.where(both < len(levels[level - 1][0]), both, -1)


def _compared(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The close pairs of leaf pairs; a leaf meets all its partners at once."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    cuts = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1, [len(i)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a = int(i[lo]) * LEAF
        b = (j[lo:hi, None] * LEAF + np.arange(LEAF)).ravel()
        b = b[b < len(y)]
        p, q = np.nonzero(x[a : a + LEAF] @ y[b].T >= cosine)
        p, q = p + a, b[q]
        if same:
            p, q = p[p < q], q[p < q]
        if len(p):
            yield p, q


def epsilon_of(cosine: float) -> float:
    """The distance of unit vectors at a cosine, and a little for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component, kept) for every row.

    Rows link when their labels are equal and not null and the cosine of their
    vectors, in double precision, is ``cosine`` or more. Vectors that are null,
    empty, all zero or hold null or non-finite components link with nothing, and
    so do vectors of different length. ``component`` is the smallest id reached,
    the own one included; ``kept`` marks that id. Repeated rows link like copies;
    rows with a null id count as links of others and get their component.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    usable = _usable(F.col("v")) & F.col("label").isNotNull()
    sound, odd = base.where(usable), base.where(~F.coalesce(usable, F.lit(False)))
    # a representative's name is its place in a table that is written once
    reps = checkpoint(
        sound.groupBy("label", "v")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"rep": F.monotonically_increasing_id(), "dim": F.size("v")})
    )
    axes = {
        dim: principal_axes(unit(np.array([r.v for r in reps.where(F.col("dim") == dim).orderBy(F.xxhash64("v"), "rep").limit(FIT_ROWS).collect()], float)), GRID_DIMS)
        for dim in sorted(r.dim for r in reps.select("dim").distinct().collect())
    }
    found = _links(reps, axes, cosine)
    edges = found.select("a", "b").where("a is not null")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(edges)
    named = reps.select("label", "v", "rep", "least", "copies").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = named.withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = checkpoint(named.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component"))
    discard(found, roots)
    out = sound.join(classes, ["label", "v"]).select("id", F.col("links").cast("long").alias("n_links"), "component")
    out = out.unionByName(odd.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def _links(reps: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(rep, n) partial link counts and (a, b) edges that span the components, stored."""
    epsilon = epsilon_of(cosine)
    kind = reps.schema["v"].dataType.simpleString()
    label = reps.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            vectors = batch.column(1).to_pylist()
            cells: list[list[int]] = [[]] * len(vectors)
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                points = unit(np.array([vectors[i] for i in where], float)) @ axes[int(dim)]
                for i, c in zip(where, np.floor(points / epsilon).astype(np.int64).tolist(), strict=True):
                    cells[i] = c
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cell"])

    placed = reps.select("label", "v", "rep", "copies", "dim").mapInArrow(frugal(place), f"label {label}, v {kind}, rep long, copies long, dim int, cell array<bigint>")
    ordered = placed.repartitionByRange("label", "dim", "cell", "rep").sortWithinPartitions("label", "dim", "cell", "rep")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.array([r["v"] for r in held], float)
            points = unit(x) @ axes[held[0]["dim"]]
            yield pa.RecordBatch.from_pylist(
                [{
                    "part": held[0]["part"], "number": number, "label": held[0]["label"], "dim": held[0]["dim"],
                    "low": points.min(0).tolist(), "high": points.max(0).tolist(),
                    "reps": [r["rep"] for r in held], "copies": [r["copies"] for r in held], "data": x.tobytes(),
                }],
                schema=shape,
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) * row["dim"] >= INTERVAL_NUMBERS or (row["label"], row["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield from flush()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield from flush()

    def arrow_label() -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(reps.schema["label"].dataType)

    shape = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("label", arrow_label()), ("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
        + [("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("data", pa.binary())]
    )
    # range bounds come from a sample, so the intervals are written before they are met with each other
    intervals = stored(ordered.mapInArrow(frugal(cut), f"part int, number int, label {label}, dim int, low array<double>, high array<double>, reps array<bigint>, copies array<bigint>, data binary"))
    name = F.struct("part", "number")
    group = F.struct("part", F.expr(f"number div {GROUP}").alias("number"))

    # an interval is in the cells of the first dimensions that its box touches, and meets those beside them
    def cells(beside: int) -> Column:
        def longer(cells: Column, d: int) -> Column:
            low, high = F.get("low", F.lit(d)), F.get("high", F.lit(d))
            here = F.sequence(F.floor(low / epsilon) - beside, F.floor(high / epsilon) + beside)
            return F.flatten(F.transform(cells, lambda cell: F.transform(here, lambda c: F.array_append(cell, c))))

        out = F.array(F.array().cast("array<bigint>"))
        for d in range(CELL_DIMS):
            out = F.when(F.size("low") > d, longer(out, d)).otherwise(out)
        return out

    boxes = intervals.select(name.alias("i"), group.alias("gi"), "label", "dim", "low", "high", F.explode(cells(0)).alias("cell"))
    other = intervals.select(
        name.alias("j"), group.alias("gj"), "label", "dim", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(cells(1)).alias("cell"),
    )
    gap = F.zip_with(
        F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))
    )
    distance = F.aggregate(gap, F.lit(0.0), lambda t, g: t + g * g)
    meets = boxes.join(other, ["label", "dim", "cell"]).where((F.col("i") <= F.col("j")) & (distance <= epsilon * epsilon))
    meets = meets.select("i", "j", "gi", "gj").distinct()
    # what a task is sent: the first and second intervals of a pair of groups, with their partners
    first = meets.groupBy("gi", "gj", "i").agg(F.collect_list("j").alias("partners")).select("gi", "gj", F.col("i").alias("name"), "partners")
    second = meets.select("gi", "gj", F.col("j").alias("name"), F.lit(None).cast("array<struct<part:int,number:int>>").alias("partners")).distinct()
    body = intervals.select(name.alias("name"), "dim", "reps", "copies", "data")
    sent = first.unionByName(second).join(body, "name")
    sent = sent.select(F.xxhash64("gi", "gj").alias("pair"), "name", "partners", "dim", "reps", "copies", "data")
    sent = sent.withColumn("side", F.when(F.col("partners").isNull(), 0).otherwise(1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, _Tile(axes, cosine)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if row["pair"] != at:
                    yield from tile.result()
                    at, tile = row["pair"], _Tile(axes, cosine)
                tile.add(row)
        yield from tile.result()

    dealt = sent.repartition("pair").sortWithinPartitions("pair", "side", "name")
    out = stored(dealt.mapInArrow(frugal(compare), "rep long, n long, a long, b long"))
    discard(intervals)
    return out


class _Tile:
    """Joins the intervals of a pair of groups: second ones come first and are held, a
    group's worth; first ones meet them one by one."""

    def __init__(self, axes: dict[int, np.ndarray], cosine: float) -> None:
        self.axes, self.cosine = axes, cosine
        self.held: dict[tuple[int, int], tuple] = {}
        self.n: dict[int, int] = {}
        self.links = np.zeros((2, 0), np.int64)

    def add(self, row: dict) -> None:
        """An interval of the tile."""
        key = (row["name"]["part"], row["name"]["number"])
        x = unit(np.frombuffer(row["data"]).reshape(-1, row["dim"]))
        mine = x, x @ self.axes[row["dim"]], np.array(row["reps"], np.int64), np.array(row["copies"], np.int64)
        if row["partners"] is None:
            self.held[key] = mine
            return
        x, px, reps, copies = mine
        for p in row["partners"]:
            other = (p["part"], p["number"])
            y, py, reps2, copies2 = self.held[other]
            for i, j in ego_join(x, y, px, py, self.cosine, key == other):
                self._count(reps[i], copies2[j])
                self._count(reps2[j], copies[i])
                self.links = np.hstack([self.links, [reps[i], reps2[j]]])
                if self.links.shape[1] > 1 << 16:
                    self.links = np.array(spanning_forest(*self.links))

    def _count(self, reps: np.ndarray, more: np.ndarray) -> None:
        names, at = np.unique(reps, return_inverse=True)
        for r, k in zip(names.tolist(), np.bincount(at, more).astype(np.int64).tolist(), strict=True):
            self.n[r] = self.n.get(r, 0) + k

    def result(self) -> Iterator[pa.RecordBatch]:
        """Partial counts, and edges that span what is linked here."""
        if not self.n:
            return
        a, b = spanning_forest(*self.links)
        none, more = pa.nulls(len(a), pa.int64()), pa.nulls(len(self.n), pa.int64())
        columns = [[pa.array(list(self.n), pa.int64()), none], [pa.array(list(self.n.values()), pa.int64()), none], [more, pa.array(a)], [more, pa.array(b)]]
        yield pa.record_batch([pa.concat_arrays(c) for c in columns], ["rep", "n", "a", "b"])
