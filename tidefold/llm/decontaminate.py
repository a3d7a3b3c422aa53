"""Benchmark decontamination: n-gram seeds, then local alignment.

Every word n-gram of a test item is a seed, whatever its frequency, so what is found
does not depend on the size of the corpus. A document that holds a seed and, around
it, enough words of the item for the threshold is aligned with the item there by
Smith-Waterman over words, so edited and paraphrased copies keep a high score. The
items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import chunks, frugal, utf8

#: Words of items in a block; a block travels to every task, so this bounds it.
BLOCK_WORDS = 1 << 18
#: Alignment cells (lanes x columns) held at once.
LANES = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, in order, and the number of words of each.

    Words are runs of ASCII letters and digits and of any bytes beyond ASCII;
    A-Z count as a-z.
    """
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _WORD[flat]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word's polynomial from prefix sums would overflow its order; fold by steps of its length instead
    h = np.full(len(starts), np.uint64(1469598103934665603))
    size = ends - starts
    low = _LOWER[flat].astype(np.uint64)
    live = np.arange(len(starts))
    step = 0
    while len(live):
        h[live] = (h[live] ^ low[starts[live] + step]) * np.uint64(1099511628211)
        step += 1
        live = live[size[live] > step]
        if step >= 64 and len(live):  # the few long words: whole, one by one
            for w in live:
                h[w] = np.uint64(hash_bytes(low[starts[w] : ends[w]].astype(np.uint8).tobytes()))
            break
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return _mix(h), counts


def hash_bytes(data: bytes) -> int:
    """A 64-bit hash of one long word."""
    import xxhash

    return xxhash.xxh64_intdigest(data, 7)


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 places are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : len(words) - n + 1 + k]
    return _mix(out)


@dataclass
class Items:
    """A block of test items: words one after another, and n-grams with their places."""

    ids: list[int | None]
    starts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    gram_item: np.ndarray
    gram_at: np.ndarray


def items_of(ids: list[int | None], texts: list[bytes], n: int) -> Items:
    """Items shorter than n words have one gram less than none and are never seeded."""
    words, sizes = words_of(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, int))
    starts = np.cumsum(sizes) - sizes
    parts = [grams_of(words[s : s + k], n) for s, k in zip(starts, sizes, strict=True)]
    each = [len(p) for p in parts]
    return Items(
        ids, starts, sizes, words,
        np.concatenate(parts) if parts else np.zeros(0, np.uint64),
        np.repeat(np.arange(len(ids)), each),
        np.concatenate([np.arange(k) for k in each]) if parts else np.zeros(0, int),
    )


class Lookup:
    """Finds which of many hashes are in a small sorted set; a bit table answers most."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of members."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        return at[self.keys[k] == hashes[at]] if len(self.keys) else at[:0]


def _docs_grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each text, and the n-grams with the text they start in."""
    words, counts = words_of(texts)
    first = np.cumsum(counts) - counts
    grams = grams_of(words, n)
    owner = np.repeat(np.arange(len(texts)), counts)[: len(grams)]
    end = (first + counts)[owner]
    valid = np.arange(len(grams)) + n <= end
    return words, first, np.where(valid, grams, np.uint64(0)), owner


def align(query: np.ndarray, size: np.ndarray, target: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Smith-Waterman score of each lane and the target place it ends at.

    ``query`` and ``target`` hold one row of word hashes a lane, of which the first
    ``size`` and ``length`` count. The gap within a row is a running maximum.
    """
    lanes, columns = target.shape
    slope = np.arange(columns, dtype=np.int32) * -GAP
    h = np.zeros((lanes, columns + 1), np.int32)
    best, end = np.zeros(lanes, np.int32), np.zeros(lanes, int)
    inside = np.arange(columns) < length[:, None]
    for i in range(query.shape[1]):
        step = np.where((target == query[:, i : i + 1]) & inside, np.int32(MATCH), np.int32(MISMATCH))
        row = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[i >= size] = 0
        h[:, 1:] = row
        at = np.where(inside, row, 0).argmax(axis=1)
        top = row[np.arange(lanes), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _hits(texts: list[bytes], items: Items, look: Lookup, ranked: np.ndarray, n: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, words) of the best alignment of each pair at the threshold or over."""
    words, first, grams, owner = _docs_grams(texts, n)
    counts = np.diff(np.append(first, len(words)))
    at = look.find(grams)
    # each seed's places in the items; ``ranked`` is their order by hash
    keys = items.grams[ranked]
    low = np.searchsorted(keys, grams[at])
    times = np.searchsorted(keys, grams[at], side="right") - low
    seed = ranked[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
    place, which = np.repeat(at, times), items.gram_item[seed]
    start = place - items.gram_at[seed] - first[owner[place]]
    # one window for diagonals that are near each other
    tasks = np.unique(np.column_stack([owner[place], which, start // np.maximum(1, items.sizes[which] // 2)]), axis=0).tolist()
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    # an alignment at the threshold has at most so many gaps on either side of a seed's diagonal
    slack = np.ceil((1 - threshold) * MATCH / -GAP * items.sizes).astype(int).tolist()
    windows: list[list[int]] = []
    for doc, item, bucket in tasks:
        size = int(items.sizes[item])
        half = max(1, size // 2)
        begin, stop = max(0, bucket * half - slack[item]), min(int(counts[doc]), (bucket + 1) * half + size + slack[item])
        if windows and windows[-1][:2] == [doc, item] and begin <= windows[-1][3]:
            windows[-1][3] = max(stop, windows[-1][3])
        else:
            windows.append([doc, item, begin, stop])
    # a word of the item that the window lacks is no match; without enough of them no alignment can do
    held = lambda doc, item, begin, stop: np.isin(items.words[items.starts[item] : items.starts[item] + items.sizes[item]], words[first[doc] + begin : first[doc] + stop]).sum()
    windows = [w for w in windows if held(*w) >= threshold * items.sizes[w[1]]]
    order = sorted(windows, key=lambda w: (items.sizes[w[1]], w[3] - w[2], w))
    i = 0
    while i < len(order):
        widest, j, longest = int(items.sizes[order[i][1]]), i, 0
        while j < len(order) and items.sizes[order[j][1]] <= 2 * widest:
            longest = max(longest, order[j][3] - order[j][2])
            if j > i and (j - i + 1) * longest > LANES // 2:
                break
            j += 1
        part, i = order[i:j], j
        sizes = np.array([items.sizes[w[1]] for w in part])
        widest = int(sizes.max())
        begin = np.array([w[2] for w in part])
        length = np.maximum(np.array([w[3] for w in part]) - begin, 0)
        query = np.zeros((len(part), widest), np.uint64)
        target = np.zeros((len(part), max(1, int(length.max()))), np.uint64)
        for k, (doc, item, *_) in enumerate(part):
            query[k, : sizes[k]] = items.words[items.starts[item] : items.starts[item] + sizes[k]]
            target[k, : length[k]] = words[first[doc] + begin[k] : first[doc] + begin[k] + length[k]]
        best, end = align(query, sizes, target, length)
        for k in np.flatnonzero(best >= threshold * MATCH * sizes):
            doc, item = part[k][:2]
            score = float(best[k]) / (MATCH * int(sizes[k]))
            row = (score, int(begin[k] + end[k] - sizes[k] + 1), int(sizes[k]))
            if row > found.get((doc, item), (-1.0, 0, 0)):
                found[doc, item] = row
    return [(d, i, *r) for (d, i), r in sorted(found.items())]


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.6) -> DataFrame:
    """(id, item, score, first_word, n_words) for every contaminated pair.

    ``score`` is that of the best local alignment over the score of the whole item
    verbatim; pairs at ``threshold`` or over are returned, with the document's
    words that the item falls on. An item with fewer than ``n`` words has no seed
    and matches nothing, and so do null and empty texts. Repeated documents and
    items give a row for each pair of rows; null ids of either stay null. Copies of an
    item that keep none of its n-word phrases are not found.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = [_search_block(chosen, block, n, threshold) for block in _blocks(benchmark, item_col, item_text_col, n)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "id long, item long, score double, first_word long, n_words long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item as ``search`` finds them."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, n):
        finder = _finder(items, n, threshold)

        def run(batches: Iterator[pa.RecordBatch], finder: Callable = finder) -> Iterator[pa.RecordBatch]:
            find = finder()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in find(_lowered(batch.column(at)))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs


def _lowered(column: pa.Array) -> list[bytes]:
    """The UTF-8 texts of a column in lower case; ASCII ones as they are, since the words
    of ``words_of`` ignore its case."""
    return [b"" if t is None else t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in utf8(column)]


def _finder(items: Items, n: int, threshold: float) -> Callable[[], Callable[[list[bytes]], list[tuple[int, int, float, int, int]]]]:
    """Builds, on an executor, the search of a block of items in a list of texts."""

    def build() -> Callable[[list[bytes]], list[tuple[int, int, float, int, int]]]:
        look, ranked = Lookup(items.grams), np.argsort(items.grams, kind="stable")

        def find(texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
            rows = []
            for i, j in chunks([len(t) for t in texts]):
                rows += [(i + d, *r) for d, *r in _hits(texts[i:j], items, look, ranked, n, threshold)]
            return rows

        return find

    return build


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, fetched one after another."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    ids, texts, size = [], [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        ids.append(row.id)
        texts.append(row.text.lower().encode())
        size += len(re.findall(rb"\w+", texts[-1]))
        if size >= BLOCK_WORDS:
            yield items_of(ids, texts, n)
            ids, texts, size = [], [], 0
    if ids:
        yield items_of(ids, texts, n)


def _search_block(docs: DataFrame, items: Items, n: int, threshold: float) -> DataFrame:
    finder = _finder(items, n, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _lowered(batch.column(1))
            rows = [(ids[d], items.ids[k], s, at, m) for d, k, s, at, m in find(texts)]
            names = ["id", "item", "score", "first_word", "n_words"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names)

    return docs.mapInArrow(frugal(run), "id long, item long, score double, first_word long, n_words long")
