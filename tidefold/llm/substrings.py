"""Removal of repeated substrings: bytes of strings that occur in an earlier document.

A string of ``length`` bytes is a window. Windows are brought together by anchors: of
the k-grams in a window, the one with the least hash is its anchor, so equal windows
have equal anchors at equal offsets, and the windows of an anchor are one stretch of
a document. A pass before the sort, then the sort of what that leaves open:

1. Each anchor sends its hash, a hash of its stretch and the document to a shard,
   once a batch of documents and stretch. The shard tells which anchors occur in
   several documents at all, and settles stretches that are equal as a whole.
2. Of stretches that share an anchor and differ, one copy each is cut into pieces
   around wider anchors and sent to the task of their key. All pieces of a task are
   one text on disk, whose suffixes are sorted by external induced sorting
   (``suffix``). Runs of suffixes with a common prefix of a window or more are equal
   windows; the least document of a run keeps it.
3. An anchor with more than ``HOT`` stretches, such as that of a very frequent line in
   ever new contexts, sends no pieces. Its windows, folded batch by batch, are dealt by
   their own hashes over all tasks.
4. The covered stretches go back to their documents.

So no task gets what surrounds a frequent line. Stretches are compared by hashes of
64 bits of the k-grams they hold, suffixes by their bytes, windows of hot anchors by
hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, frugal, utf8
from tidefold.llm.suffix import suffix_blocks

#: Bytes of a window.
WINDOW = 50
#: Bytes of an anchor: long enough that texts rarely share one by chance.
SEED = 20
#: Offsets of an anchor in a window that one piece holds together.
CLASS = 12
#: Bytes of documents that are hashed at once.
CHUNK = 1 << 18
#: Differing stretches of an anchor that are sorted together; of more, the windows are dealt.
HOT = 2048
#: Entries of a shard that a task holds.
HELD = 1 << 20
#: Bytes of text whose anchors a shard holds, about.
SHARD_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(24)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))
_UNDO = np.uint64(pow(int(_M), -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` bytes from each place on: polynomials of random digits,
    put together from those of half the bytes, and mixed."""
    h, have = _BYTES[data], 1
    held = {1: h}
    while 2 * have <= SEED:
        h = h[:-have] * _factor(have) + h[have:]
        have *= 2
        held[have] = h
    rest = SEED - have
    if rest:
        h = h[: len(data) - SEED + 1] * _factor(rest) + held[rest][have : have + len(data) - SEED + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def stretches(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor place, first window, windows, anchor hash, stretch hash) of
    documents laid end to end from ``starts`` on. Under 16 MB at once."""
    none, bare = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none, none, none, none, bare, bare
    h = gram_hashes(data)
    key = ((h >> _PLACE) << _PLACE) | np.arange(len(h), dtype=np.uint64)
    width, low, span = length - SEED + 1, key, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    change = np.empty(len(low), bool)
    change[0] = True
    np.not_equal(low[1:], low[:-1], out=change[1:])
    change[starts[starts < len(low)]] = True
    first = np.flatnonzero(change)
    end = np.append(first[1:], len(low))
    # windows that run over a document's end are none
    owner = np.searchsorted(starts, first, side="right") - 1
    stop = np.append(starts[1:], len(data))[owner] - length + 1
    count = np.minimum(end, stop) - first
    keep = count > 0
    owner, first, count = owner[keep], first[keep], count[keep]
    place = (low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    # a stretch's hash: its k-grams as digits of a number, from sums of shifted digits
    power, inverse = np.cumprod(np.full(len(h), _M)), np.cumprod(np.full(len(h), _UNDO))
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * power, out=sums[1:])
    grams = count + length - SEED
    total = (sums[first + grams] - sums[first]) * inverse[first]
    return owner, place, first, count, h[place], _mix(total + grams.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + (place - first).astype(np.uint64))


def _factor(k: int) -> np.uint64:
    return np.uint64(pow(int(_M), k, 1 << 64))


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """(bytes, sizes, documents, offsets in them) of chunks of whole documents; a long document
    is cut into slices that share all but one byte of a window."""
    part: list[tuple[bytes, int, int]] = []
    size = 0
    for d, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), 4 * CHUNK):
            piece = text[start : start + 4 * CHUNK + length - 1]
            if part and size + len(piece) > CHUNK:
                yield b"".join(p[0] for p in part), [len(p[0]) for p in part], [p[1] for p in part], [p[2] for p in part]
                part, size = [], 0
            if len(piece) >= length:
                part.append((piece, d, start))
                size += len(piece)
    if part:
        yield b"".join(p[0] for p in part), [len(p[0]) for p in part], [p[1] for p in part], [p[2] for p in part]


def _found(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(document, first window in it, windows, anchor's offset, anchor hash, stretch hash) of a batch."""
    out = []
    for data, sizes, docs, shifts in _slices(texts, length):
        starts = np.cumsum(sizes) - sizes
        owner, place, first, count, h, s = stretches(np.frombuffer(data, np.uint8), starts, length)
        moved = first - starts[owner] + np.array(shifts)[owner]
        out.append((np.array(docs)[owner], moved, count, place - first, h, s))
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate([np.zeros(0, k), *[o[i] for o in out]]) for i, k in enumerate(kinds))


def _entry(h: np.ndarray, s: np.ndarray) -> np.ndarray:
    return _mix(h * _M + s)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids as compressed differences."""
    return zlib.compress(np.diff(ids, prepend=0).tobytes(), 1)


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int64))


def _packed(shard: list[int], pairs: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
    """Entries on their way to shards."""
    none = pa.nulls(len(shard), pa.int64())
    return pa.record_batch([pa.array(shard, pa.int64()), pa.array(pairs, pa.binary()), pa.array(ids, pa.binary()), none, none, pa.nulls(len(shard), pa.int32())], _ENTRY)


#: What a document is told of an entry: it is covered whole, or its pieces or windows are to be looked at.
WHOLE, PIECES, WINDOWS = 0, 1, 2


def _said(ids: np.ndarray, entry: np.ndarray, how: np.ndarray) -> pa.RecordBatch:
    """Replies to documents, spread by document."""
    none = pa.nulls(len(ids), pa.binary())
    shard = -1 - (_mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(1 << 20)).astype(np.int64)
    return pa.record_batch([pa.array(shard), none, none, pa.array(ids), pa.array(entry.view(np.int64)), pa.array(how, pa.int32())], _ENTRY)


_ENTRY = ["shard", "pairs", "ids", "id", "entry", "how"]
_ENTRIES = "shard long, pairs binary, ids binary, id long, entry long, how int"


def _anchors(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """Entries for shards, once a batch and stretch, and what a batch settles by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, _, _, _, h, s = _found([t or b"" for t in utf8(batch.column(1))], length)
            if not len(h):
                continue
            mine, entry = ids[doc], _entry(h, s)
            order = np.argsort(entry, kind="stable")
            head = np.flatnonzero(np.append(True, entry[order][1:] != entry[order][:-1]))
            sizes = np.diff(np.append(head, len(order)))
            least = np.repeat(np.minimum.reduceat(mine[order], head), sizes)
            is_least = mine[order] == least
            later = order[~is_least]
            if len(later):  # once a document and entry
                again = (mine[later][1:] == mine[later][:-1]) & (entry[later][1:] == entry[later][:-1])
                later = later[np.append(True, ~again)]
                yield _said(mine[later], entry[later], np.full(len(later), WHOLE))
            # of the entries of the least document, the first
            rank = np.where(is_least, np.arange(len(order)), len(order))
            rep = np.sort(order[np.minimum.reduceat(rank, head)])
            shard = (h[rep] % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)
            rep = rep[np.argsort(shard, kind="stable")]
            shard = np.sort(shard, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            pairs, owners = np.stack([h[rep], s[rep]], axis=1), mine[rep]
            yield _packed([int(shard[a]) for a, _ in spans], [pairs[a:b].tobytes() for a, b in spans], [_pack_ids(owners[a:b]) for a, b in spans])

    return docs.mapInArrow(frugal(run), _ENTRIES)


def _settle(h: np.ndarray, s: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Replies of a shard: equal stretches of later documents are covered whole; if an
    anchor has several stretches, the least document of each is to be looked at."""
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    order = order[np.append(False, twin) | np.append(twin, False)]  # others are in one document
    h, s, ids = h[order], s[order], ids[order]
    if not len(h):
        return _said(ids, h, np.zeros(0, int))
    order = np.lexsort((ids, s, h))
    h, s, ids = h[order], s[order], ids[order]
    by_h = np.append(True, h[1:] != h[:-1])
    by_s = by_h | np.append(True, s[1:] != s[:-1])
    group, kind = np.cumsum(by_h) - 1, np.cumsum(by_s) - 1
    heads = np.flatnonzero(by_h)
    shared = (np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads))[group]
    kinds = np.add.reduceat(by_s.astype(np.int64), heads)[group]
    later = ids > ids[by_s][kind]
    use = shared & (later | (kinds > 1) & by_s)
    return _said(ids[use], _entry(h[use], s[use]), np.where(later, WHOLE, np.where(kinds > HOT, WINDOWS, PIECES))[use])


def _settle_open(h: np.ndarray, s: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Replies to some of the entries of anchors: later ones of equal stretches are
    covered whole, and the least of each is to be looked at, whatever the others hold."""
    if not len(h):
        return _said(ids, h, np.zeros(0, int))
    order = np.lexsort((ids, s, h))
    h, s, ids = h[order], s[order], ids[order]
    head = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
    return _said(ids, _entry(h, s), np.where(ids <= ids[head][np.cumsum(head) - 1], WINDOWS, WHOLE))


class _Shard:
    """Settles a shard's entries as they come. Beyond ``HELD`` the most frequent anchors
    are opened: their entries are settled part by part and no longer held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.opened = 0, np.zeros(0, np.uint64)

    def add(self, pairs: bytes, ids: bytes) -> Iterator[pa.RecordBatch]:
        both = np.frombuffer(pairs, np.uint64).reshape(-1, 2)
        self.parts.append((both[:, 0], both[:, 1], _unpack_ids(ids)))
        self.size += len(both)
        if self.size > HELD:
            h, s, owners = self._joined()
            keys, n = np.unique(h, return_counts=True)
            n[np.isin(keys, self.opened)] = len(h)
            order = np.argsort(-n, kind="stable")
            more = np.searchsorted(np.minimum(np.cumsum(n[order]), len(h)), len(h) - HELD // 2) + 1
            self.opened = np.union1d(self.opened, keys[order[:more]])
            out = np.isin(h, self.opened)
            yield _settle_open(h[out], s[out], owners[out])
            self.parts, self.size = [(h[~out], s[~out], owners[~out])], int((~out).sum())

    def _joined(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([p[k] for p in self.parts]) for k in range(3))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is still held."""
        h, s, owners = self._joined()
        out = np.isin(h, self.opened)
        yield _settle_open(h[out], s[out], owners[out])
        yield _settle(h[~out], s[~out], owners[~out])


def _by_group(batches: Iterator[pa.RecordBatch], passes: Callable, group: Callable, new: Callable, add: Callable) -> Iterator[pa.RecordBatch]:
    """Hands on the rows that pass, and gives the others, sorted by group, one by one to
    their group's state, which says what it settles at once and in the end."""
    current, state = None, None
    for batch in batches:
        through = passes(batch)
        if pc.any(through).as_py():
            yield batch.filter(through)
        for row in zip(*[c.to_pylist() for c in batch.filter(pc.invert(through)).columns], strict=True):
            if state is None or group(row) != current:
                if state is not None:
                    yield from state.rest()
                current = group(row)
                state = new(current)
            yield from add(state, row)
    if state is not None:
        yield from state.rest()


def _replies(entries: DataFrame) -> DataFrame:
    """(id, entry, how) of what the shards and the batches settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, lambda batch: batch.column(3).is_valid(), lambda row: row[0], lambda _: _Shard(), lambda shard, row: shard.add(row[1], row[2]))

    dealt = entries.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(frugal(run), _ENTRIES).select("id", "entry", "how")


def _covered(intervals: np.ndarray, size: int) -> np.ndarray:
    """A mask of the bytes in [start, end) intervals."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, intervals[:, 0], 1)
    np.add.at(depth, intervals[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _pieces_of(text: bytes, first: int, count: int, offset: int, h: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, first window, bytes) of a stretch's windows by classes of the anchor's offset.

    ``offset`` is the anchor's place in the first window; it falls by one a window.
    Windows of a class share all bytes between the last one's start and the first
    one's end, and with the anchor's hash those make the key.
    """
    window, end = first, first + count
    while window < end:
        o = offset - (window - first)
        stop = min(end, window + o % CLASS + 1)
        low = o // CLASS * CLASS
        anchor = first + offset
        common = text[anchor - low : anchor - low - CLASS + 1 + WINDOW]
        key = int.from_bytes(hashlib.blake2b(common + bytes([low]) + h.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
        yield key, window, text[window : stop - 1 + WINDOW]
        window = stop


_SHAPE = "shard long, kind int, id long, a binary, b binary"


def _rows(shard: list, kind: list, ids: list, a: list, b: list) -> pa.RecordBatch:
    values = [pa.array(shard, pa.int64()), pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.record_batch(values, ["shard", "kind", "id", "a", "b"])


def _asked(column: pa.Array) -> np.ndarray:
    """The entries in a column of lists, each joined with its row's number."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return _at_row(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), row)


def _at_row(entry: np.ndarray, row: np.ndarray) -> np.ndarray:
    return entry ^ _mix(row.astype(np.uint64) + np.uint64(1))


def _looked_at(docs: DataFrame, length: int, shards: int) -> DataFrame:
    """For documents with replies: covered intervals (kind 1), pieces to sort (kind 0), and
    windows of hot anchors, packed by shard (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in utf8(batch.column(1))]
            doc, first, count, offset, h, s = _found(texts, length)
            entry = _entry(h, s)
            asked = _at_row(entry, doc)
            kind, keys, names, a, b = [], [], [], [], []
            whole = np.flatnonzero(np.isin(asked, _asked(batch.column(2))))
            spans = np.stack([first[whole], first[whole] + count[whole] + length - 1], axis=1)
            cuts = np.searchsorted(doc[whole], np.arange(len(texts) + 1)).tolist()
            for d, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if j > i:
                    kind.append(1)
                    keys.append(0)
                    names.append(ids[d])
                    a.append(_merged(spans[i:j]).tobytes())
                    b.append(b"")

            def once(column: int) -> list[int]:  # what is found counts for all equal stretches of a document
                part = np.flatnonzero(np.isin(asked, _asked(batch.column(column))))
                return part[np.unique(asked[part], return_index=True)[1]].tolist()

            for i in once(3):
                d, at = int(doc[i]), int(first[i])
                name = int(entry[i]).to_bytes(8, "little")
                for key, window, piece in _pieces_of(texts[d], at, int(count[i]), int(offset[i]), int(h[i])):
                    kind.append(0)
                    keys.append(key)
                    names.append(ids[d])
                    a.append(name + (window - at).to_bytes(8, "little"))
                    b.append(piece)
            yield _rows(keys, kind, names, a, b)
            hot = once(4)
            if hot:
                yield from _dealt_windows([(ids[doc[i]], entry[i], texts[doc[i]], int(first[i]), int(count[i])) for i in hot], length, shards)

    return docs.mapInArrow(frugal(run), _SHAPE)


def _dealt_windows(found: list[tuple], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Windows of (document, entry, text, first window, windows): of equal ones in the batch
    those of later documents as answers, the others packed by shard."""
    hashes = b"".join(hashlib.blake2b(text[k : k + length], digest_size=16).digest() for _, _, text, at, n in found for k in range(at, at + n))
    n = np.array([f[4] for f in found])
    named = np.column_stack([np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.uint64).view(np.int64), np.cumsum(n) - n])
    owners = np.repeat(named, n, axis=0)
    owners[:, 2] = np.arange(len(owners)) - owners[:, 2]
    told, keys, owners = _least_windows(np.frombuffer(hashes, np.uint64).reshape(-1, 2), owners)
    yield told
    shard = (keys[:, 0] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, keys, owners = shard[order], keys[order], owners[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    yield _rows([int(shard[i]) for i, _ in spans], [2] * len(spans), [0] * len(spans), [keys[i:j].tobytes() for i, j in spans], [owners[i:j].tobytes() for i, j in spans])


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted intervals, those that touch joined."""
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[head, 0], np.append(reach[:-1][head[1:]], reach[-1])], axis=1)


def _told(ids: np.ndarray, names: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows that repeat, one a row, as a list for each document's entry (kind 3: answers)."""
    order = np.lexsort((at, names, ids))
    ids, names, at = ids[order], names[order], at[order]
    cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (names[1:] != names[:-1])) + 1
    heads = np.append(0, cuts)[: len(ids)].astype(np.int64)
    windows = [w.tobytes() for w in np.split(at, cuts)][: len(heads)]
    return _rows([0] * len(heads), [3] * len(heads), ids[heads].tolist(), [n.tobytes() for n in names[heads]], windows)


def _least_windows(keys: np.ndarray, owners: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Of equal windows, those of later documents as answers; keys and owners of the least's."""
    if not len(keys):
        return _told(*owners.T), keys, owners
    order = np.lexsort((owners[:, 0], keys[:, 1], keys[:, 0]))
    keys, owners = keys[order], owners[order]
    head = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    later = owners[:, 0] > owners[head, 0][np.cumsum(head) - 1]
    return _told(*owners[later].T), keys[~later], owners[~later]


class _Key:
    """Hands the pieces of one key to the sorter, if they are of several documents."""

    def __init__(self, sorter: _Sorter) -> None:
        self.sorter = sorter
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        return iter(())

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Of equal pieces the least document's is sorted; all windows of later ones repeat."""
        least: dict[bytes, tuple] = {}
        for r in self.rows:
            if r[4] not in least or r[2] < least[r[4]][2]:
                least[r[4]] = r
        equal = [r for r in self.rows if r[2] > least[r[4]][2]]
        if equal:
            windows = [np.arange(len(r[4]) - self.sorter.length + 1) + int.from_bytes(r[3][8:], "little") for r in equal]
            yield _rows([0] * len(equal), [3] * len(equal), [r[2] for r in equal], [r[3][:8] for r in equal], [w.astype(np.int64).tobytes() for w in windows])
        if len({r[2] for r in least.values()}) > 1:
            self.sorter.put(list(least.values()))


class _Sorter:
    """The pieces of a task as one text on disk, each ended by a symbol below all others."""

    #: Document, entry, first window and length of a piece.
    PIECE = np.dtype([("id", "<i8"), ("name", "<i8"), ("at", "<i8"), ("size", "<i8")])

    def __init__(self, length: int) -> None:
        self.length = length
        self.text, self.pieces = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.size = self.count = 0

    def put(self, rows: list[tuple]) -> None:
        """Appends pieces."""
        told = np.empty(len(rows), self.PIECE)
        named = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(-1, 2)
        told["id"], told["name"], told["at"] = [r[2] for r in rows], named[:, 0], named[:, 1]
        told["size"] = [len(r[4]) + 1 for r in rows]
        text = np.frombuffer(b"\0".join(r[4] for r in rows) + b"\0", np.uint8).astype(np.uint16) + 1
        text[np.cumsum(told["size"]) - 1] = 0
        self.text.write(text.tobytes())
        self.pieces.write(told.tobytes())
        self.size, self.count = self.size + len(text), self.count + len(rows)

    def answers(self) -> Iterator[pa.RecordBatch]:
        """For pieces with windows that occur in a piece of a lesser document: those windows."""
        if not self.count:
            return
        self.text.flush()
        self.pieces.flush()
        text = np.memmap(self.text, np.uint16, "r", shape=(self.size,))
        pieces = np.memmap(self.pieces, self.PIECE, "r", shape=(self.count,))
        ends = np.cumsum(pieces["size"])
        hit = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(self.size,))
        run = _Run(hit)
        for at, common in suffix_blocks(text, self.length):
            run.add(at, common < self.length, lambda places: pieces["id"][np.searchsorted(ends, places, side="right")])
        run.end()
        for lo in range(0, self.size, 1 << 20):
            found = np.flatnonzero(hit[lo : lo + (1 << 20)]) + lo
            owner = np.searchsorted(ends, found, side="right")
            whole = found + self.length < ends[owner]  # strings that run over a piece's end are no windows
            found, owner = found[whole], owner[whole]
            mine = pieces[owner]
            yield _told(mine["id"], mine["name"], mine["at"] + found - (ends[owner] - mine["size"]))
        self.text.close()
        self.pieces.close()


class _Run:
    """Marks, in runs of equal windows, those of documents after a run's least one.

    Of the run that is still open only the windows of its least document are held.
    """

    def __init__(self, hit: np.ndarray) -> None:
        self.hit = hit
        self.least, self.held = 0, np.zeros(0, np.int64)

    def add(self, at: np.ndarray, new: np.ndarray, ids: Callable[[np.ndarray], np.ndarray]) -> None:
        """Suffixes in order; ``new`` tells those that begin a run."""
        alone = new & np.append(new[1:], False)
        keep = ~alone
        keep[:1] = True  # it may end a run, as the last may begin one
        at, new = at[keep], new[keep]
        mine = ids(at)
        if not new[0]:  # the open run goes on
            at, new = np.append(self.held, at), np.append(np.zeros(len(self.held), bool), new)
            mine = np.append(np.full(len(self.held), self.least), mine)
        heads = np.flatnonzero(new)
        heads = np.append(0, heads) if not new[0] else heads
        run = np.cumsum(new) - (1 if new[0] else 0)
        least = np.minimum.reduceat(mine, heads)
        self.hit[at[mine > least[run]]] = True
        tail = at[heads[-1] :]
        self.least = least[-1]
        self.held = tail[mine[heads[-1] :] == self.least]

    def end(self) -> None:
        """The last run is over."""
        self.held = self.held[:0]


def _settled(pieces: DataFrame, length: int) -> DataFrame:
    """(shard, kind, id, a, b): covered intervals as they come (kind 1), and entries with
    windows that repeat (kind 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = _Sorter(length)
        done = lambda batch: pc.is_in(batch.column(1), pa.array([1, 3], pa.int32()))
        yield from _by_group(batches, done, lambda row: (row[1], row[0]), lambda group: _Windows() if group[0] == 2 else _Key(sorter), lambda state, row: state.add(row))
        yield from sorter.answers()

    # what is settled passes, spread by document
    spread = F.when(F.col("kind").isin(1, 3), F.xxhash64("id")).otherwise(F.col("shard"))
    dealt = pieces.withColumn("shard", spread).repartition("shard").sortWithinPartitions("kind", "shard")
    return dealt.mapInArrow(frugal(run), _SHAPE)


class _Windows:
    """Settles the windows of a shard."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.owners: list[bytes] = []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.keys.append(row[3])
        self.owners.append(row[4])
        return iter(())

    def rest(self) -> Iterator[pa.RecordBatch]:
        """Repeated windows of later documents."""
        keys, owners = np.frombuffer(b"".join(self.keys), np.uint64), np.frombuffer(b"".join(self.owners), np.int64)
        yield _least_windows(keys.reshape(-1, 2), owners.reshape(-1, 3))[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row.

    Texts are UTF-8 bytes; null counts as empty. A byte goes if a string of 50 bytes
    that covers it also starts in a document with a smaller id; strings are judged on
    the whole input. ``n_spans`` counts maximal runs removed, ``kept`` is what is left.
    Rows with a null id lose nothing and are no one's earlier document; rows of one id
    are one document in this, so repeated rows do not remove each other.
    """
    length = WINDOW
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = base.where("id is not null")
    total = base.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = 1 << max(6, (total // SHARD_BYTES).bit_length())
    replies = _replies(_anchors(named, length, shards))
    pick = lambda how: F.collect_list(F.when(F.col("how") == how, F.col("entry")))
    asked = replies.groupBy("id").agg(pick(WHOLE).alias("whole"), pick(PIECES).alias("pieces"), pick(WINDOWS).alias("windows"))
    asked = checkpoint(asked)
    pieces = _looked_at(named.join(asked, "id").select("id", "text", "whole", "pieces", "windows"), length, shards)
    found = _settled(pieces, length).groupBy("id").agg(F.collect_list(F.struct("kind", "a", "b")).alias("m"))
    marks = checkpoint(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marked = [t or b"" for t in utf8(batch.column(1))], batch.column(2).to_pylist()
            sizes, gone, spans, kept = [], [], [], []
            for text, marks_ in zip(texts, marked, strict=True):
                mask = np.zeros(len(text), bool)
                if marks_:
                    mask = _mask(text, marks_, length)
                edges = np.diff(mask.astype(np.int8), prepend=0)
                sizes.append(len(text))
                gone.append(int(mask.sum()))
                spans.append(int((edges == 1).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if marks_ else text)
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(gone), pa.array(spans), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    shape = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return base.join(marks, "id", "left").select("id", "text", "m").mapInArrow(frugal(run), shape)


def _mask(text: bytes, marks: list[dict], length: int) -> np.ndarray:
    """The bytes of a document that go."""
    parts = [np.frombuffer(m["a"], np.int64).reshape(-1, 2) for m in marks if m["kind"] == 1]
    partial: dict[int, list[np.ndarray]] = {}
    for m in marks:
        if m["kind"] == 3:
            partial.setdefault(int.from_bytes(m["a"], "little"), []).append(np.frombuffer(m["b"], np.int64))
    if partial:  # every stretch of the document with that entry
        _, first, _, _, h, s = _found([text], length)
        entry = _entry(h, s)
        for i in np.flatnonzero(np.isin(entry, np.array(list(partial), np.uint64))).tolist():
            at = np.concatenate(partial[int(entry[i])]) + first[i]
            parts.append(np.stack([at, at + length], axis=1))
    return _covered(np.concatenate(parts), len(text)) if parts else np.zeros(len(text), bool)
