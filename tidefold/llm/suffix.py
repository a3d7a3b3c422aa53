"""External induced suffix sorting with common-prefix values, to a bounded depth.

The classic scheme: suffixes fall into types by whether they are larger (L) or
smaller (S) than their successor. The leftmost S suffixes are sorted first, by
naming the substrings between them, sorted by the same induction, and sorting the
suffixes of the string of names in turn, by recursion, until what is left fits in
memory. From them the order of all L suffixes is induced in one ascending
sweep over first symbols, and that of all S suffixes in one descending sweep.

A sweep's priority queue is keyed by first symbol, and what enters a symbol's
queue enters in order; so it is one queue of blocks a symbol, held on disk beyond a
budget of memory. Blocks are extracted and induced from whole, by vector code.
Tuples carry the place of a suffix and its common prefix with the one before it in
the queue: one more than the least common prefix among the suffixes that induced
the two. Prefixes count up to ``depth``; suffixes that agree so far are in any
order.

Strings of names have many symbols. Their sweeps have a queue for each range of
symbols, and take from a range as many symbols at once as induce nothing among
themselves; they need the order alone. All arrays in proportion to the text (types,
places, names, orders) lie in files beyond the budget, and are gone through block by
block; the result comes block by block too.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues of a sweep hold in memory, and names that are ranked there; what is beyond goes to disk.
MEMORY_TUPLES = 1 << 20
#: Tuples extracted, and places gone through, at once.
BLOCK = 1 << 17
#: Ranges of symbols in a sweep over names.
RANGES = 256
_TUPLE = np.dtype([("at", "<i8"), ("lcp", "<i2")])
_FAR = np.int64(1) << 62


class Arena:
    """Arrays of a sort: in memory up to a number of bytes in all, then in temporary files."""

    def __init__(self, budget: int) -> None:
        self.left, self.on_disk = budget, 0

    def empty(self, n: int, kind: type | np.dtype) -> np.ndarray:
        """An array to be filled."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            return np.empty(n, kind)
        self.on_disk += size
        with tempfile.TemporaryFile() as file:  # the map keeps it
            return np.memmap(file, kind, "w+", shape=(n,))


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, n, BLOCK):
        yield lo, min(n, lo + BLOCK)


class BlockQueues:
    """First-in first-out queues of tuples by symbol; blocks past the budget lie in a file."""

    def __init__(self, symbols: int, memory: int) -> None:
        self.queues: list[deque] = [deque() for _ in range(symbols)]
        self.last = np.full(symbols, -1, np.int64)
        self.memory, self.held = memory, 0
        self.file = None

    def put(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        """Appends tuples that are in order."""
        if self.held + len(at) <= self.memory:
            self.held += len(at)
            self.queues[symbol].append((at, lcp))
        else:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            block = np.empty(len(at), _TUPLE)
            block["at"], block["lcp"] = at, lcp
            offset = self.file.seek(0, 2)
            self.file.write(block.tobytes())
            self.queues[symbol].append((offset, len(at)))
        self.last[symbol] = at[-1]

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Extracts a symbol's blocks, those too that are put in meanwhile; small ones are joined."""
        queue = self.queues[symbol]
        while queue:
            part, size = [], 0
            while queue and size < BLOCK:
                block = queue.popleft()
                self.held -= 0 if isinstance(block[0], int) else len(block[0])
                a, b = self._read(block)
                part.append((a, b))
                size += len(a)
            yield np.concatenate([a for a, _ in part]), np.concatenate([b for _, b in part])

    def _read(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        a, b = block
        if not isinstance(a, int):
            return a, b
        self.file.seek(a)
        read = np.frombuffer(self.file.read(b * _TUPLE.itemsize), _TUPLE)
        return read["at"].astype(np.int64), read["lcp"]

    def backward(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A symbol's tuples from the last to the first, block by block; they stay.

        A common prefix then belongs to the next one down, the first of a block's
        to none.
        """
        for block in reversed(self.queues[symbol]):
            at, lcp = self._read(block)
            yield at[::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.int16)

    def close(self) -> None:
        """Drops the file."""
        if self.file is not None:
            self.file.close()


class _Least:
    """Minima over ranges of an array, from a table of minima over powers of two."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = [x]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(x):
            row = self.rows[-1]
            self.rows.append(np.minimum(row[:-step], row[step:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over [lo, hi), none empty."""
        power = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(power):
            on = power == k
            out[on] = np.minimum(self.rows[k][lo[on]], self.rows[k][hi[on] - (1 << int(k))])
        return out


def _common(text: np.ndarray, a: int, b: int, depth: int) -> int:
    """The common prefix of two suffixes, by symbols."""
    n = min(len(text) - max(a, b), depth)
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def types(text: np.ndarray, arena: Arena) -> np.ndarray:
    """Whether each suffix is of type S; the last one is L, as the end is smaller."""
    n = len(text)
    out = arena.empty(n, bool)
    for lo, hi in reversed(list(_blocks(n))):
        here = np.asarray(text[lo:hi])
        after = np.asarray(text[lo + 1 : hi + 1])
        rises = np.zeros(hi - lo, bool)
        rises[: len(after)] = after > here[: len(after)]
        same = np.zeros(hi - lo, bool)
        same[: len(after)] = after == here[: len(after)]
        # a run of equal symbols has the type of its last one
        at = np.where(same, hi - lo, np.arange(hi - lo))
        end = np.minimum.accumulate(at[::-1])[::-1]
        over = end == hi - lo
        out[lo:hi] = np.where(over, out[hi] if hi < n else False, rises[np.minimum(end, hi - lo - 1)])
    return out


def _leftmost(small: np.ndarray, arena: Arena) -> np.ndarray:
    """Places of S suffixes after an L one, ascending."""
    found = lambda lo, hi: np.flatnonzero(small[lo:hi] & ~small[lo - 1 : hi - 1]) + lo
    spans = [(max(lo, 1), hi) for lo, hi in _blocks(len(small)) if hi > 1]
    out = arena.empty(sum(int(np.count_nonzero(small[lo:hi] & ~small[lo - 1 : hi - 1])) for lo, hi in spans), np.int64)
    filled = 0
    for lo, hi in spans:
        some = found(lo, hi)
        out[filled : filled + len(some)] = some
        filled += len(some)
    return out


def _by_symbol(text: np.ndarray, at: np.ndarray, symbols: int, arena: Arena) -> np.ndarray:
    """Places by their first symbol, in files if need be; places of a symbol keep their order."""
    next_ = arena.empty(symbols + 1, np.int64)
    next_[:] = 0
    for lo, hi in _blocks(len(at)):
        some, times = np.unique(text[at[lo:hi]], return_counts=True)
        next_[some.astype(np.int64) + 1] += times
    total = 0
    for lo, hi in _blocks(len(next_)):
        next_[lo:hi] = np.cumsum(next_[lo:hi]) + total
        total = int(next_[hi - 1])
    out = arena.empty(len(at), np.int64)
    for lo, hi in _blocks(len(at)):
        char = np.asarray(text[at[lo:hi]]).astype(np.int64)
        order = np.argsort(char, kind="stable")
        some, first, times = np.unique(char[order], return_index=True, return_counts=True)
        slot = np.repeat(next_[some] - first, times) + np.arange(hi - lo)
        out[slot] = at[lo:hi][order]
        next_[some] += times
    return out


def _sweep(text: np.ndarray, small: np.ndarray, symbols: int, seeds: Iterator[tuple[int, np.ndarray, np.ndarray]], up: bool, depth: int, memory: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Induces the L suffixes (``up``) or the S suffixes from seeds in sweep order.

    ``seeds`` gives (symbol, places, common prefixes), in blocks in
    the order of the sweep; what comes out is (symbol, places, common prefixes) of
    the induced suffixes in sweep order, common prefixes with the suffix before.
    """
    queues = BlockQueues(symbols, memory)
    if up:  # the end of the text induces the last suffix
        queues.put(int(text[-1]), np.array([len(text) - 1]), np.zeros(1, np.int16))

    def induce(at: np.ndarray, lcp: np.ndarray) -> None:
        use = np.flatnonzero(at > 0)
        before = at[use] - 1
        fits = small[before] != up
        use, before = use[fits], before[fits]
        if not len(use):
            return
        char = text[before]
        order = np.argsort(char, kind="stable")
        use, before, char = use[order], before[order], char[order]
        common = np.zeros(len(use), np.int16)
        mates = np.flatnonzero(char[1:] == char[:-1]) + 1
        if len(mates):
            common[mates] = np.minimum(_Least(lcp).over(use[mates - 1] + 1, use[mates] + 1) + 1, depth)
        heads = np.concatenate([[0], np.flatnonzero(char[1:] != char[:-1]) + 1, [len(char)]])
        for lo, hi in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            symbol = int(char[lo])
            if queues.last[symbol] >= 0:
                common[lo] = _common(text, int(queues.last[symbol]), int(before[lo]), depth)
            queues.put(symbol, before[lo:hi], common[lo:hi])

    waiting = next(seeds, None)
    for symbol in range(symbols) if up else range(symbols - 1, -1, -1):
        for at, lcp in queues.take(symbol):
            yield symbol, at, lcp
            induce(at, lcp)
        while waiting is not None and waiting[0] == symbol:
            induce(waiting[1], waiting[2])
            waiting = next(seeds, None)
    queues.close()


def _grouped(text: np.ndarray, at: np.ndarray, lcp: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of sorted places, ascending, cut by first symbol."""
    for lo, hi in _blocks(len(at)):
        here = np.asarray(at[lo:hi])
        common = np.zeros(hi - lo, np.int16) if lcp is None else np.asarray(lcp[lo:hi])
        char = text[here]
        cuts = np.concatenate([[0], np.flatnonzero(char[1:] != char[:-1]) + 1, [hi - lo]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(char[i]), here[i:j], common[i:j]


def _induce_all(text: np.ndarray, small: np.ndarray, symbols: int, lms: np.ndarray, lcp: np.ndarray | None, depth: int, memory: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """From sorted leftmost S suffixes to all: (symbol, places, common prefixes, is S) descending."""
    large = BlockQueues(symbols, memory)
    for symbol, at, common in _sweep(text, small, symbols, _grouped(text, lms, lcp), True, depth, memory):
        large.put(symbol, at, common)
    seeds = ((symbol, *block) for symbol in range(symbols - 1, -1, -1) for block in large.backward(symbol))
    above = symbols - 1  # the first symbol whose L suffixes are still to come
    for symbol, at, common in _sweep(text, small, symbols, seeds, False, depth, memory):
        for s in range(above, symbol, -1):  # within a symbol, S suffixes are larger
            yield from ((s, *block, False) for block in large.backward(s))
        above = min(above, symbol)
        yield symbol, at, common, True
    for s in range(above, -1, -1):
        yield from ((s, *block, False) for block in large.backward(s))
    large.close()


def suffix_blocks(text: np.ndarray, depth: int, memory: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (places, common prefixes) of all suffixes, from the largest down.

    They are in order to ``depth``; a common prefix, ``depth`` at most, is that with
    the suffix before in this order (0 for the first). ``text`` holds small
    non-negative integers, up to some hundreds, and may be a file. Beyond ``memory`` tuples
    (``MEMORY_TUPLES``) everything in proportion to the text is on disk.
    """
    if len(text) == 0:
        return
    memory = MEMORY_TUPLES if memory is None else memory
    arena = Arena(16 * memory)
    small = types(text, arena)
    symbols = max(int(np.max(text[lo:hi])) for lo, hi in _blocks(len(text))) + 1
    lms = _leftmost(small, arena)
    ranked = arena.empty(len(lms), np.int64)
    if len(lms):  # in any order, induction sorts the substrings between them
        end = len(lms)
        for _, at, _, s in _induce_all(text, small, symbols, _by_symbol(text, lms, symbols, arena), None, depth, memory):
            if s:
                at = at[_is_leftmost(small, at)]
                ranked[end - len(at) : end] = at[::-1]
                end -= len(at)
    order = _ordered(text, lms, ranked, depth, memory, arena)
    last = -1
    for _, at, common, _ in _induce_all(text, small, symbols, order, _neighbours(text, order, depth, arena), depth, memory):
        common = common.copy()
        common[0] = _common(text, last, int(at[0]), depth) if last >= 0 else 0
        yield at, common
        last = int(at[-1])


def suffix_array(text: np.ndarray, depth: int, memory: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, common prefixes) in ascending order, as ``suffix_blocks`` gives them."""
    blocks = list(suffix_blocks(text, depth, memory))
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    places, common = zip(*blocks, strict=True)
    down, shared = np.concatenate(places), np.concatenate(common)
    return down[::-1], np.concatenate([[0], shared[:0:-1]]).astype(np.int16)


def _is_leftmost(small: np.ndarray, at: np.ndarray) -> np.ndarray:
    return small[at] & (at > 0) & ~small[np.maximum(at - 1, 0)]


def _ordered(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray, depth: int, memory: int, arena: Arena) -> np.ndarray:
    """The leftmost S suffixes in order to ``depth``, from their substrings in order.

    Substrings get names by rank; the suffixes of the string of names are sorted to as
    many names as ``depth`` symbols can hold. Names are two symbols long at least.
    """
    names, count = _named(text, lms, ranked, depth, arena)
    if count == len(lms):
        return ranked
    inner = _order_of_names(names, count, depth // 2 + 1, memory, arena)
    out = arena.empty(len(lms), np.int64)
    for lo, hi in _blocks(len(lms)):
        out[lo:hi] = lms[inner[lo:hi]]
    return out


def _named(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray, depth: int, arena: Arena) -> tuple[np.ndarray, int]:
    """The names, from 0, of the substrings in text order, and how many there are."""
    names = arena.empty(len(lms), np.int64)
    name, n = -1, len(text)
    for lo, hi in _blocks(len(lms)):
        at = np.asarray(ranked[max(lo - 1, 0) : hi])
        place = np.searchsorted(lms, at)
        end = np.where(place + 1 < len(lms), lms[np.minimum(place + 1, len(lms) - 1)], n - 1)
        size = end - at + 1
        # equal neighbours in that order are equal substrings: compare them symbol by symbol
        same = np.append(False, size[1:] == size[:-1])
        live, k = np.flatnonzero(same), 0
        while len(live) and k < depth:
            ok = text[at[live] + k] == text[at[live - 1] + k]
            same[live[~ok]] = False
            k += 1
            live = live[ok]
            live = live[size[live] > k]
        first = 1 if lo else 0
        new = np.cumsum(~same[first:]) + name
        names[place[first:]] = new
        name = int(new[-1])
    return names, name + 1


def _order_of_names(text: np.ndarray, symbols: int, depth: int, memory: int, arena: Arena) -> np.ndarray:
    """The suffixes of a string of names below ``symbols`` in order to ``depth``: in memory
    by doubling if they fit there, else by induction and recursion."""
    n = len(text)
    if n <= memory:
        return _doubled(np.asarray(text), depth)
    small = types(text, arena)
    lms = _leftmost(small, arena)

    def induced(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = arena.empty(n - sum(int(np.count_nonzero(small[lo:hi])) for lo, hi in _blocks(n)), np.int64)
        _wide_sweep(text, small, symbols, seeds, large, True, memory)
        rest = arena.empty(n - len(large), np.int64)
        _wide_sweep(text, small, symbols, large, rest, False, memory)
        return large, rest

    order = lms
    if len(lms):
        _, down = induced(_by_symbol(text, lms, symbols, arena))
        ranked, end = arena.empty(len(lms), np.int64), len(lms)
        for lo, hi in _blocks(len(down)):
            at = down[lo:hi][_is_leftmost(small, down[lo:hi])]
            ranked[end - len(at) : end] = at[::-1]
            end -= len(at)
        order = _ordered(text, lms, ranked, depth, memory, arena)
    large, down = induced(order)
    # of a symbol, L suffixes come first
    out = arena.empty(n, np.int64)
    merged = _by_symbol(text, _Joined(large, down), symbols, arena)
    out[:] = merged
    return out


class _Joined:
    """An ascending list and a descending one as one list, both ascending."""

    def __init__(self, up: np.ndarray, down: np.ndarray) -> None:
        self.up, self.down = up, down

    def __len__(self) -> int:
        return len(self.up) + len(self.down)

    def __getitem__(self, span: slice) -> np.ndarray:
        lo, hi = span.start, span.stop
        k, m = len(self.up), len(self)
        down = self.down[max(m - hi, 0) : m - max(lo, k)] if hi > k else self.down[:0]
        return np.concatenate([self.up[lo : min(hi, k)], down[::-1]])


def _doubled(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of a short string's suffixes, by ranks of doubling reach; ranks start at 1,
    and the end is 0."""
    _, names = np.unique(text, return_inverse=True)
    names = names.astype(np.int64) + 1
    reach = 1
    while reach < depth and names.max() < len(names):
        after = np.append(names[reach:], np.zeros(min(reach, len(names)), np.int64))[: len(names)]
        order = np.lexsort((after, names))
        change = np.append(True, (names[order][1:] != names[order][:-1]) | (after[order][1:] != after[order][:-1]))
        new = np.empty(len(names), np.int64)
        new[order] = np.cumsum(change)
        names, reach = new, 2 * reach
    return np.argsort(names, kind="stable")


class RangeQueues:
    """First-in first-out queues of (symbol, place) by range of symbols; blocks past the
    budget lie in a file."""

    def __init__(self, ranges: int, memory: int) -> None:
        self.queues: list[list] = [[] for _ in range(ranges)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, range_: int, symbol: np.ndarray, at: np.ndarray) -> None:
        """Appends items that are in order."""
        if self.held + len(at) <= self.memory:
            self.held += len(at)
            self.queues[range_].append((symbol, at))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        offset = self.file.seek(0, 2)
        self.file.write(symbol.tobytes() + at.tobytes())
        self.queues[range_].append((offset, len(at)))

    def take(self, range_: int) -> tuple[np.ndarray, np.ndarray]:
        """Extracts a range's items: symbols and places."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in self.queues[range_]:
            if isinstance(a, int):
                self.file.seek(a)
                parts.append(tuple(np.frombuffer(self.file.read(16 * b), np.int64).reshape(2, -1)))
            else:
                self.held -= len(a)
                parts.append((a, b))
        self.queues[range_] = []
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        """Drops the file."""
        if self.file is not None:
            self.file.close()


def _wide_sweep(text: np.ndarray, small: np.ndarray, symbols: int, seeds: np.ndarray, out: np.ndarray, up: bool, memory: int) -> None:
    """Fills ``out`` with the L suffixes ascending (``up``) or the S suffixes descending.

    ``seeds`` are the sorted leftmost S suffixes, or all L suffixes, ascending both. A
    descending sweep counts symbols from the other end.
    """
    n, width = len(text), -(-symbols // RANGES)
    code = (lambda at: np.asarray(text[at]).astype(np.int64)) if up else (lambda at: symbols - 1 - np.asarray(text[at]).astype(np.int64))
    queues = RangeQueues(-(-symbols // width), memory)
    if up:  # the end of the text induces the last suffix
        queues.put(int(text[n - 1]) // width, code(np.array([n - 1])), np.array([n - 1]))
    filled = 0
    coming = _in_ranges(seeds, code, width, up)
    waiting = next(coming, None)
    for r in range(len(queues.queues)):
        symbol, at = queues.take(r)
        kind = np.zeros(len(at), np.int64)
        while waiting is not None and waiting[0] == r:
            symbol, at = np.append(symbol, waiting[1]), np.append(at, waiting[2])
            kind = np.append(kind, np.ones(len(waiting[2]), np.int64))
            waiting = next(coming, None)
        while len(at):
            order = np.argsort(2 * symbol + kind, kind="stable")
            symbol, at, kind = symbol[order], at[order], kind[order]
            fits = at > 0
            before = np.maximum(at - 1, 0)
            fits &= small[before] != up
            char = np.where(fits, code(before), _FAR)
            # as many as come before all that they induce; at least one symbol's of a kind
            stop = np.flatnonzero(symbol[1:] >= np.minimum.accumulate(char)[:-1])
            k = int(stop[0]) + 1 if len(stop) else len(at)
            k = max(k, int(np.searchsorted(2 * symbol + kind, 2 * symbol[0] + kind[0], side="right")))
            done = at[:k][kind[:k] == 0]
            out[filled : filled + len(done)] = done
            filled += len(done)
            use = np.flatnonzero(fits[:k])
            new, to = before[use], char[use]
            near = to < (r + 1) * width
            far, away = new[~near], to[~near]
            if len(far):
                which = np.argsort(away // width, kind="stable")
                far, away = far[which], away[which]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(away // width)) + 1, [len(far)]]).tolist()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    queues.put(int(away[i]) // width, away[i:j], far[i:j])
            symbol, at = np.append(symbol[k:], to[near]), np.append(at[k:], new[near])
            kind = np.append(kind[k:], np.zeros(int(near.sum()), np.int64))
    queues.close()


def _in_ranges(seeds: np.ndarray, code, width: int, up: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Blocks of (range, symbols, places) of seeds in the order of a sweep."""
    spans = list(_blocks(len(seeds)))
    for lo, hi in spans if up else spans[::-1]:
        at = np.asarray(seeds[lo:hi]) if up else np.asarray(seeds[lo:hi])[::-1]
        symbol = code(at)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(symbol // width)) + 1, [len(at)]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(symbol[i]) // width, symbol[i:j], at[i:j]


def _neighbours(text: np.ndarray, at: np.ndarray, depth: int, arena: Arena) -> np.ndarray:
    """Common prefixes of neighbours in a list of suffixes, symbol by symbol."""
    out = arena.empty(len(at), np.int16)
    for lo, hi in _blocks(len(at)):
        here = np.asarray(at[max(lo - 1, 0) : hi])
        lcp = np.zeros(len(here), np.int16)
        live = np.arange(1, len(here))
        for k in range(depth):
            live = live[np.maximum(here[live], here[live - 1]) + k < len(text)]
            live = live[text[here[live] + k] == text[here[live - 1] + k]]
            if not len(live):
                break
            lcp[live] += 1
        out[lo:hi] = lcp[1 if lo else 0 :]
    return out
