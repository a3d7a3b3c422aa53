"""SentencePiece encoding by sampled segmentation, and exact decoding.

The pieces of a SentencePiece model weigh the paths of a lattice over the text. No
piece goes on past a blank, so the lattice falls into words; equal words of a chunk
share one. Backward sums make every edge a conditional probability.

Distinct segmentations are drawn by Gumbel top-k without replacement, as perturbed
A-star search: a node of the search is the set of paths that share a prefix, the
perturbed value of a set is a Gumbel variable at the log of its mass, and the
largest child of a set has the set's own value. Popping the best node therefore
walks straight to a complete path, drawing edges by their probabilities; the edges
not taken at a step stay behind as one node, with a value truncated at its
parent's. The best of those is the next sample. All random numbers are hashes of
the row's key and of places in its text, so a row's samples do not depend on what
is near it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import chunks, frugal

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stands for a blank sign that is in the text itself; no valid text has it.
LITERAL = "\ud800"
CHUNK = 1 << 18
#: Edges of the lattices that a task keeps for units it may meet again.
STORED_EDGES = 2_000_000
#: Steps of a path whose nodes are looked at first.
NODES = 64
_ALL = (1 << 64) - 1


@dataclass
class Vocabulary:
    """Pieces by id, the bytes each decodes to, their log-weights, and byte pieces."""

    pieces: list[str]
    data: list[bytes]
    weights: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray


def read_model(path: str = MODEL, alpha: float = 1.0) -> Vocabulary:
    """The vocabulary of a model file, read on the driver.

    A unigram model's scores are its log-probabilities. The scores of a BPE model
    are merge ranks; their pieces get Zipf's law over the rank. ``alpha`` sharpens
    (over 1) or flattens the distribution.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1)
    data = []
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            data.append(bytes([int(p[3:5], 16)]))
        else:
            data.append(b"" if model.is_control(i) or model.is_unknown(i) else p.replace(BLANK, " ").encode())
    usable = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so it cannot encode every text")
    if any(BLANK in p.lstrip(BLANK) for p, u in zip(pieces, usable, strict=True) if u):
        raise ValueError("a piece of the model goes on past a blank")
    score = np.array([model.get_score(i) for i in range(n)])
    if score[usable].min() < -1000:  # merge ranks
        rank = np.empty(n)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        score = -np.log(rank + 2) - math.log(math.log(n))
    score[byte_ids] = score[usable].min()
    return Vocabulary(pieces, data, alpha * score, usable, byte_ids)


class Trie:
    """The usable pieces as a trie, looked up by vectors of (node, symbol)."""

    BITS = 18

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        symbols = sorted({c for p, u in zip(vocabulary.pieces, vocabulary.usable, strict=True) if u for c in p})
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in symbols]] = np.arange(len(symbols))
        index = {c: i for i, c in enumerate(symbols)}
        nodes: dict[tuple[int, int], int] = {}
        piece = [-1]
        for i, p in enumerate(vocabulary.pieces):
            if not vocabulary.usable[i]:
                continue
            at = 0
            for c in p:
                key = (at, index[c])
                if key not in nodes:
                    nodes[key] = len(piece)
                    piece.append(-1)
                at = nodes[key]
            piece[at] = i
        self.width = len(symbols)
        self.piece = np.array(piece)
        keys = np.array([a * self.width + b for a, b in nodes], np.int64)
        values = np.array(list(nodes.values()))
        self.keys, self.values = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # of those that want a free slot, the first gets it
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
        self.longest = max(len(p) for p, u in zip(vocabulary.pieces, vocabulary.usable, strict=True) if u)
        if self.longest > 127:
            raise ValueError("a piece of the model has over 127 characters")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node by its symbol, or -1; symbol -1 has no child."""
        keys = np.where(symbol < 0, -2, node * self.width + symbol)
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], -1)
        left = np.flatnonzero(~hit & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[slot[left]]
            hit = left[found == keys[left]]
            out[hit] = self.values[slot[hit]]
            left = left[(found != keys[left]) & (found >= 0)]
        return out


@dataclass
class Lattice:
    """The lattices of some units, end to end.

    Edges are grouped by the place they start at: ``first[place]`` up to
    ``last[place]``. ``cum`` adds up their conditional probabilities.
    """

    start: np.ndarray
    left: np.ndarray
    first: np.ndarray
    last: np.ndarray
    piece: np.ndarray
    size: np.ndarray
    logp: np.ndarray
    cum: np.ndarray


def spell(pieces: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids with symbols, which are below zero, spelled as byte pieces, and how many ids each gives."""
    bare = np.flatnonzero(pieces < 0)
    many = np.ones(len(pieces), np.int64)
    code = -1 - pieces[bare]
    code[code == ord(LITERAL)] = ord(BLANK)
    size = np.searchsorted([0x80, 0x800, 0x10000], code, "right") + 1
    many[bare] = size
    ids = np.repeat(pieces, many)
    at = (np.cumsum(many) - many)[bare]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    for k in range(4):
        on = size > k
        bits = code[on] >> (6 * (size[on] - 1 - k))
        ids[at[on] + k] = vocabulary.byte_ids[bits & 0x3F | 0x80 if k else bits | lead[on]]
    return ids, many


def lattice(units: list[str], trie: Trie) -> Lattice:
    """Edges and probabilities for non-empty units."""
    v = trie.v
    sizes = np.array([len(u) for u in units])
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = len(points)
    start = np.cumsum(sizes) - sizes
    left = np.repeat(start + sizes, sizes) - np.arange(n)
    symbol = np.append(trie.symbol[points], -1)
    at, node = np.arange(n), np.zeros(n, np.int64)
    found = []
    for k in range(trie.longest):
        if k:
            at, node = at[left[at] > k], node[left[at] > k]
        node = trie.step(node, symbol[at + k])
        on = np.flatnonzero(node >= 0)
        at, node = at[on], node[on]
        if not len(at):
            break
        piece = trie.piece[node]
        whole = np.flatnonzero(piece >= 0)
        found.append((at[whole], k + 1, piece[whole]))
    single = np.zeros(n, bool)
    if found and found[0][1] == 1:
        single[found[0][0]] = True
    # a symbol without a piece is spelled in bytes: one edge, named by the symbol below zero
    bare = np.flatnonzero(~single)
    kinds, which = np.unique(-1 - points[bare], return_inverse=True)
    ids, many = spell(kinds, v)
    cost = np.bincount(np.repeat(np.arange(len(kinds)), many), v.weights[ids], len(kinds))
    found.append((bare, 1, -1 - points[bare]))
    degree = np.zeros(n, np.int64)
    for where, _, _ in found:
        degree[where] += 1
    order = np.argsort(left.astype(np.int16) if left.max() < 32000 else left, kind="stable")
    first = np.empty(n, np.int64)
    sorted_degree = degree[order]
    begins = np.cumsum(sorted_degree) - sorted_degree
    first[order] = begins
    total = int(sorted_degree.sum())
    piece, size, w = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
    filled = first.copy()
    for where, length, ids in found:
        slot = filled[where]
        piece[slot], size[slot] = ids, length
        w[slot] = cost[which] if where is bare else v.weights[ids]
        filled[where] += 1
    owner = np.repeat(order, sorted_degree)
    back = np.zeros(n)
    cuts = np.searchsorted(left[order], np.arange(1, left.max() + 2))
    for t in range(1, int(left.max()) + 1):
        a, b = int(cuts[t - 1]), int(cuts[t])
        if a == b:
            continue
        lo, hi = int(begins[a]), int(begins[b - 1] + sorted_degree[b - 1])
        end = owner[lo:hi] + size[lo:hi]
        value = w[lo:hi]
        on = size[lo:hi] < t
        value[on] += back[end[on]]
        seg = begins[a:b] - lo
        top = np.maximum.reduceat(value, seg)
        back[order[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sorted_degree[a:b])), seg))
    logp = w - back[owner]
    p = np.exp(logp)
    run = np.cumsum(p)
    cum = run - np.repeat((run - p)[begins], sorted_degree)
    last = first + degree - 1
    cum[last] = 2.0  # no draw goes beyond
    return Lattice(start, left, first, last, piece, size, np.minimum(logp, 0.0), cum)


class Store:
    """The lattices of the units met so far, each built once; emptied when full."""

    def __init__(self, trie: Trie, edges: int = STORED_EDGES) -> None:
        self.trie, self.most = trie, edges
        self.known: dict[str, int] = {}
        self.units = self.places = self.edges = 0
        z = lambda kind: np.zeros(0, kind)
        self.lat = Lattice(z(np.int64), z(np.int32), z(np.int64), z(np.int64), z(np.int32), z(np.int8), z(np.float64), z(np.float32))

    def ids(self, units: list[str]) -> np.ndarray:
        """The numbers of distinct units; ``lat`` has all of them."""
        if self.edges > self.most:
            self.known.clear()
            self.units = self.places = self.edges = 0
        out = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        unmet = np.flatnonzero(out < 0)
        if len(unmet):
            new = [units[i] for i in unmet.tolist()]
            out[unmet] = np.arange(self.units, self.units + len(new))
            self.known.update(zip(new, out[unmet].tolist(), strict=True))
            self._add(lattice(new, self.trie))
        return out

    def _add(self, new: Lattice) -> None:
        units, places, edges = len(new.start), len(new.left), len(new.piece)
        for names, used, more, shift in (
            (("start",), self.units, units, self.places),
            (("left",), self.places, places, 0),
            (("first", "last"), self.places, places, self.edges),
            (("piece", "size", "logp", "cum"), self.edges, edges, 0),
        ):
            for name in names:
                held = getattr(self.lat, name)
                if len(held) < used + more:
                    grown = np.empty(max(used + more, len(held) * 3 // 2), held.dtype)
                    grown[:used] = held[:used]
                    held = grown
                    setattr(self.lat, name, held)
                held[used : used + more] = getattr(new, name) + shift if shift else getattr(new, name)
        self.units, self.places, self.edges = self.units + units, self.places + places, self.edges + edges


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(seed: np.ndarray, count: np.ndarray | int, kind: int) -> np.ndarray:
    """Numbers in (0, 1) from a seed, a count and what they are for."""
    return _next(_stream(seed, kind), count)


def _stream(seed: np.ndarray, kind: int) -> np.ndarray:
    return _mix(seed + np.uint64(kind * 0xD1B54A32D192ED03 % (1 << 64)))


def _next(stream: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    bits = _mix(stream + np.asarray(count, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _number(seed: int, count: int, kind: int) -> float:
    """What ``_uniform`` gives, for one place."""
    x = _scalar_mix((seed + kind * 0xD1B54A32D192ED03) & _ALL)
    return ((_scalar_mix((x + count * 0x9E3779B97F4A7C15) & _ALL) >> 11) + 0.5) / (1 << 53)


def _scalar_mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def walks(lat: Lattice, at: np.ndarray, seed: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A drawn path from each place to its unit's end: edges in a row, and their number."""
    count = np.zeros(len(at), np.int64)
    live, taken, step = np.arange(len(at)), [], 0
    cur, stream = at.copy(), _stream(seed, kind)
    while len(live):
        u = _next(stream, step)
        edge = lat.first[cur]
        more = np.flatnonzero(u >= lat.cum[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= lat.cum[edge[more]]]
        taken.append((live, edge))
        count[live] += 1
        on = lat.left[cur] > lat.size[edge]
        cur = (cur + lat.size[edge])[on]
        live, stream = live[on], stream[on]
        step += 1
    out = np.empty(int(count.sum()), np.int64)
    base = np.cumsum(count) - count
    for step, (who, edge) in enumerate(taken):
        out[base[who] + step] = edge
    return out, count


def _value_below(mass: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``mass`` (logs), truncated at ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, -(mass - np.log(-np.log(u))))


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp))."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(logp))


def _samples(lat: Lattice, places: np.ndarray, fresh: list[tuple[np.ndarray, np.ndarray]], seed: int, k: int) -> list[tuple[np.ndarray, float, float]]:
    """(edges, log-probability, log-inclusion) of up to ``k`` distinct paths of one row.

    ``fresh`` holds, for each sample, a drawn path over all units and the unit of
    each of its edges; ``places`` is where the units' lattices start.
    """
    s = np.array([seed], np.uint64)
    top = -math.log(-math.log(_number(seed, 0, 1)))
    paths, values, firsts, excluded, where, logs = [], [], [], [], [], []

    def add(edges: np.ndarray, at: np.ndarray, begin: int, value: float) -> None:
        """A path popped with ``value``; its nodes lie at the steps from ``begin`` on.

        The noise of a draw is between -4 and 38, so a node whose mass is 42 below
        that of ``k`` + 1 others is never popped nor bounds what is; the masses of
        prefixes only fall, so all nodes from some step on are left out.
        """
        lp = lat.logp[edges]
        end = min(len(edges), begin + NODES)
        total = np.cumsum(lp[:end])
        mass = total[begin:] - lp[begin:end] + _log_rest(lp[begin:end])
        if end < len(edges):
            enough = np.partition(mass, -k - 1)[-k - 1] if len(mass) > k else -np.inf
            if total[-1] >= enough - 42:
                total = np.cumsum(lp)
                end = max(end, int(np.searchsorted(-total, 42 - enough)) + 1) if enough > -np.inf else len(edges)
                mass = total[begin:end] - lp[begin:end] + _log_rest(lp[begin:end])
        u = _uniform(s, np.arange(begin, begin + len(mass)), 2 * len(paths) + 2)
        paths.append(edges)
        values.append(_value_below(mass, value, u))
        firsts.append(begin)
        excluded.append({})
        where.append(at)
        logs.append(float(lp.sum()))

    add(*fresh[0], 0, top)
    bound = -np.inf
    while True:
        tops = [v.max(initial=-np.inf) for v in values]
        bound = max(tops)
        best = tops.index(bound)
        if len(paths) == k or bound == -np.inf:
            break
        i = int(values[best].argmax()) + firsts[best]
        edges, at = paths[best], where[best]
        taken = excluded[best].setdefault(i, [int(edges[i])])
        # the place the step starts at: the unit's start and the sizes of its earlier edges
        unit = int(at[i])
        begin = int(np.searchsorted(at, unit))
        place = int(places[unit] + lat.size[edges[begin:i]].sum())
        options = [e for e in range(lat.first[place], lat.last[place] + 1) if e not in taken]
        p = np.exp(lat.logp[options])
        u = _number(seed, i, 1000 + len(paths))
        e = options[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u)), len(options) - 1)]
        prefix = float(lat.logp[edges[:i]].sum())
        taken.append(e)
        rest = [o for o in options if o != e]
        value = -np.inf
        if rest:
            noise = -math.log(-math.log(_number(seed, i, 2000 + len(paths))))
            value = -_log_add(-bound, -(prefix + float(np.logaddexp.reduce(lat.logp[rest])) + noise))
        values[best][i - firsts[best]] = value
        # on from the other edge: the rest of its unit, then the units after it
        tail, cur, step = [e], place + int(lat.size[e]), 0
        done = lat.left[place] == lat.size[e]
        while not done:
            u = _number(seed, (i << 20) + step, 3000 + len(paths))
            f = int(lat.first[cur])
            while u >= lat.cum[f]:
                f += 1
            tail.append(f)
            done = lat.left[cur] == lat.size[f]
            cur, step = cur + int(lat.size[f]), step + 1
        more, later = fresh[len(paths)]
        cut = int(np.searchsorted(later, unit + 1))
        new = np.concatenate([edges[:i], tail, more[cut:]])
        units = np.concatenate([at[:i], np.full(len(tail), unit), later[cut:]])
        add(new, units, i + 1, bound)
    return [(p, lp, float(_log_inclusion(lp - bound))) for p, lp in zip(paths, logs, strict=True)]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): the chance of a Gumbel variable above the bound."""
    if x == np.inf or x > 700:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def split(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of some texts, which of them follow one another, and their number in each text.

    A text gets a blank in front. A unit is a word with the blanks before it, or the
    blanks that end a text; an empty text has none.
    """
    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    # words hold no blank, so they become strings as one text
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py()
    words = (BLANK + joined.replace(BLANK, LITERAL).replace(" ", " " + BLANK)).split(" ")
    code, cuts = coded.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    if BLANK not in words:
        return words, code, np.diff(cuts)
    # two blanks in a row have an empty part between them
    begins, ends = cuts[:-1], cuts[1:]
    unit = code != words.index(BLANK)
    kept = np.flatnonzero(unit)
    row = np.repeat(np.arange(len(texts)), ends - begins)
    blanks = np.zeros(len(code), np.int64)
    blanks[kept] = kept - np.maximum(np.append(-1, kept)[:-1], begins[row[kept]] - 1)
    last = np.append(-1, kept)[np.searchsorted(kept, ends)]
    trail = ends - 1 - np.maximum(last, begins - 1)
    on = np.flatnonzero((trail > 0) & np.array([t != "" for t in texts], bool))
    unit[ends[on] - 1] = True
    blanks[ends[on] - 1] = trail[on]
    names, which = np.unique((blanks[unit] - 1) * len(words) + code[unit], return_inverse=True)
    return [BLANK * (n // len(words)) + words[n % len(words)] for n in names.tolist()], which, np.bincount(row[unit], minlength=len(texts))


def encode_chunk(texts: list[str], seeds: list[int], store: Store, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples: (piece ids, log-probability, log-inclusion)."""
    units, code, sizes = split(texts)
    if not units:
        return [[(np.zeros(0, np.int64), 0.0, 0.0)] for _ in texts]
    unit = store.ids(units)[code]
    lat = store.lat
    row_seed = np.repeat(np.array(seeds, np.uint64), sizes)
    ordinal = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seed = _mix(row_seed + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = []
    for j in range(k):
        edges, count = walks(lat, lat.start[unit], seed, 5000 + j)
        cuts = np.concatenate([[0], np.cumsum(count)])
        drawn.append((edges, np.repeat(ordinal, count), cuts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out, paths = [], []
    for r in range(len(texts)):
        if not sizes[r]:
            out.append([(None, 0.0, 0.0)])
            continue
        fresh = [(e[c[bounds[r]] : c[bounds[r + 1]]], o[c[bounds[r]] : c[bounds[r + 1]]]) for e, o, c in drawn]
        out.append(_samples(lat, lat.start[unit[bounds[r] : bounds[r + 1]]], fresh, seeds[r], k))
        paths += [path for path, _, _ in out[-1]]
    ids, many = spell(lat.piece[np.concatenate(paths)], store.trie.v)
    ends = np.append(0, np.cumsum(many))[np.cumsum([0, *map(len, paths)])].tolist()
    spelled = (ids[i:j] for i, j in pairwise(ends))
    return [[(ids[:0] if path is None else next(spelled), lp, inc) for path, lp, inc in row] for row in out]


def decode_ids(ids: np.ndarray, data: list[bytes]) -> bytes:
    """The UTF-8 bytes that piece ids stand for; the blank put before a text goes."""
    out = b"".join([data[i] for i in ids.tolist()])
    return out[1:] if out[:1] == b" " else out


class Decoder:
    """Decodes many rows of piece ids at once."""

    def __init__(self, data: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.size = np.array([len(d) for d in data])
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, rows: list[np.ndarray]) -> list[bytes]:
        """What ``decode_ids`` gives for each row."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        size = self.size[ids]
        end = np.cumsum(size)
        text = self.flat[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(size.sum()))].tobytes()
        cuts = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int)].tolist()
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [p[1:] if p[:1] == b" " else p for p in parts]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", samples: int = 2, seed: int = 0) -> DataFrame:
    """(id, sample, pieces, log_prob, log_inclusion, round_trip), up to ``samples`` rows a row.

    ``pieces`` are the piece ids of a segmentation of the whole text; a row's
    segmentations differ, and come in the order drawn. ``log_prob`` is the
    probability of the segmentation in the lattice, ``log_inclusion`` that of its
    perturbed value being over the next one's, which weighs samples without
    replacement. A text with fewer segmentations gives as many rows as it has. A
    null or empty text has one segmentation, without pieces. ``round_trip`` says
    whether the pieces decode to the text. Draws are seeded by the id as text
    (null: empty), so repeated rows get equal samples.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, decoder = Store(Trie(vocabulary)), Decoder(vocabulary.data)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in chunks([len(t) for t in texts], CHUNK):
                seeds = [xxhash.xxh64_intdigest(key, seed) for key in keys[i:j]]
                found = encode_chunk(texts[i:j], seeds, store, samples)
                flat = [(r, s, *x) for r, row in enumerate(found) for s, x in enumerate(row)]
                same = [back == texts[i + x[0]].encode() for back, x in zip(decoder([x[2] for x in flat]), flat, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in flat])])
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([x[2] for x in flat]), pa.int32()))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array([x[0] for x in flat])), pa.array([x[1] + 1 for x in flat], pa.int32()), pieces,
                        pa.array([x[3] for x in flat]), pa.array([x[4] for x in flat]), pa.array(same),
                    ],
                    ["id", "sample", "pieces", "log_prob", "log_inclusion", "round_trip"],
                )

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(frugal(run), f"id {kind}, sample int, pieces array<int>, log_prob double, log_inclusion double, round_trip boolean")


def decode(rows: DataFrame, vocabulary: Vocabulary, pieces: Column, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` and the ``text`` that the piece ids stand for; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.data)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            found = decoder([np.array(ids or [], int) for ids in rows])
            texts = [None if ids is None else t.decode("utf-8", "replace") for ids, t in zip(rows, found, strict=True)]
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    chosen = rows.select(pieces.alias("_pieces"), *keep)
    return chosen.mapInArrow(frugal(run), chosen.drop("_pieces").schema.add("text", "string"))
