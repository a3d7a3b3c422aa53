"""Suffix sorting, and removal of repeated substrings, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidefold.llm import substrings, suffix
from tidefold.llm.suffix import suffix_array


@pytest.mark.parametrize(("memory", "block", "ranges"), [(1 << 20, 1 << 17, 1024), (5, 7, 3), (40, 16, 1024), (0, 1, 1)])
def test_suffix_array(memory, block, ranges, monkeypatch) -> None:
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "RANGES", ranges)
    rng = np.random.default_rng(1)
    for trial in range(120):
        text = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 120))).astype(np.uint16)
        text = np.tile(text[: max(1, len(text) // 5)], 5) if trial % 3 == 0 else text
        depth = int(rng.integers(1, 20))
        order, common = suffix_array(text, depth, memory)
        keys = [tuple(text[i : i + depth].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], common[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == depth


def test_sorting_far_beyond_memory(monkeypatch) -> None:
    """With a budget of a hundredth of the text, names are sorted by recursion and files are used."""
    rng = np.random.default_rng(2)
    words = [rng.integers(97, 107, int(rng.integers(2, 9))) for _ in range(300)]
    text = np.concatenate([words[i] for i in rng.integers(0, 300, 12_000)]).astype(np.uint16)
    inner, disk = [], []
    order_of_names, put, empty = suffix._order_of_names, suffix.BlockQueues.put, suffix.Arena.empty
    monkeypatch.setattr(suffix, "_order_of_names", lambda text, *a: (inner.append(len(text)), order_of_names(text, *a))[1])
    monkeypatch.setattr(suffix.BlockQueues, "put", lambda self, *a: (put(self, *a), disk.append(self.file is not None))[0])
    monkeypatch.setattr(suffix.Arena, "empty", lambda self, *a: (empty(self, *a), disk.append(self.on_disk > 0))[0])
    order, common = suffix_array(text, 30, len(text) // 100)
    assert len(inner) >= 2 and inner == sorted(inner, reverse=True) and inner[0] > 10 * (len(text) // 100) and sum(disk) > len(disk) / 2
    padded = np.concatenate([text, np.zeros(30, np.uint16)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, 30)[: len(text)][order]
    differ = keys[1:] != keys[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), 30)
    at = np.minimum(first, 29)[:, None]
    assert (np.take_along_axis(keys[1:], at, 1) >= np.take_along_axis(keys[:-1], at, 1)).all()
    assert (common[1:] == np.minimum(first, len(text) - np.maximum(order[1:], order[:-1]))).all()


def brute(rows: list) -> dict:
    out = {}
    for i, text in rows:
        data = (text or "").encode()
        earlier = {t[k : k + 50] for j, x in rows if j is not None and i is not None and j < i for t in [(x or "").encode()] for k in range(len(t) - 49)}
        mask = bytearray(len(data))
        for k in range(len(data) - 49):
            if data[k : k + 50] in earlier:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(data, mask, strict=True) if not m)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i, text] = (len(data), sum(mask), runs, kept)
    return out


def test_removal_against_brute_force(spark) -> None:
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows: list = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p)) for _ in range(2))
            parts += [p[a:b] if rng.random() < 0.5 else p, word()]
        rows.append((i, "".join(parts)))
    rows += [(70, None), (71, ""), (72, "x" * 49), (73, "x" * 400), (74, "x" * 51), (75, "ab" * 300), (76, "ba" * 300), (77, rows[3][1]), (77, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, kept string").repartition(5)
    got = substrings.remove_repeats(df).collect()
    expected = brute(rows)
    assert len(got) == len(rows)
    by_id = {i: v for (i, _), v in expected.items()}
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == by_id[r.id], r.id


def test_slices_of_long_documents(spark, monkeypatch) -> None:
    monkeypatch.setattr(substrings, "CHUNK", 100)
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, long), (2, long[700:1500]), (3, "q" + long[100:2900] + "q"), (4, long)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v for (i, _), v in brute(rows).items()}


@pytest.mark.parametrize("held", [100, 1 << 20])
def test_hot_line_in_many_contexts(spark, monkeypatch, tmp_path, held) -> None:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line, longer = "all rights reserved by the owners of it 45678", "this line has rather more bytes than a window, so all of it repeats"
    rows = [(i, f"{word()} {word()} {rng.choice('xyz')}{line}{rng.choice('pqr')} {word()} {word()} {word()}{longer}{word()}") for i in range(150)]
    rows += [(i, f"{line}{rng.choice('pqr')} a {line}{rng.choice('pqr')} b {line}") for i in range(150, 170)]
    rng.shuffle(rows)
    monkeypatch.setattr(substrings, "HOT", 20)
    monkeypatch.setattr(substrings, "HELD", held)
    put, sorted_ = substrings._Sorter.put, tmp_path / "sorted"

    def counting(self, rows):
        with open(sorted_, "a") as file:
            file.write("".join(f"{len(r[4])}\n" for r in rows))
        put(self, rows)

    monkeypatch.setattr(substrings._Sorter, "put", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(df).collect()}
    assert got == {i: v for (i, _), v in brute(rows).items()}
    pieces = [int(x) for x in sorted_.read_text().split()] if sorted_.exists() else []
    assert sum(pieces) < sum(len(t) for _, t in rows) / 20, "what surrounds a hot line is sorted in one place"


def test_shards_far_larger_than_memory(spark, monkeypatch, tmp_path) -> None:
    """The query's own sort, with a budget far below its shard, uses files and recursion."""
    monkeypatch.setattr(suffix, "MEMORY_TUPLES", 200)
    monkeypatch.setattr(suffix, "BLOCK", 512)
    used = tmp_path / "used"
    empty, inner = suffix.Arena.empty, suffix._order_of_names

    def noting(self, *a):
        out = empty(self, *a)
        if self.on_disk:
            used.write_text(f"{used.read_text() if used.exists() else ''}disk {self.on_disk}\n")
        return out

    def recursing(text, *a):
        used.write_text(f"{used.read_text() if used.exists() else ''}names {len(text)}\n")
        return inner(text, *a)

    monkeypatch.setattr(suffix.Arena, "empty", noting)
    monkeypatch.setattr(suffix, "_order_of_names", recursing)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(40)]
    rows = []
    for i in range(120):
        p = rng.choice(passages)
        a = rng.randrange(len(p) // 2)
        rows.append((i, f"{word()} {p[a : a + rng.randint(60, 120)]} {word()} {rng.choice(passages)[:100]}{word()}"))
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {i: v for (i, _), v in brute(rows).items()}
    lines = used.read_text().splitlines()
    assert max(int(x.split()[1]) for x in lines if x.startswith("disk")) > 16 * 200 * 5
    assert sorted({int(x.split()[1]) for x in lines if x.startswith("names")})[-1] > 200


def test_nothing(spark) -> None:
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
