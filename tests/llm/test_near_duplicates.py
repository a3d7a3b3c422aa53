"""SimHash and embedding near-duplicates against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidefold.llm import embeddings, simhash
from tidefold.llm.graph import components, spanning_forest
from tidefold.llm.hashing import xxh64


def union_find(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_xxh64_of_ranges() -> None:
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    starts = np.arange(150)
    for size in (0, 1, 3, 4, 7, 8, 13, 31, 32, 100):
        got = xxh64(data, starts, starts + size)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[i : i + size], 42) for i in starts]


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("few", [0, 5, 1 << 20])
def test_components(spark, few) -> None:
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1200)]
    expected = union_find(1300, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long"), few).collect()}
    assert all(expected[k] == v for k, v in got.items())
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    a, b = spanning_forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert union_find(1300, zip(a.tolist(), b.tolist(), strict=True)) == expected


TEXTS = [
    None, "", "  \t\n", "One", "one", "one two", "the cat sat on the mat today", "The CAT sat on the mat today", "quite another text is here now",
    "É é accents stay", "tie", "tie", "x" * 5000, " ".join(["w%d" % (i % 7) for i in range(3000)]),
]


def test_simhash_of_odd_texts(spark) -> None:
    rows = [(i, t, 1, "c") for i, t in enumerate(TEXTS)] + [(None, "one two", 2, "d"), (5, "one two", 3, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for t in TEXTS]
    assert {(r.id, r.fp % (1 << 64)) for r in got if r.id is not None} == set(enumerate(prints))
    pairs = [(a, b) for a in range(len(TEXTS)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = union_find(len(TEXTS), pairs)
    assert {(r.id, r.component) for r in got if r.id is not None} == {(i, roots[i]) for i in range(len(TEXTS))}
    assert [r.component for r in got if r.id is None] == [roots[5]]
    kept = simhash.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(roots))


def test_keeping_the_first_of_odd_rows(spark) -> None:
    other = "quite another text that has not one word of it in common with any"
    rows = [
        (42, "a text of some words", "x"), (42, "a text of some words", "x"), (42, other, "y"), (50, "A TEXT of some words", "z"),
        (None, None, "n"), (None, other + " but more, and then some on top of that", "m"), (None, other, "o"), (60, "", "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumn("_text_hash", F.lit("mine"))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text), r._id, r._text_hash) for r in kept.collect())
    assert got == sorted([("42", rows[0][1], "x", "mine"), ("42", other, "y", "mine"), ("60", "", "e", "mine"), ("None", rows[5][1], "m", "mine")])


def test_simhash_of_nothing(spark) -> None:
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("slice_rows", [1024, 16])
def test_links_against_all_pairs(spark, slice_rows, monkeypatch) -> None:
    monkeypatch.setattr(simhash, "FRONTIER", 1 << 8)  # buckets are taken few at a time
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    near = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)]
    codes = list({*near, *(int(x) for x in rng.integers(0, 1 << 63, 200))})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 3, slice_rows).collect()
    at = {c: i for i, c in enumerate(signed)}
    brute = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3]
    assert all((codes[at[e.a]] ^ codes[at[e.b]]).bit_count() >= 0 for e in edges)
    assert union_find(len(codes), [(at[e.a], at[e.b]) for e in edges]) == union_find(len(codes), brute)


def test_block_masks_hold_every_close_pair() -> None:
    rng = random.Random(2)
    for n in (10, 10**8, 10**12):
        masks = [m % (1 << 64) for m in simhash._blocks(n, 3)]
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(m & diff == 0 for m in masks)


def brute_vectors(rows: list) -> dict:
    sound = [v is not None and len(v) > 0 and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links: dict = {i: 0 for i in range(len(rows))}
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    pairs.append((a, b))
    roots = union_find(len(rows), pairs)
    return {rows[i][0]: (links[i], rows[roots[i]][0], roots[i] == i) for i in range(len(rows))}


def test_embeddings_against_all_pairs(spark, monkeypatch) -> None:
    monkeypatch.setattr(embeddings, "INTERVAL_NUMBERS", 12 * 20)
    monkeypatch.setattr(embeddings, "GROUP", 3)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    monkeypatch.setattr(embeddings, "PARTS", 5)
    rng = np.random.default_rng(4)
    rows: list = []
    for i in range(260):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=12)
        else:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) * rng.uniform(0.5, 2) + rng.normal(size=12) * 0.08 * (i % 4)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(300, None, 0), (301, [0.0] * 12, 0), (302, [math.nan] * 12, 0), (303, [math.inf] + [1.0] * 11, 0), (304, [None] + [1.0] * 11, 0)]
    rows += [(305, [1.0] * 12, None), (306, [1.0] * 12, 1), (307, [1.0] * 12, 1), (308, [2.0] * 12, 1), (309, [], 1), (310, [1.0, 1.0], 1), (311, [1.0, 1.01], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.id: (r.n_links, r.component, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)


def test_interval_join_drops_distant_parts(monkeypatch) -> None:
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(6)
    centres = np.eye(16)[rng.integers(0, 16, 900)]
    x = embeddings.unit(centres + rng.normal(size=(900, 16)) * 0.04)
    points = x @ embeddings.principal_axes(x, 8)
    order = np.lexsort(np.floor(points / embeddings.epsilon_of(0.98)).T[::-1])
    x, points = x[order], points[order]
    compared = []
    inner = embeddings._compared

    def counting(x, y, i, j, cosine, same):
        compared.append(len(i))
        return inner(x, y, i, j, cosine, same)

    monkeypatch.setattr(embeddings, "_compared", counting)
    for lo, hi in ((0, 900), (300, 501)):
        y, py = x[lo:hi], points[lo:hi]
        same = hi == 900
        got = {(int(i), int(j)) for p, q in embeddings.ego_join(x, y, points, py, 0.98, same) for i, j in zip(p, q, strict=True)}
        i, j = np.nonzero(x @ y.T >= 0.98)
        assert got == {(int(a), int(b)) for a, b in zip(i, j, strict=True) if not same or a < b} and got
    assert sum(compared) < 0.3 * (225 * 226 / 2 + 225 * 51)


def test_no_embeddings(spark) -> None:
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []
