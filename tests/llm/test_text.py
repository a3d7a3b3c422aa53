"""Personal data, licences, decontamination, and tokens."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold.llm import decontaminate, licenses, pii, sentencepiece

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"),
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple]:
    def sound(kind: str, hit: str) -> bool:
        d = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if sound(k, m.group())]


HARD = [
    "a@b.c.d@e.f x", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "+1 (988) 555-2485 4337166598464399", "4337 1665 9846 4399 4337166598464399",
    "éé a@b.co \U0001f600 +49 30 1234567 é", None, "", "@", "++1 22 333 4444 5", "x@y", "1.2.3.4 1.2.3.4", "a" * 30000 + "@b." + "c." * 3000 + "d", "1-" * 9000, "." * 20000,
]


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark)


def test_base_spans(spark, trees) -> None:
    rng = random.Random(8)
    noise = ["".join(rng.choice("a1.@+ -()2é5") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts = [*HARD, *noise]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans int, extra string")
    for r in pii.detect(df, trees).collect():
        expected = plain_spans(texts[r.id] or "")
        assert [tuple(x) for x in r.base] == expected, texts[r.id]
        assert set(expected) <= {tuple(x) for x in r.spans}


def test_candidates_are_selected_by_context(spark, trees) -> None:
    texts = [
        "call (555) 234-5678 today", "contact jo.smith [at] mail7 [dot] com soon", "visa card 4111.1111.1111.1111 was used",
        "order sku 555-123-4567 in stock", "they laughed at the dot com again",
    ]
    got = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees).orderBy("id").collect()
    assert [[s.kind for s in r.spans] for r in got] == [["phone"], ["email"], ["card"], [], []]
    assert texts[1][got[1].spans[0].start : got[1].spans[0].end] == "jo.smith [at] mail7 [dot] com"


def test_trees_in_sql_equal_trees_in_python(spark, trees) -> None:
    rng = np.random.default_rng(1)
    rows = [[int(rng.integers(0, 4)), *rng.integers(0, 3, len(pii.FEATURES) - 1).tolist()] for _ in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} int" for f in pii.FEATURES)).select(F.struct(*pii.FEATURES).alias("c"))
    got = [r.z for r in df.select(trees.column(F.col("c")).alias("z")).collect()]
    assert got == pytest.approx([trees.logit(np.array(r)) for r in rows])


def test_planted_items_are_found_by_what_documents_teach(spark) -> None:
    """Recall of rewritten items that fitting has not seen, and how few others are taken."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(spark, docs)
    rng = random.Random(77)
    prose = [r.text for r in docs.where("length(text) between 200 and 2000 and not text rlike '[0-9@]'").orderBy("doc_id").limit(200).collect()]
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, truth = [], {}
    for i, text in enumerate(prose):
        kind = pii.KINDS[i % 4]
        if kind == "card":
            body = "4" + num(14)
            body += next(c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(body + c))) % 10 == 0)
        plain = {"email": f"{rng.choice(('kim', 'ana.b', 'q_7'))}@{rng.choice(('mail', 'post-3'))}.{rng.choice(('com', 'org'))}", "ip": ".".join(str(rng.randint(1, 254)) for _ in range(4)), "card": body if kind == "card" else "", "phone": f"+1 ({rng.randint(200, 999)}) 555-{num(4)}"}[kind]
        hit = pii.defanged(kind, plain, rng)
        at = text.index(" ", len(text) // 2) + 1
        rows.append((i, text[:at] + hit + " " + text[at:]))
        truth[i] = (kind, at, at + len(hit))
    rows += [(1000 + i, t) for i, t in enumerate(prose)] + [(2000 + i, f"{t[:60]} {n} {t[60:]}") for i, t in enumerate(prose) for n in [num(16)] if not any(pii.KINDS[2] == s[0] for s in plain_spans(n))]
    got = {r.id: {tuple(x) for x in r.spans} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for kind in pii.KINDS:
        mine = [i for i, (k, *_) in truth.items() if k == kind]
        assert np.mean([truth[i] in got[i] for i in mine]) >= 0.9, kind
    assert not any(got[i] for i in got if i >= 1000)


def test_many_matches_take_time_in_proportion(spark, trees) -> None:
    texts = ["12 " * 3_000_000, "+1 555 234 5678 x " * 100_000, "(555) 234-5678, a@b.co 1.2.3.4 " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begin = time.perf_counter()
    got = {r.id: r for r in pii.detect(df, trees).selectExpr("id", "size(base) n", "get(base, size(base) - 1) last", "size(spans) m").collect()}
    clean = {r.doc_id: r.text for r in pii.redact(df, trees).collect()}
    assert time.perf_counter() - begin < 90
    assert [got[i].n for i in range(3)] == [0, 100_000, 80_000] and got[2].m == 120_000
    assert tuple(got[1].last) == ("phone", 99_999 * 18, 99_999 * 18 + 15) and tuple(got[2].last) == ("ip", 39_999 * 31 + 23, 39_999 * 31 + 30)
    assert clean == {0: texts[0], 1: "[PHONE] x " * 100_000, 2: "[PHONE], [EMAIL] [IP] " * 40_000}


def test_redaction_keeps_rows_and_columns(spark, trees) -> None:
    df = spark.createDataFrame([(i, t, None, "spans") for i, t in enumerate(HARD[:12])], "doc_id long, text string, lang string, spans string")
    got = pii.redact(df, trees).orderBy("doc_id")
    assert got.columns == df.columns
    texts = [r.text for r in got.collect()]
    assert texts[0] == "[EMAIL]@e.f x" and texts[5] == "éé [EMAIL] \U0001f600 [PHONE] é" and texts[6] is None and texts[7] == "" and texts[11] == "[IP] [IP]"
    assert pii.detect(df.limit(0), trees).collect() == []


def test_licences(spark) -> None:
    mit = licenses.TEXTS["MIT"]
    texts = [
        mit, "Copyright (c) 2020 Some One\n" + mit.upper().replace(" ", "  \n"), mit.replace("sublicense", "sub-license") + "\n(c) 2001 X. All rights reserved", mit + " more",
        licenses.TEXTS["0BSD"], None, "", "Prose.\nReleased under the MIT licence\nmore\nLICENSED UNDER CC-BY-NC 4.0!\n", "x" * 100000,
    ]
    df = spark.createDataFrame([(i, t, "d", "l") for i, t in enumerate([*texts, mit])], "doc_id long, text string, digest string, license string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    assert [got[i].license for i in range(9)] == ["MIT", "MIT", "MIT", None, "0BSD", None, None, None, None] and got[9].license == "MIT"
    assert got[7].notices == ["CC-BY-NC-4.0", "MIT"] and got[5].notices == [] and got[5].digest is None and got[6].digest is not None
    assert licenses.scan(df.limit(0)).collect() == []
    assert sum(len(r.notices) for r in got.values()) == 2
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("documents", pdf)
    rows = con.sql(licenses.oracle()).fetchall()
    assert {(r[0], r[1], r[2], r[3]) for r in rows} == {(i, r.digest, r.license, ",".join(r.notices)) for i, r in got.items()}


def test_licences_that_are_padded_wrapped_and_spelled_otherwise(spark) -> None:
    wrap = lambda t: "\n".join(" * " + w for w in t.split(" "))  # noqa: E731  a word a line
    bsd = licenses.TEXTS["BSD-2-Clause"].replace("HOLDER", "OWNER")
    texts = [
        "Released under the MIT License." + " -" * 400, "#" * 500 + "\tReleased under\tthe MIT licence !!", "x Released under the MIT License.",
        wrap(bsd), bsd.replace(" OWNER", "\n  OWNER"), licenses.TEXTS["MIT"].replace("sublicense", "sub-\nlicense").replace("NONINFRINGEMENT", "NON\nINFRINGEMENT"),
        wrap(licenses.texts()["Apache-2.0"]), licenses.texts()["GPL-3.0"].upper(), licenses.texts()["MPL-2.0"] + "\nCopyright 2020 us\n", "Free for all & sundry",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    notices = (*licenses.NOTICES, ("ANY", "free for all and sundry"))
    got = {r.id: r for r in licenses.scan(df, notices=notices).collect()}
    assert [got[i].notices for i in (0, 1, 2, 9)] == [["MIT"], ["MIT"], [], ["ANY"]]
    assert [got[i].license for i in range(3, 9)] == ["BSD-2-Clause", "BSD-2-Clause", "MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0"]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {(r[0], r[1], r[2]) for r in con.sql(licenses.oracle()).fetchall()} == {(i, r.digest, r.license) for i, r in got.items()}


def test_a_table_with_two_names_for_a_text(spark) -> None:
    df = spark.createDataFrame([(1, "some text"), (2, "other")], "doc_id long, text string")
    table = licenses.known(spark, {"a": "Some text"})
    two = table.union(table.withColumn("license", F.lit("b")))
    assert {(r.id, r.license) for r in licenses.scan(df, two).collect()} == {(1, "a"), (2, None)}
    assert licenses.scan(df, two).count() == 2


def smith_waterman(a: list, b: list) -> int:
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_against_the_table() -> None:
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(1, 6, (3, 9)).astype(np.uint64), rng.integers(1, 6, (3, 14)).astype(np.uint64)
        sizes, lengths = rng.integers(1, 10, 3), rng.integers(1, 15, 3)
        best, _ = decontaminate.align(a, sizes, b, lengths)
        assert best.tolist() == [smith_waterman(a[k, : sizes[k]].tolist(), b[k, : lengths[k]].tolist()) for k in range(3)]


def test_decontamination(spark) -> None:
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(30) for _ in range(5)] + [["too", "short"]]
    edited = [w for i, w in enumerate(items[1]) if i % 9]
    changed = [word() if i % 7 == 3 else w for i, w in enumerate(items[2])]
    texts = [
        " ".join(prose(200) + items[0] + prose(200)), " ".join(prose(3000) + edited), "X! ".join(w.upper() + "," for w in changed), " ".join(prose(300)), None, "",
        " ".join(items[3][:6] + prose(50)), " ".join(items[4]), "too short", " ".join(items[0]),
    ]
    texts[2] = " ".join(w.upper() + "," for w in changed)
    docs = spark.createDataFrame([(i, t, 0.0, "t") for i, t in enumerate(texts)] + [(9, texts[9], 0.0, "t")], "doc_id long, text string, score double, item string")
    bench = spark.createDataFrame([*[(i, " ".join(t)) for i, t in enumerate(items)], (90, None), (91, "")], "item_id long, text string")
    got = Counter((r.id, r.item) for r in decontaminate.search(docs, bench).collect())
    assert got == {(0, 0): 1, (1, 1): 1, (2, 2): 1, (7, 4): 1, (9, 0): 2}
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.search(docs, bench.limit(0)).collect() == [] and decontaminate.search(docs.limit(0), bench).collect() == []
    hit = next(r for r in decontaminate.search(docs, bench).collect() if r.id == 0)
    assert hit.score == 1.0 and (hit.first_word, hit.n_words) == (200, 30)


def found_by(items: list, texts: list, threshold: float = 0.6) -> dict:
    block = decontaminate.items_of(list(range(len(items))), [" ".join(i).encode() for i in items], 3)
    find = decontaminate._finder(block, 3, threshold)()
    return {(d, i): s for d, i, s, *_ in find([" ".join(t).encode() for t in texts])}


def test_recall_of_edited_copies_against_full_alignment() -> None:
    """Copies edited at random: what full Smith-Waterman of every pair finds is found."""
    rng = random.Random(21)
    vocabulary = ["v%d" % i for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 45))] for _ in range(12)]
    texts = []
    for _ in range(220):
        out = []
        rate = rng.choice((0.05, 0.15, 0.25, 0.35))
        for w in rng.choice(items):
            kind = rng.random()
            if kind < rate / 3:
                continue
            if kind < 2 * rate / 3:
                out.append(rng.choice(vocabulary))
                continue
            out.append(w)
            if kind < rate:
                out.append(rng.choice(vocabulary))
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + out + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))])
    got = found_by(items, texts)
    truth = {(d, i): smith_waterman(item, text) / (2 * len(item)) for d, text in enumerate(texts) for i, item in enumerate(items)}
    expected = {k: v for k, v in truth.items() if v >= 0.6}
    assert len(expected) > 120 and set(got) <= set(expected)
    assert all(got[k] == expected[k] for k in got)
    assert len(got) >= 0.98 * len(expected), len(got) / len(expected)


def test_rows_and_items_without_ids(spark) -> None:
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (-1, item), (-1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (-1, item + " more")], "item_id long, text string")
    got = Counter((r.id, r.item) for r in decontaminate.search(docs, bench).collect())
    assert got == {(None, None): 1, (None, -1): 1, (-1, None): 2, (-1, -1): 2}


def test_blocks_put_into_copies() -> None:
    item = [f"w{i}" for i in range(40)]
    for block in (20, 26, 28, 30, 31, 32):
        for at in (8, 20, 33):
            texts = [[f"f{k}" for k in range(before)] + item[:at] + [f"x{k}" for k in range(block)] + item[at:] + ["e"] * 90 for before in range(0, 120, 3)]
            true = smith_waterman(item, texts[5]) / 80
            got = found_by([item], texts)
            assert got == ({(d, 0): true for d in range(len(texts))} if true >= 0.6 else {}), (block, at)


def test_seeds_do_not_thin_as_the_corpus_grows(spark) -> None:
    item = [f"w{i}" for i in range(30)]
    # of the copy only the phrase w10 to w14 is whole; it is frequent, all others of the item are rare
    copy = [w if i in (12, 13, 14) or i % 3 else None for i, w in enumerate(item)]
    copy = [w or f"y{i}" for i, w in enumerate(copy)]
    assert smith_waterman(item, copy) >= 0.5 * 60
    for times in (1, 300):
        texts = [" ".join(copy), " ".join(item), *[f"{i} w10 w11 w12 w13 w14 {i}" for i in range(times)]]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        assert sorted(r.id for r in decontaminate.search(docs, bench, threshold=0.5).collect()) == [0, 1], times


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.read_model(alpha=0.2)


def segmentations(text: str, v) -> dict:
    index = {p: i for i, p in enumerate(v.pieces) if v.usable[i]}

    def paths(s: str) -> list:
        if not s:
            return [((), 0.0)]
        return [((index[s[:n]], *rest), w + v.weights[index[s[:n]]]) for n in range(1, len(s) + 1) if s[:n] in index for rest, w in paths(s[n:])]

    found = paths("▁" + text.replace(" ", "▁"))
    total = np.logaddexp.reduce([w for _, w in found])
    return {p: math.exp(w - total) for p, w in found}


def test_samples_without_replacement_follow_the_lattice(vocabulary) -> None:
    truth = segmentations("an ox", vocabulary)
    store = sentencepiece.Store(sentencepiece.Trie(vocabulary))
    n, first, pairs = 3000, Counter(), Counter()
    for row in sentencepiece.encode_chunk(["an ox"] * n, list(range(1, n + 1)), store, 3):
        found = [tuple(ids.tolist()) for ids, _, _ in row]
        assert len(set(found)) == 3
        assert all(math.exp(lp) == pytest.approx(truth[f], rel=1e-6) for f, (_, lp, _) in zip(found, row, strict=True))
        first[found[0]] += 1
        pairs[found[0], found[1]] += 1
    for p, q in truth.items():
        assert abs(first[p] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3
    best = sorted(truth, key=truth.get)[-3:]
    for a in best:
        for b in best:
            if a != b:
                q = truth[a] * truth[b] / (1 - truth[a])
                assert abs(pairs[a, b] / n - q) < 4 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_short_texts_run_out_of_segmentations(vocabulary) -> None:
    store = sentencepiece.Store(sentencepiece.Trie(vocabulary))
    row = sentencepiece.encode_chunk(["ox"], [1], store, 100)[0]
    truth = segmentations("ox", vocabulary)
    assert len(row) == len(truth) and sum(math.exp(lp) for _, lp, _ in row) == pytest.approx(1)
    assert all(inc == 0.0 for _, _, inc in row)


@given(st.lists(st.text(" ab\u2581\u00e9\n", max_size=9), max_size=6))
def test_units_are_words_with_the_blanks_before_them(texts) -> None:
    blank = sentencepiece.BLANK
    unit = re.compile(f"{blank}*[^{blank}]+|{blank}+")
    names, code, sizes = sentencepiece.split(texts)
    assert len(set(names)) == len(names)
    found = iter([names[i] for i in code])
    for text, size in zip(texts, sizes.tolist(), strict=True):
        marked = blank + text.replace(blank, sentencepiece.LITERAL).replace(" ", blank) if text else ""
        assert [next(found) for _ in range(size)] == unit.findall(marked)
    assert next(found, None) is None


@given(st.lists(st.one_of(st.integers(0, 31999), st.characters(exclude_categories=["Cs"])), max_size=20))
def test_symbols_without_a_piece_become_their_bytes(vocabulary, items) -> None:
    pieces = np.array([x if isinstance(x, int) else -1 - ord(x) for x in items], np.int64)
    ids, many = sentencepiece.spell(pieces, vocabulary)
    want = [[x] if isinstance(x, int) else vocabulary.byte_ids[list(x.encode())].tolist() for x in items]
    assert ids.tolist() == [i for w in want for i in w] and many.tolist() == [len(w) for w in want]


def test_round_trip(spark, vocabulary) -> None:
    texts = ["Hello world", " a  b\n\tü 中文 \U0001f600 ▁▁x ", "", None, " ", "x" * 4000, "é\u0000z", "same", "same"]
    df = spark.createDataFrame([(i if i < 8 else 7, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")
    rows = sentencepiece.encode(df, vocabulary, samples=3).collect()
    assert all(r.round_trip for r in rows)
    count = Counter(r.id for r in rows)
    assert count[2] == count[3] == 1 and count[0] == 3
    assert all(r.pieces == [] and r.log_prob == 0 for r in rows if r.id in (2, 3))
    same = [r for r in rows if r.id == 7]
    assert sorted(map(str, same[:3])) == sorted(map(str, same[3:]))
    back = sentencepiece.decode(spark.createDataFrame(rows), vocabulary, F.col("pieces"), [F.col("id")]).collect()
    assert {(r.id, r.text) for r in back} == {(i, t or "") for i, t in enumerate(texts[:8])}
    again = sentencepiece.encode(df.repartition(3), vocabulary, samples=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sentencepiece.encode(df.limit(0), vocabulary).collect() == []
