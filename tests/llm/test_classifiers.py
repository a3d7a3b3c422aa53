"""Toxicity, language and quality: held-out accuracy and odd inputs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidefold.llm import language, quality, toxicity

ODD = [None, "", " \n", "12 34 !!", "a" * 20000]


def text(rng: random.Random, letters: str, n: int) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_toxicity_is_learned_and_found_in_long_texts(spark) -> None:
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = text(rng, "abcdefgh", 60).split()
        if bad:
            words[rng.randrange(60)] = "zw" + rng.choice("abc") * 2 + "oq"
        rows.append((i, " ".join(words).upper() if i % 3 == 0 else " ".join(words)))
        if i < 300:
            labels.append((i, int(bad)))
    labels += [(0, None), (1, 7), (None, 1), (5, 0), (5, 0)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, text(rng, "abcdefgh", 300) + " zwaaoq " + text(rng, "abcdefgh", 300) + " zwbboq zwccoq"), (None, "plain"), (7, "plain")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), rows_per_class=100)
    found = toxicity.predict(df, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    by = {r.id: r.predicted for r in found}
    held = [i for i in range(300, 400)]
    assert np.mean([by[i] == int(i % 4 == 0) for i in held]) > 0.95
    assert by[2000] == 1 and all(by[1000 + k] == 0 for k in range(len(ODD)))


def test_toxicity_without_both_classes(spark) -> None:
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    for rows, expected in (([], 0), ([(1, 0)], 0), ([(1, 1)], 1)):
        model = toxicity.fit(df, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.predict(df, model).collect()} == {expected}
    assert toxicity.predict(df.limit(0), model).collect() == []


def test_language(spark) -> None:
    rng = random.Random(2)
    kinds = {"aa": "abcdet", "bb": "etnopq", "cc": "éèàçat"}
    rows = [(i, text(rng, kinds[k], rng.randint(3, 80)), k) for i, k in enumerate(list(kinds) * 120)]
    train = spark.createDataFrame([*rows[:240], (900, None, "aa"), (901, "zz", None)], "doc_id long, text string, lang string")
    prototypes = language.fit(train, rows_per_language=50)
    assert list(prototypes) == ["aa", "bb", "cc"]
    odd = [(1000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "пример текста 中文", None)]
    test = spark.createDataFrame([*rows[240:], *odd], "doc_id long, text string, lang_pred string")
    found = language.predict(test, prototypes).collect()
    assert sorted(map(str, found)) == sorted(map(str, language.predict(test.drop("lang_pred"), prototypes).collect()))
    kept = language.keep_known(test, prototypes, 0.05)
    assert kept.columns == test.columns and {r.doc_id for r in kept.collect()} == {r.id for r in found if r.lang_pred != "und" and r.score >= 0.05}
    by = {r.id: r for r in found}
    assert len(found) == len(rows) - 240 + len(odd)
    assert np.mean([by[i].lang_pred == k for i, _, k in rows[240:]]) > 0.97
    assert all(by[1000 + k].lang_pred == "und" and by[1000 + k].score == 0 for k in range(4)) and by[1004].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in found)
    assert by[None].score < 0.2
    nothing = language.fit(train.limit(0))
    assert nothing == {} and {r.lang_pred for r in language.predict(test.drop("lang_pred"), nothing).collect()} == {"und"}


def test_hypervectors_are_additive() -> None:
    table = language.letter_table()
    one = language.profiles(["abc", "abc abc", "é"], 256, 3, table)
    assert np.allclose(np.linalg.norm(one, axis=1), 1) and one[0] @ one[1] > 0.9
    assert len(language.grams_of("1 2 3", table)[0]) == 0


def test_profiles_against_the_definition(monkeypatch) -> None:
    """Every n-gram one by one: rotate, multiply, add up, scale."""
    monkeypatch.setattr(language, "GRAMS_AT_ONCE", 7)
    texts = ["Das Haus, das 2 Häuser", "дом и дома", "", "中文文本 中文", "a"]
    got = language.profiles(texts, 128, 5, language.letter_table())
    for text, row in zip(texts, got, strict=True):
        letters = [0]
        for c in text.lower():
            if c.isalpha() or letters[-1]:
                letters.append(ord(c) if c.isalpha() else 0)
        letters += [0] if letters[-1] else []
        total = np.zeros(128)
        for gram in zip(letters, letters[1:], letters[2:], strict=False):
            bound = np.ones(128)
            for place, letter in enumerate(gram):
                bound *= np.roll(language.letter_vectors(np.array([letter]), 128, 5)[0], place)
            total += bound
        assert np.allclose(row, total / max(np.linalg.norm(total), 1e-30), atol=1e-5)


def test_languages_of_many_scripts(spark) -> None:
    rng = random.Random(4)
    cyrillic, greek, arabic = "абвгдежзиклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    cjk = "".join(chr(0x4E00 + i) for i in range(400))
    kinds = {"ru": cyrillic[:24], "uk": cyrillic[6:], "el": greek, "ar": arabic[:22], "fa": arabic[6:], "zh": cjk[:260], "ja": cjk[140:]}
    words = {k: text(rng, letters, 60).split() for k, letters in kinds.items()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(8, 60))), k) for i, k in enumerate(list(kinds) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(df.where("doc_id >= 280"), language.fit(df.where("doc_id < 280"))).collect()
    truth = {i: k for i, _, k in rows}
    assert np.mean([r.lang_pred == truth[r.id] for r in found]) > 0.97
    points = np.array([ord(c) for c in cyrillic + greek + arabic + cjk])
    assert len({v.tobytes() for v in language.letter_vectors(points, 256, 7)}) == len(points)


def test_quality_shrinks_sparse_sites(spark) -> None:
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        host = "good" if i % 2 else "bad"
        good = rng.random() < (0.9 if host == "good" else 0.2)
        rows.append((i, " ".join(rng.choice(["the", "house", "of", "green"]) for _ in range(40)) if good else "$$ ## " * rng.randint(3, 30), host, f"p{i % 3}"))
        labels.append((i, int(good)))
    rows += [(5000 + k, t, None, None) for k, t in enumerate(ODD)] + [(6000, rows[1][1], "new", "x"), (None, "text", "good", "p1")]
    labels += [(6000, 0), (0, None), (None, 1)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, host string, path string, score double")
    found = quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path"), learn=F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.id: r for r in found}
    truth = dict(x for x in labels if x[0] is not None and x[0] < 600 and x[1] is not None)
    assert np.mean([by[i].keep == bool(y) for i, y in truth.items() if i % 5 == 0]) > 0.97
    assert by[1].host_rate > 0.8 and by[0].host_rate < 0.3
    assert 0.2 < by[6000].host_rate < 0.8  # one label hardly moves a new site
    none = quality.score(df, spark.createDataFrame([], "doc_id long, quality int"), F.col("host"), F.col("path")).collect()
    assert {r.score for r in none} == {0.5} and all(r.keep for r in none)
    assert quality.score(df.limit(0), spark.createDataFrame([], "doc_id long, quality int"), F.col("host"), F.col("path")).collect() == []


def test_quality_learns_words_and_adds_up_as_stated(spark, monkeypatch) -> None:
    monkeypatch.setattr(quality, "HOT_SHARE", 0.2)  # so that some sites are hot and some are not
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(500):
        good = i % 2
        words = text(rng, "abcdefgh", 40).split()
        words[rng.randrange(40)] = rng.choice(("zorbam", "quilip", "vextor")) if good else rng.choice(("nyxol", "wumpat", "jikker"))
        rows.append((i, " ".join(words), rng.choice("hhhij"), f"p{i % 3}"))
        if i < 400:
            labels.append((i, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    found = {r.id: r for r in quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    assert len(found) == 500 and np.mean([found[i].keep == bool(i % 2) for i in range(400, 500)]) >= 0.9
    # the site posteriors, recomputed in plain Python
    y = dict(labels)
    rate = (sum(y.values()) + 1) / (len(y) + 2)

    def strength(groups: dict) -> float:
        n, g = np.array([len(v) for v in groups.values()], float), np.array([sum(v) for v in groups.values()], float)
        mean = g.sum() / n.sum()
        noise = mean * (1 - mean)
        between = ((n * (g / n - mean) ** 2).sum() - (len(n) - 1) * noise) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9)
        return quality.STRONGEST if between <= noise / quality.STRONGEST else min(max(noise / between - 1, quality.WEAKEST), quality.STRONGEST)

    hosts: dict = {}
    sites: dict = {}
    for i, _, h, p in rows:
        if i in y:
            hosts.setdefault(h, []).append(y[i])
            sites.setdefault((h, p), []).append(y[i])
    wide, near = strength(hosts), strength(sites)
    for i, _, h, p in rows:
        host_rate = (sum(hosts[h]) + wide * rate) / (len(hosts[h]) + wide)
        path_rate = (sum(sites[h, p]) + near * host_rate) / (len(sites[h, p]) + near)
        r = found[i]
        assert abs(r.host_rate - host_rate) < 1e-9 and abs(r.path_rate - path_rate) < 1e-9
        assert abs(r.score - 1 / (1 + np.exp(-(r.evidence + np.log(path_rate / (1 - path_rate)))))) < 1e-9


def test_quality_learns_from_every_label(spark) -> None:
    """With 5,000 good rows the counts, the weight and the rate are still those of all rows."""
    rng = random.Random(8)
    y = np.array([float(i % 6 != 0) for i in range(6000)])
    rows = [(i, " ".join([*rng.choices(["la", "mo", "tiru"], k=5), rng.choice(["zorbam", "nyxol", "zorbam" if y[i] else "nyxol"])]), f"h{i % 3}", "p") for i in range(6000)]
    rows[5] = (5, "seenonce", "h2", "p")
    df = spark.createDataFrame([*rows, (9000, "zorbam mo", "new", "p")], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, quality int")
    found = {r.id: r for r in quality.score(df, labels, F.col("host"), F.col("path")).collect()}
    assert len(found) == 6001 and abs(found[9000].host_rate - 5001 / 6002) < 1e-9  # no label of its own
    bins = df.where("doc_id < 9000").select("doc_id", quality.features(F.col("text")).alias("codes"), quality._half("doc_id").alias("half")).orderBy("doc_id").collect()
    codes = [np.append(w, np.array(r.codes) + quality.WORD_CODES) for w, r in zip(quality.codes_of([t.encode() for _, t, _, _ in rows]), bins, strict=True)]
    z = np.zeros(6000)
    for half in (0, 1):
        other = [i for i, r in enumerate(bins) if r.half != half]
        ratio = quality.naive_bayes([codes[i] for i in other], y[other])
        for i, r in enumerate(bins):
            if r.half == half:
                z[i] = ratio[codes[i]].sum()
    weight, ratio = quality.weight_of(z, y), quality.naive_bayes(codes, y)
    assert 0.5 < weight <= 1
    assert max(abs(found[i].evidence - weight * ratio[codes[i]].sum()) for i in range(6000)) < 1e-6


def test_packed_codes_come_back() -> None:
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, rng.choice([3, 300, 30000, quality.CODES]), n)) for n in rng.integers(1, 400, 300)]
    rows += [np.array([0]), np.array([quality.CODES - 1]), np.array([0, quality.CODES - 1]), np.array([127, 254, 382, 16765, 33149])]
    for some in (rows, rows[:1], []):
        codes, sizes = quality.unpack(pa.array(quality.pack(some), pa.binary()))
        assert sizes.tolist() == [len(r) for r in some] and codes.tolist() == [c for r in some for c in r]


def test_naive_bayes_against_counting() -> None:
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, rng.integers(1, 9))) for _ in range(80)]
    y = (rng.random(80) < 0.3).astype(float)
    got = quality.naive_bayes(rows, y)
    share = (y.sum() + 1) / 82
    for code in range(31):
        g = sum(code in r for r, k in zip(rows, y, strict=True) if k)
        b = sum(code in r for r, k in zip(rows, y, strict=True) if not k)
        expected = np.log((g + 2 * share) / (y.sum() + 2) / ((b + 2 * (1 - share)) / (80 - y.sum() + 2))) if g + b else 0
        assert abs(got[code] - expected) < 1e-9
    z = rng.normal(size=4000)
    assert abs(quality.weight_of(z, (rng.random(4000) < 1 / (1 + np.exp(-0.4 * z))).astype(float)) - 0.4) < 0.1


def test_toxicity_scores_against_the_formula(spark) -> None:
    """Every n-gram of every text one by one, hashed as stated, weighed and added up."""
    rng = random.Random(30)
    rows = [(i, text(rng, "abcdé", 30) + (" qx" * (i % 2))) for i in range(120)] + [(500 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int"), features=300)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert 0 < len(weight) <= 300

    def bucket(gram: str) -> int:
        state = ord(gram[0])
        for c in gram[1:]:
            state = (state * 0x01000193 + ord(c)) % (1 << 32)
        return ((state ^ (state >> 15)) * 0x85EBCA6B + len(gram)) % (1 << 32) >> 12

    for r in toxicity.predict(df, model).collect():
        lowered = (dict(rows)[r.id] or "").lower()
        present = {bucket((lowered + toxicity.GAP)[i : i + n]) for n in toxicity.GRAMS for i in range(len(lowered))}
        logit = model.bias + sum(weight.get(b, 0.0) for b in present)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-9, r.id
