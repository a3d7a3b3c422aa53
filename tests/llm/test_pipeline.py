"""The corpus pipeline on the smallest tables, and the registry."""

from __future__ import annotations

import random
import tempfile

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from pyspark.sql.types import StructType

from tidefold.llm import registry, sentencepiece, simhash
from tidefold.llm.common import load

DATA = "/root/testdata/sf0.001"


def test_stages(spark) -> None:
    docs = load(spark, DATA, "documents")
    names, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == names, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in out} == seen and all(r.round_trip for r in out)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == seen


def test_empty_tables_and_nulls(spark) -> None:
    docs = load(spark, DATA, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "words of a text", None, None, 3), (1, "", None, None, 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []
        assert len(stage(spark, odd, DATA).collect()) <= 6


def test_stages_take_odd_rows_and_other_columns(spark) -> None:
    docs = load(spark, DATA, "documents")
    long = " ".join(["the house of the green water and a word"] * 20_000)
    prose = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(3).collect()]
    rows = [
        (1, prose[0], "en", "s", 5), (1, prose[0], "en", "s", 5), (2, prose[0], None, None, None), (3, long, "en", "s", 9), (3, prose[1], "en", "s", 9),
        (None, prose[2], "de", "s", 1), (None, None, None, None, None), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 0), (6, prose[1] + " call +1 555 234 5678 now", "en", "s", 0),
    ]
    odd = spark.createDataFrame([(*r, "mine", 7, 0.5) for r in rows], StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, _id int, score double").fields]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, DATA).collect()
        assert stage(spark, odd, DATA).columns == odd.columns, name
        assert all(r.lang_pred == "mine" and r._id == 7 and r.score == 0.5 for r in kept), name
        ids = sorted(str(r.doc_id) for r in kept)
        if name == "personal_data":
            assert len(kept) == len(rows) and sum("[PHONE]" in (r.text or "") for r in kept) == 1
        if name == "decontamination":
            assert len(kept) == len(rows)
        if name == "language":
            assert ids == sorted(str(r[0]) for r in rows if r[1] and r[1] != "12 34")
        if name == "near_duplicates":
            assert ids.count("1") == 1 and "2" not in ids and ids.count("3") == 2
    without = odd.drop("n_chars", "lang")
    assert corpus_pipeline.personal_data(spark, without, DATA).columns == without.columns
    assert corpus_pipeline.tokens(spark, odd, DATA).where("not round_trip").count() == 0


def test_run_against_the_stages_by_brute_force(spark) -> None:
    """``run`` gives what is left by a plain version of each filter, on a small fixture."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "zu")]
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [prose(25) for _ in range(3)]
    texts = [prose(rng.randint(30, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5].upper(), prose(40) + " " + items[0] + " " + prose(30), items[2], "", "1234 5678", None, texts[7] + " a@b.co"]
    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
    kept, seen = [], []
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            continue
        fp = int(simhash.fingerprints_of([t.encode()])[0])
        if any((fp ^ g).bit_count() <= 3 for g in seen):
            continue
        seen.append(fp)
        if not any(" ".join(item.split()) in t.lower() for item in items):
            kept.append(i)
    assert sorted({r.doc_id for r in out}) == kept and all(r.round_trip for r in out)
    last = next(r for r in out if r.doc_id == len(texts) - 1) if len(texts) - 1 in kept else None
    if last is not None:
        ids = sentencepiece.read_model()
        text = sentencepiece.decode_ids(np.array(last.pieces), ids.data).decode()
        assert text == texts[-1].replace("a@b.co", "[EMAIL]")


def test_every_operator_is_registered(spark) -> None:
    names = {n.split("_")[0] for n in registry.queries()}
    assert names == {f"op{i}" for i in range(1, 11)}
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    for name, query in registry.queries().items():
        assert query(spark, DATA).count() > 0, name
