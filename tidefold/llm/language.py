"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram is the product of its
letters' vectors, each rotated by its place (binding of permuted vectors); a text
is the sum of its n-grams' vectors (bundling), and a language is the sum of the
profiles of its documents, each of length one. A text gets the language whose
prototype has the largest cosine with its profile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import chunks, frugal

#: Code points whose letters are looked up in a table.
LETTERS_BELOW = 0x3000
GRAM = 3
#: Bits of a code point in an n-gram's number.
POINT = 21
#: N-grams whose vectors are built at once.
GRAMS_AT_ONCE = 8192
#: What a text without letters is called.
UNKNOWN = "und"


def letter_vectors(letters: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A bipolar vector for each code point, from a hash of it, its dimensions and the seed.

    Every letter of every script has a vector of its own; 0 stands for what is no letter.
    """
    words = -(-dims // 64)
    base = np.uint64((seed * 0xD6E8FEB86659FD93 + 1) % (1 << 64))
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(words, dtype=np.uint64) + base) * np.uint64(0xC2B2AE3D27D4EB4F)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)[:, :dims]
    return bits.astype(np.int8) * 2 - 1


def letter_table() -> np.ndarray:
    """Whether each code point below ``LETTERS_BELOW`` is a letter."""
    return np.array([chr(i).isalpha() for i in range(LETTERS_BELOW)])


def grams_of(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a lower-cased text, as numbers of their code points, and their
    counts; none without a letter.

    Runs without letters count as one boundary, and a boundary ends the text on
    both sides.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    low = points < LETTERS_BELOW
    letter = table[np.where(low, points, 0)]
    if not low.all():
        high, at = np.unique(points[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in high])[at]
    letters = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.int64)
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
    if len(letters) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.zeros(len(letters) - GRAM + 1, np.int64)
    for place in range(GRAM):
        ids = (ids << POINT) | letters[place : len(letters) - GRAM + 1 + place]
    return np.unique(ids, return_counts=True)


def gram_vectors(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The bound vectors of n-grams: each letter's one, rotated by its place, multiplied."""
    bound = np.ones((len(grams), dims), np.int8)
    for place in range(GRAM):
        letters, at = np.unique(grams >> (POINT * (GRAM - 1 - place)) & ((1 << POINT) - 1), return_inverse=True)
        bound *= np.roll(letter_vectors(letters, dims, seed), place, axis=1)[at]
    return bound


def profiles(texts: list[str], dims: int, seed: int, table: np.ndarray) -> np.ndarray:
    """One float32 row of length one a text; zeros for a text without letters."""
    found = [grams_of(t, table) for t in texts]
    every, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), [len(g) for g, _ in found])
    times = np.concatenate([n for _, n in found])
    out = np.zeros((len(texts), dims), np.float32)
    order = np.argsort(at, kind="stable") if len(every) > GRAMS_AT_ONCE else np.arange(len(at))
    cuts = np.searchsorted(at[order], np.arange(0, len(every) + GRAMS_AT_ONCE, GRAMS_AT_ONCE)) if len(every) > GRAMS_AT_ONCE else [0, len(at)]
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        some = order[i:j]
        part = every[k * GRAMS_AT_ONCE : (k + 1) * GRAMS_AT_ONCE]
        counts = np.zeros((len(texts), len(part)), np.float32)
        counts[row[some], at[some] - k * GRAMS_AT_ONCE] = times[some]
        out += counts @ gram_vectors(part, dims, seed).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """Some ``most`` rows of each language at random by the hash of the id and text, all of a rare one."""
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = [F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, most / n))]
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*rates)[F.col("lang")] if rates else F.lit(0.0)
    return docs.where(draw < rate).select("lang", "text")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 2000, dims: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """Language -> prototype of length one, from rows with a text and a language.

    About ``rows_per_language`` documents of each language are used, drawn by
    hash; what comes to the driver is one vector a language. Repeated rows count
    as often as they come, if they are drawn.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks([len(t) for t in texts]):
                rows = profiles(texts[i:j], dims, seed, table)
                for lang in set(langs[i:j]):
                    mine = rows[[x == lang for x in langs[i:j]]]
                    sums[lang] = sums.get(lang, 0) + mine.sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "sums"])

    partial = _sample(known, rows_per_language).mapInArrow(frugal(run), "lang string, sums array<double>")
    total = partial.select("lang", F.posexplode("sums").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for row in total.collect():
        out.setdefault(row.lang, np.zeros(dims))[row.dim] = row.x
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", seed: int = 7, keep: list[Column] | None = None) -> DataFrame:
    """(id, lang_pred, score) and the columns ``keep`` for every row.

    ``score`` is the cosine with the prototype chosen, 0 at least. A text that is
    null or has no letter is ``und`` with score 0; so is every text if nothing was
    learned. The first language in order of name wins a tie. Whole texts count.
    """
    judge = _judge(prototypes, seed)
    chosen = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"), *(keep or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = judge()
        for batch in batches:
            langs, score = named(batch.column(0).to_pylist())
            yield pa.record_batch([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])

    schema = chosen.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return chosen.mapInArrow(frugal(run), schema)


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float, text_col: str = "text", seed: int = 7) -> DataFrame:
    """The rows, all columns, whose text ``predict`` gives a language with a score of
    ``least`` or more. Nulls, repeated rows and other columns are as in ``predict``."""
    judge = _judge(prototypes, seed)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = judge()
        for batch in batches:
            langs, score = named([None if t is None else str(t) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array((score >= least) & (np.array(langs, object) != UNKNOWN)))

    return docs.mapInArrow(frugal(run), docs.schema)


def _judge(prototypes: dict[str, np.ndarray], seed: int) -> Callable[[], Callable[[list[str | None]], tuple[list[str], np.ndarray]]]:
    """Builds, on an executor, the function from texts to languages and scores."""
    langs = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if langs else np.zeros((0, 2), np.float32)

    def build() -> Callable[[list[str | None]], tuple[list[str], np.ndarray]]:
        table = letter_table()

        def named(given: list[str | None]) -> tuple[list[str], np.ndarray]:
            texts = [t or "" for t in given]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for i, j in chunks([len(t) for t in texts]) if langs else ():
                rows = profiles(texts[i:j], matrix.shape[1], seed, table)
                cosine = rows @ matrix.T
                best[i:j] = np.where(rows.any(axis=1), cosine.argmax(axis=1), -1)
                score[i:j] = np.where(rows.any(axis=1), np.clip(cosine.max(axis=1), 0, 1), 0)
            return [langs[b] if b >= 0 else UNKNOWN for b in best], score

        return named

    return build
