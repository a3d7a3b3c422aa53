"""Quality by hierarchical empirical Bayes: document, path and host evidence.

A document classifier, naive Bayes over the words of a text and over binned text
statistics, gives each document a log-likelihood ratio; how much of it counts is
learned on documents that it was not fitted on. Documents are grouped by path within
host. Each host's rate of good documents is a posterior under a global beta prior, and
each path's one under a prior centred on its host's rate, so sparse sites shrink
toward what is above them. The strength of each prior is fitted by the method of
moments. The sites are grouped aggregation; a document's score adds its own evidence to
the log odds of its path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, chunks, discard, frugal, stored, utf8
from tidefold.llm.decontaminate import words_of

#: Words are hashed to so many codes; codes of statistics come after them.
WORD_CODES = 1 << 18
#: A site with more than this share of all rows is joined by a broadcast.
HOT_SHARE = 1 / 1000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Statistics of a text, and the cuts of their bins.
CUTS = {
    "words": (5, 20, 50, 100, 300, 1000, 5000),
    "word_length": (2.5, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0),
    "letters": (0.3, 0.5, 0.6, 0.65, 0.7, 0.75, 0.78, 0.8, 0.82, 0.85),
    "digits": (0.001, 0.005, 0.02, 0.05, 0.1, 0.3),
    "marks": (0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.12, 0.2, 0.4),
    "stops": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.4),
    "upper": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3),
    "repeats": (0.01, 0.1, 0.3, 0.5, 0.8),
}
#: All codes, of words and of statistics.
CODES = WORD_CODES + 100 * len(CUTS)


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a whole text, as shares but for words and word length."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda kept: F.length(F.regexp_replace(text, kept, "")) / size
    blanks = size - F.length(F.regexp_replace(text, r"\s+", ""))
    runs = F.size(F.split(F.trim(text), r"\s+"))
    lines = F.filter(F.split(text, r"\n+"), lambda x: x != "")
    return {
        "words": runs.cast("double"),
        "word_length": (size - blanks) / runs,
        "letters": count(r"[^\p{L}]+"),
        "digits": count("[^0-9]+"),
        "marks": count(r"[\p{L}\p{N}\s]+"),
        "stops": (F.size(F.split(text, r"(?:^|\s)\p{L}{1,2}(?=\s)")) - 1) / runs,
        "upper": count(r"[^\p{Lu}]+"),
        "repeats": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }


def _bin(value: Column, cuts: tuple[float, ...]) -> Column:
    return sum((F.when(value > c, 1).otherwise(0) for c in cuts), F.lit(0))


def features(text: Column) -> Column:
    """An array of feature codes, one a statistic: its number times 100 plus its bin."""
    return F.array(*[_bin(v, CUTS[n]) + 100 * i for i, (n, v) in enumerate(statistics(text).items())])


@dataclass
class Model:
    """The evidence of each code (words, then statistics) by all labelled rows and by those of
    either half alone, and the rate of good documents among all with its log odds."""

    evidence: np.ndarray
    halves: np.ndarray
    rate: float
    odds: float


def codes_of(texts: list[bytes]) -> list[np.ndarray]:
    """The codes of the words of each text, each once."""
    words, counts = words_of(texts)
    code = (words >> np.uint64(40)).astype(np.int64) % WORD_CODES
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts) * WORD_CODES + code)
    return np.split(pairs % WORD_CODES, np.searchsorted(pairs // WORD_CODES, np.arange(1, len(texts))))


def log_ratios(g: np.ndarray, b: np.ndarray, good: float, bad: float, smoothing: float = 1.0) -> np.ndarray:
    """The log ratio of each code's share among good and bad rows, from the numbers of rows
    that hold it (``g``, ``b``) and of all; 0 for one not seen."""
    share = (good + smoothing) / (good + bad + 2 * smoothing)
    out = np.log((g + 2 * smoothing * share) / (good + 2 * smoothing)) - np.log((b + 2 * smoothing * (1 - share)) / (bad + 2 * smoothing))
    return np.where(g + b > 0, out, 0.0)


def naive_bayes(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """``log_ratios`` of rows in memory, each the codes of one."""
    codes = np.concatenate([np.zeros(0, np.int64), *rows])
    good = np.repeat(y == 1, [len(r) for r in rows])
    g, b = np.bincount(codes[good], minlength=CODES), np.bincount(codes[~good], minlength=CODES)
    return log_ratios(g, b, y.sum(), len(y) - y.sum(), smoothing)


def _slope(sums: Callable[[float], tuple[float, float]]) -> float:
    """The likeliest slope, 0 to 1, by Newton steps; ``sums`` has the sums of (y - p) z and
    p (1 - p) z z over all rows at a slope."""
    slope = 0.0
    for _ in range(50):
        up, bend = sums(slope)
        last, slope = slope, min(max(slope + (up - 0.1 * slope) / (bend + 0.1), 0.0), 1.0)
        if abs(slope - last) < 1e-6:
            break
    return slope


def weight_of(z: np.ndarray, y: np.ndarray) -> float:
    """The slope, 0 to 1, that makes ``z`` times it plus the log odds of ``y`` likeliest."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def sums(slope: float) -> tuple[float, float]:
        p = 1 / (1 + np.exp(-np.clip(slope * z + base, -30, 30)))
        return ((y - p) * z).sum(), (p * (1 - p) * z * z).sum()

    return _slope(sums)


def weight_in(rows: DataFrame, odds: float) -> float:
    """``weight_of`` the columns ``apart`` and ``y`` of all rows, where those are."""
    z, y = F.col("apart"), F.col("y")

    def sums(slope: float) -> tuple[float, float]:
        p = 1 / (1 + F.exp(-F.greatest(F.least(slope * z + F.lit(odds), F.lit(30.0)), F.lit(-30.0))))
        got = rows.agg(F.sum((y - p) * z).alias("up"), F.sum(p * (1 - p) * z * z).alias("bend")).first()
        return got.up or 0.0, got.bend or 0.0

    return _slope(sums)


def pack(rows: list[np.ndarray]) -> list[bytes]:
    """The ascending codes of each row, one at least, as gaps of 7 bits a byte; after a byte
    over 127 a gap goes on."""
    sizes = np.array([len(r) for r in rows], np.int64)
    codes = np.concatenate([np.zeros(0, np.int64), *rows])
    starts = np.cumsum(sizes) - sizes
    gaps = np.diff(codes, prepend=0)
    gaps[starts] = codes[starts]
    wide = 1 + (gaps >> 7 > 0) + (gaps >> 14 > 0)
    ends = np.cumsum(wide)
    out = np.zeros(wide.sum(), np.uint8)
    for k in range(3):
        on = wide > k
        out[(ends - wide)[on] + k] = (gaps[on] >> 7 * k & 127) | ((wide[on] > k + 1) << 7)
    data, cuts = out.tobytes(), [0, *ends[starts + sizes - 1].tolist()]
    return [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows, one row after another, and the number of each row's."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    ends = np.flatnonzero(flat < 128)
    starts = np.concatenate([[0], ends + 1])[:-1]
    gaps = flat[starts] & 127
    for k in (1, 2):
        on = ends - starts >= k
        gaps[on] |= (flat[starts[on] + k] & 127) << 7 * k
    sizes = np.diff(np.searchsorted(ends, np.cumsum([len(r) for r in rows])), prepend=0)
    first, total = np.cumsum(sizes) - sizes, np.cumsum(gaps)
    return total - np.repeat(total[first] - gaps[first], sizes), sizes


def coded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, packed, the codes of (text, codes): words, then statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(0))]
            more = batch.column(1)
            lists = more.combine_chunks() if isinstance(more, pa.ChunkedArray) else more
            bins = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(texts), len(CUTS)) + WORD_CODES
            found = []
            for i, j in chunks([len(t) for t in texts]):
                found += pack([np.append(w, m) for w, m in zip(codes_of(texts[i:j]), bins[i:j], strict=True)])
            yield pa.record_batch([*batch.columns[2:], pa.array(found, pa.binary())], [*keep, "codes"])

    chosen = docs.select("text", "codes", *keep)
    return chosen.mapInArrow(frugal(run), chosen.drop("text", "codes").schema.add("codes", "binary"))


def _half(id_col: str) -> Column:
    """The half of a row, 0 or 1; rows of one id share it."""
    return F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int")


def fit(rows: DataFrame) -> Model:
    """A model of all rows of (half, y, codes), the codes packed.

    Each task counts its rows by code; the counts of a code are added up, and the driver gets
    one row a code, however many rows there are. Rows that lack a class, all or those of a
    half, give no evidence.
    """
    names = ["bad0", "good0", "bad1", "good1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, CODES + 1), np.int64)  # the last code stands for the rows
        for batch in batches:
            group = 2 * batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(1).to_numpy(zero_copy_only=False)
            codes, sizes = unpack(batch.column(2))
            total += np.bincount(np.repeat(group, sizes) * (CODES + 1) + codes, minlength=total.size).reshape(total.shape)
            total[:, CODES] += np.bincount(group, minlength=4)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(seen, pa.int32()), *[pa.array(t[seen]) for t in total]], ["code", *names])

    each = rows.select("half", "y", "codes").mapInArrow(frugal(run), "code int, " + ", ".join(f"{n} long" for n in names))
    got = checkpoint(each.groupBy("code").agg(*[F.sum(n).alias(n) for n in names])).toArrow()
    counts = np.zeros((4, CODES + 1))
    counts[:, got["code"].to_numpy()] = [got[n].to_numpy() for n in names]

    def ratios(b: np.ndarray, g: np.ndarray) -> np.ndarray:
        return log_ratios(g[:CODES], b[:CODES], g[CODES], b[CODES]) if g[CODES] and b[CODES] else np.zeros(CODES)

    b, g = counts[0] + counts[2], counts[1] + counts[3]
    good, bad = g[CODES], b[CODES]
    return Model(ratios(b, g), np.array([ratios(*counts[:2]), ratios(*counts[2:])]), (good + 1) / (good + bad + 2), math.log((good + 1) / (bad + 1)))


def evidence(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the evidence of (half, codes), the codes packed, before it is
    weighed, and ``apart``, that by the rows of the other half alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = 1 - batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, sizes = unpack(batch.column(1))
            starts = np.cumsum(sizes) - sizes  # no row is without statistics
            sums = [np.add.reduceat(x, starts) if len(sizes) else np.zeros(0) for x in (model.evidence[codes], model.halves[np.repeat(other, sizes), codes])]
            yield pa.record_batch([*batch.columns[2:], *[pa.array(x) for x in sums]], [*keep, "evidence", "apart"])

    chosen = rows.select("half", "codes", *keep)
    return chosen.mapInArrow(frugal(run), chosen.drop("half", "codes").schema.add("evidence", "double").add("apart", "double"))


def _strength(groups: DataFrame, share: Column, size: Column) -> float:
    """The documents that a beta prior over the groups' shares is worth, by moments."""
    m = groups.where(size > 0).agg(
        F.sum(share * size).alias("mean"), F.sum(size).alias("n"), F.sum(size * size).alias("nn"), F.count(F.lit(1)).alias("k"), F.sum(share * share * size).alias("sq")
    ).first()
    if not m.n or m.k < 2:
        return STRONGEST
    mean = m.mean / m.n
    spread = m.sq - m.n * mean * mean
    noise = mean * (1 - mean)
    between = (spread - (m.k - 1) * noise) / max(m.n - m.nn / m.n, 1e-9)
    return STRONGEST if between <= noise / STRONGEST else min(max(noise / between - 1, WEAKEST), STRONGEST)


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, host, path, evidence, host_rate, path_rate, score, keep) for every row.

    ``learn`` tells the rows whose labels are used (all). The classifier, its weight and the
    rates of sites are fitted on all labelled rows among them. ``score`` is the probability of
    a good document; ``keep`` is ``score >= threshold``. A null text counts as empty; a null host
    or path is a site of its own, the empty name. A site without labels has the rate of
    what is above it; without any label all rates are a half. Of several labels of an id
    the largest counts; repeated rows keep a row each.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    use = F.lit(True) if learn is None else learn
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        use.alias("use"), text.alias("text"), features(text).alias("codes"),
    )
    texts = stored(coded(base, ["id", "host", "path", "use"]).withColumn("half", _half("id")))  # the texts are read once
    model = fit(texts.where("use").join(marks.hint("merge"), "id"))  # the same plan at every size
    rows = checkpoint(evidence(texts, model, ["id", "host", "path", "use"]))
    discard(texts)
    named = checkpoint(rows.where("use").join(marks, "id").select("host", "path", "apart", "y"))
    weight = weight_in(named, model.odds)
    rows = rows.select("id", "host", "path", (weight * F.col("evidence")).alias("evidence"))
    found = _rates(rows, named, model.rate)
    value = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    out = _with_sites(rows, found).select("id", "host", "path", "evidence", "host_rate", "path_rate", value.alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)


def _rates(rows: DataFrame, named: DataFrame, rate: float) -> DataFrame:
    """(host, path, rows, host_rate, path_rate) of every site, by grouped aggregation."""
    sums = named.groupBy("host", "path").agg(F.sum("y").cast("double").alias("g"), F.count(F.lit(1)).cast("double").alias("n"))
    sites = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows")).join(sums, ["host", "path"], "left").fillna(0.0, ["g", "n"])
    sites = checkpoint(sites)
    hosts = sites.groupBy("host").agg(F.sum("g").alias("hg"), F.sum("n").alias("hn"))
    wide = _strength(hosts, F.col("hg") / F.col("hn"), F.col("hn"))
    rated = hosts.select("host", ((F.col("hg") + wide * rate) / (F.col("hn") + wide)).alias("host_rate"))
    near = _strength(sites, F.col("g") / F.col("n"), F.col("n"))
    path_rate = (F.col("g") + near * F.col("host_rate")) / (F.col("n") + near)
    return checkpoint(sites.join(rated, "host").select("host", "path", "rows", "host_rate", path_rate.alias("path_rate")))


def _with_sites(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows with their sites' rates. Sites with over ``HOT_SHARE`` of all rows, so few
    that they are broadcast, meet their rows where those are; others by a shuffle."""
    total = sites.agg(F.sum("rows").alias("n")).first().n or 0
    hot = F.broadcast(sites.where(F.col("rows") > total * HOT_SHARE).drop("rows"))
    cold = sites.where(F.col("rows") <= total * HOT_SHARE).drop("rows")
    keys = ["host", "path"]
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
