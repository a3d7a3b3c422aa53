"""Personal data: base patterns, further candidates judged by boosted trees.

Four base patterns give spans that are always kept. Generators with high recall
propose more spans in what the base spans leave over (obfuscated addresses, other
spellings of numbers). Each candidate is described by format and context features,
boosted trees score it, and a threshold per kind, calibrated on held-out examples,
selects the spans to redact. All of it is column expressions on one row: no
shuffle, no Python on executors. The trees are trained on base matches of the
documents themselves, rewritten and in the words around them, against what else the
generators propose there, and on a seeded set of written examples; all features come
from the same expressions.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import checkpoint, local_rows

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A match may start after the previous one or at
# the start of a run of its first class, which is where the leftmost match starts;
# possessive runs save the search from trying every other place.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of any length match; those of a card's are looked at, and runs do not touch
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match of the kind's base pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# The generators; quantifiers are bounded, so they are linear in the text.
_DOT = r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot |\.)"
_AT = r"(?: ?(?:\[at\]|\(at\)|\{at\}) ?| at )"
EXTRA = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,63}}){{1,4}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| ?\. ?)[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ ._-]?){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ ._-]?[0-9]{6}[ ._-]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ ./-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|client|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment|credit|debit|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|number)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|serial|sku|part|ref|reference|build|release|section|tracking|look\w*|laugh\w*|point\w*)\b"
TLD = r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|info|uk|eu)$"
CONTEXT = 32
#: Values that are run through at once by ``running``.
BLOCK = 64
#: A byte order mark, which decoding takes away.
MARK = b"\x00\x00\xfe\xff"
FEATURES = ("kind", "digits", "luhn", "cue", "against", "brackets", "others", "tld", "glued", "valid")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, place: Column) -> Column:
        d = F.substr(digits, F.length(digits) - place + 1, F.lit(1)).try_cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(d)

    return F.coalesce(F.aggregate(places, F.lit(0), add) % 10 == 0, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Inside a lambda function an expression is computed again for every element, and so
    is a column that the optimizer puts in its place.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running(values: Column, plus: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """What ``plus`` makes of the values before each one, from 0; ``values`` is a variable.

    Appending to an array copies it, so long arrays are cut into blocks, whose totals
    are run through in turn: the work grows nearly in proportion.
    """

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    if not levels:
        return within(values)["out"]
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))

    def joined(parts: Column) -> Column:
        return let(
            F.transform(parts, lambda p: p["at"]),
            lambda totals: F.flatten(F.zip_with(parts, running(totals, plus, levels - 1), lambda p, at: F.transform(p["out"], lambda x: plus(x, at)))),
        )

    return F.when(F.size(values) <= BLOCK, within(values)["out"]).otherwise(let(F.transform(cut, within), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, before, after) of a pattern's matches, in order.

    Offsets are code points, end exclusive; ``before`` and ``after`` are the ends of the
    texts around a match up to the next one. Splitting at the pattern gives what lies
    between, so offsets are running sums of lengths.
    """

    def shaped(hits: Column, gaps: Column) -> Column:
        first = F.zip_with(
            hits, gaps, lambda h, g: F.struct((F.length(g) + F.length(h)).alias("step"), F.length(h).alias("size"), h.alias("hit"), F.right(g, F.lit(CONTEXT)).alias("before"))
        )
        rest = F.slice(gaps, 2, F.size(hits))
        both = F.zip_with(F.slice(first, 1, F.size(hits)), rest, lambda m, g: F.struct(m["step"].alias("step"), m["size"].alias("size"), m["hit"].alias("hit"), m["before"].alias("before"), F.left(g, F.lit(2)).alias("after")))

        def placed(m: Column, at: Column) -> Column:
            end = at + m["step"]
            return F.struct((end - m["size"]).alias("start"), end.alias("end"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after"))

        return let(both, lambda m: F.zip_with(m, let(F.transform(m, lambda x: x["step"]), lambda v: running(v, _sum)), placed))

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, _none()).otherwise(let(F.split(text, pattern, -1), lambda gaps: shaped(hits, gaps))),
    )


def _sound(kind: str, hit: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return F.rlike(hit, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        d = _digits(hit)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")


def _base(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: _sound(kind, m["hit"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(_none()) if kind in NEEDS else found


def replaced(text: Column, kind: str, fill: Column | None = None) -> Column:
    """The text with the sound base matches replaced by ``fill``, or blanked out."""
    hits = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    gaps = F.split(text, BASE[kind], -1)
    blank = lambda h: F.repeat(F.lit("\x01"), F.length(h)) if fill is None else fill
    joined = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.when(h.isNull(), F.lit("")).when(_sound(kind, h), blank(h)).otherwise(h)))
    out = F.array_join(joined, "")
    return F.when(F.contains(text, F.lit(NEEDS[kind])), out).otherwise(text) if kind in NEEDS else F.when(F.size(hits) > 0, out).otherwise(text)


def _features(kind: str, m: Column) -> dict[str, Column]:
    hit, d = m["hit"], _digits(m["hit"])
    flag = lambda c: F.when(c, 1).otherwise(0)
    valid: dict[str, Column] = {
        "email": F.rlike(hit, F.lit(r"[0-9._-].*(?:@|at\b|\[|\()|\[|\(|\{")),
        "ip": ~F.rlike(hit, F.lit(r"(?:^|[^0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?:[^0-9]|$)")),
        "card": F.rlike(d, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": F.rlike(hit, F.lit(r"\([2-9]|(?:^|[ .+-])[2-9][0-9]{2}[ ./-]")),
    }[kind]
    return {
        "kind": F.lit(KINDS.index(kind)),
        "digits": F.least(F.length(d), F.lit(20)),
        "luhn": flag(luhn(d)) if kind == "card" else F.lit(0),
        "cue": flag(F.rlike(m["before"], F.lit(CUES[kind]))),
        "against": flag(F.rlike(m["before"], F.lit(AGAINST)) | F.rlike(hit, F.lit(r"(?i)^(?:look\w*|laugh\w*|point\w*) at| at (?:the|a|an|our|this|that) ?"))),
        "brackets": flag(F.rlike(hit, F.lit(r"[\[({+]"))),
        "others": F.least(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.lit(9)),
        "tld": flag(F.rlike(hit, F.lit(TLD))),
        "glued": flag(F.rlike(m["before"], F.lit(r"[A-Za-z0-9_#/=-]$")) | F.rlike(m["after"], F.lit(r"^(?:[A-Za-z0-9_/]|[.-][0-9])"))),
        "valid": flag(valid),
    }


def _described(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *[c.cast("int").alias(n) for n, c in _features(kind, m).items()])


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == i


def _candidates(text: Column) -> Column:
    """All candidates of the generators: (kind, start, end, and the features)."""
    found = []
    for kind in KINDS:
        shaped = F.transform(matches(text, EXTRA[kind]), _described(kind))
        need = r"(?i)\bat\b|[\[({]at[\])}]" if kind == "email" else "[0-9]"
        empty = F.array().cast("array<struct<start:int,end:int," + ",".join(f"{n}:int" for n in FEATURES) + ">>")
        found.append(F.when(F.rlike(text, F.lit(need)), shaped).otherwise(empty))
    return F.concat(*found)


@dataclass
class Trees:
    """Boosted trees: nested (feature, cut, left, right) or a leaf; thresholds by kind."""

    bias: float
    trees: list
    thresholds: list[float]

    def logit(self, row: np.ndarray) -> float:
        """The score of one feature row; what ``column`` states in SQL."""
        total = self.bias
        for tree in self.trees:
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            total += tree
        return total

    def column(self, candidate: Column) -> Column:
        """The logit of a candidate as nested conditions."""

        def walk(tree: tuple | float) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(candidate[FEATURES[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + walk(tree)
        return out

    def selects(self, candidate: Column) -> Column:
        """Whether a candidate's score reaches its kind's threshold."""
        cut = F.element_at(F.array(*[F.lit(float(t)) for t in self.thresholds]), candidate["kind"] + 1)
        return self.column(candidate) >= cut


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> tuple[float, list]:
    """Gradient boosting of the logistic loss over rows of small integers."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    z, trees = np.full(len(y), bias), []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> tuple | float:
        score = lambda a: g[a].sum() ** 2 / (h[a].sum() + l2)
        best = (1e-6, None)
        for f in range(x.shape[1]) if left else ():
            for cut in np.unique(x[at, f])[:-1].tolist():
                low = x[at, f] <= cut
                gain = score(at[low]) + score(at[~low]) - score(at)
                if gain > best[0]:
                    best = (gain, (f, cut))
        if best[1] is None:
            return float(-rate * g[at].sum() / (h[at].sum() + l2))
        f, cut = best[1]
        low = x[at, f] <= cut
        return (f, cut, grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
        step = Trees(0.0, trees[-1:], [])
        z = z + np.array([step.logit(r) for r in x])
    return bias, trees


def examples(seed: int = 11, each: int = 60) -> list[tuple[str, int]]:
    """Written texts with one candidate each, and whether it is personal."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok: bool) -> str:
        body = rng.choice("456") + num(14)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(body))
        check = (10 - total % 10) % 10
        digits = body + str(check if ok else (check + rng.randint(1, 9)) % 10)
        sep = rng.choice((".", "_", " ", "-", ""))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    octet = lambda: str(rng.randint(1, 254))
    name = lambda: rng.choice(("jo", "anna", "m", "li", "pat")) + rng.choice((".", "_", "")) + rng.choice(("smith", "weber", "ng", "diaz")) + rng.choice(("", num(2)))
    lead = lambda *words: rng.choice((*words, "", "we saw", "and then"))
    phone = lambda a, b: a + rng.choice("23456789") + num(2) + b + num(3) + rng.choice("-. ") + num(4)
    out: list[tuple[str, int]] = []
    for _ in range(each):
        host, tld = rng.choice(("mail7", "example", "post", "uni-x")), rng.choice(("com", "org", "net", "de"))
        out += [
            (f"{lead('email', 'contact')} {name()} [at] {host} [dot] {tld} soon", 1),
            (f"{lead('write to', 'mail')} {name()}(at){host}.{tld}", 1),
            (f"{lead('reach me:', 'e-mail')} {name()} at {host} dot {tld} please", 1),
            (f"they {rng.choice(('laughed', 'looked', 'pointed'))} at the dot {rng.choice(('matrix', 'plot', 'com'))} again", 0),
            (f"we met at {rng.choice(('noon', 'home', 'dawn'))}.{rng.choice(('then', 'after', 'she'))} left", 0),
            (f"{lead('server', 'ip', 'from')} {octet()}[.]{octet()}[.]{octet()}[.]{octet()} seen", 1),
            (f"{lead('section', 'version')} {rng.randint(1, 9)} . {rng.randint(1, 9)} . {rng.randint(0, 9)} . {rng.randint(0, 9)} of it", 0),
            (f"{lead('build', 'ref')} {rng.randint(300, 999)}[.]{rng.randint(1, 9)}[.]{num(2)}[.]{num(2)}", 0),
            (f"{lead('card', 'visa', 'payment by')} {card(True)} was used", 1),
            (f"{lead('order', 'tracking', 'serial')} {card(False)} was sent", 0),
            (f"{lead('phone', 'call', 'tel')} {phone('(', ') ')} today", 1),
            (f"{lead('mobile', 'fax', 'call')} {phone('', rng.choice('-. '))} today", 1),
            (f"{rng.choice(('sku', 'part', 'order', 'isbn', 'invoice'))} {num(3)}-{num(3)}-{num(4)} in stock", 0),
            (f"{lead('ref', 'serial')} x{num(1)}#{num(3)}-{num(3)}-{num(4)}/{num(2)} in stock", 0),
        ]
    return out


def defanged(kind: str, hit: str, rng: random.Random) -> str | None:
    """A base match as people write it so that machines miss it; None if there is no such form."""
    d = re.sub("[^0-9]", "", hit)
    if kind == "email":
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")))
        name, host = hit.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return hit.replace(".", rng.choice(("[.]", "(.)", "[dot]", " . ")))
    if kind == "card" and len(d) == 16:
        return rng.choice("._").join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone" and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))
    return None


def weak_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 8192, spans: int = 1000, seed: int = 11) -> tuple[list[str], list[tuple[int, int]], list[tuple[int, ...]]]:
    """Texts with a known span each, and feature rows of what is none, from documents.

    Base matches are personal whatever else; written as ``defanged`` does, each in the
    words that stood around it, they are positives. What the generators propose in
    documents beside base matches is taken as negative. About ``rows`` documents, each
    drawn by the hash of its id and text, are looked at, and at most ``spans`` matches and
    ``spans`` proposals of each kind are used; that is what comes to the driver.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 40)) / float(1 << 40)
    chosen = docs.where(draw < rows / max(1, docs.count())).select(text.alias("text")).where(F.rlike("text", F.lit("[0-9@]")))
    sample = checkpoint(chosen.repartition(8))
    rng = random.Random(seed)
    texts, places, against = [], [], []
    rest = sample.select("text", _left_over(F.col("text")).alias("rest"))
    for kind in KINDS:
        for column, name in ((_base(F.col("text"), kind), "base"), (matches(F.col("rest"), EXTRA[kind]), "extra")):
            found = rest.select(F.explode(column).alias("m")).select("m.hit", "m.before", "m.after").distinct()
            found = found.orderBy(F.xxhash64("hit", "before"), "hit", "before", "after").limit(spans)
            if name == "extra":
                against += [tuple(r) for r in found.select(*[c.cast("int") for c in _features(kind, F.struct("hit", "before", "after")).values()]).collect()]
                continue
            for r in found.collect():
                if (hit := defanged(kind, r.hit, rng)) is not None:
                    texts.append(r.before + hit + r.after)
                    places.append((len(r.before), len(r.before) + len(hit)))
    return texts, places, against


def _left_over(text: Column) -> Column:
    for kind in KINDS:
        text = let(text, lambda t, kind=kind: replaced(t, kind))
    return text


def fit(spark: SparkSession, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, precision: float = 0.97) -> Trees:
    """Trees from two thirds of the labelled candidates; on the rest, the lowest threshold
    of each kind whose selection has at least ``precision``.

    Candidates come from ``weak_labels`` of ``docs``, if given, and from the written
    ``examples``, which also serve where documents hold little personal data.
    """
    written = examples(seed)
    rows = [{"n": i, "text": t, "low": 0, "high": len(t), "y": y} for i, (t, y) in enumerate(written)]
    data: list[tuple[int, ...]] = []
    if docs is not None:
        texts, places, against = weak_labels(docs, id_col, text_col, seed=seed)
        rows += [{"n": len(rows) + i, "text": t, "low": a, "high": b, "y": 1} for i, (t, (a, b)) in enumerate(zip(texts, places, strict=True))]
        data += [(i, 0, *r) for i, r in enumerate(against)]
    table = local_rows(spark, rows, "n int, text string, low int, high int, y int")
    found = table.select("*", F.explode(_candidates(F.col("text"))).alias("c")).where("c.start < high and c.end > low")
    data += [tuple(r) for r in found.select("n", "y", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).collect()]
    data.sort()
    x, y = np.array([r[2:] for r in data]), np.array([r[1] for r in data], float)
    held = np.array([r[0] % 3 == 0 for r in data])
    bias, trees = boost(x[~held], y[~held])
    model = Trees(bias, trees, [])
    z = np.array([model.logit(r) for r in x])
    for k in range(len(KINDS)):
        mine = held & (x[:, 0] == k)
        cuts = [c for c in np.unique(z[mine]).tolist() if y[mine & (z >= c)].mean() >= precision]
        model.thresholds.append(min(cuts) - 1e-9 if cuts else float("inf"))
    return model


def detect(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end) by kind, then start.

    Offsets are code points of the whole text, end exclusive. ``base`` holds the
    base matches of every kind, each kind judged on the original text;
    ``spans`` holds those and the candidates selected, whose search leaves base
    matches out. A null text counts as empty. Rows keep their number.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    left = F.col("text")
    for kind in KINDS:
        out = out.withColumn(f"b_{kind}", _base(F.col("text"), kind))
    for kind in KINDS:
        out = out.withColumn("rest", replaced(left, kind))
        left = F.col("rest")
    out = out.withColumn("extra", F.filter(_candidates(F.col("rest")), model.selects))
    span = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = {k: F.transform(f"b_{k}", span(k)) for k in KINDS}
    more = {k: F.transform(F.filter("extra", _of_kind(i)), span(k)) for i, k in enumerate(KINDS)}
    return out.select(
        "id",
        F.concat(*[base[k] for k in KINDS]).alias("base"),
        F.concat(*[F.when(F.size(more[k]) == 0, base[k]).otherwise(F.array_sort(F.concat(base[k], more[k]))) for k in KINDS]).alias("spans"),
    )


def redact(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows with every selected span replaced by its kind in brackets.

    Spans that overlap are replaced as one, by the kind that starts first. A null
    text stays null; other columns are left alone, whatever their names, and repeated
    rows stay. The work is linear in the text and its spans.
    """
    carried = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("whole"))
    found = detect(carried, model, "row", "whole").select(F.col("id").alias("row"), "spans")
    whole = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def clean(data: Column, spans: Column) -> Column:
        # four bytes a code point, so that a place in the text is a place in the data
        def part(start: Column, size: Column) -> Column:
            return F.decode(F.concat(F.lit(MARK), F.substr(data, start * 4 + 1, size * 4)), "UTF-32")

        def piece(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(part(at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        ends = F.transform(spans, lambda s: -s["end"])
        last = F.array_max(ends)
        pieces = F.zip_with(spans, let(ends, lambda v: running(v, F.greatest)), piece)
        return F.concat(F.array_join(pieces, ""), part(last, F.octet_length(data).cast("int") - last))

    changed = let(F.encode(whole, "UTF-32"), lambda data: let(by_start, lambda spans: clean(data, spans)))
    changed = F.when(F.size("spans") > 0, changed).otherwise(F.col(f"row.{text_col}"))
    return found.select(*[(changed if c == text_col else F.col(f"row.{c}")).alias(c) for c in docs.columns])
