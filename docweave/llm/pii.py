"""Personal data by boosted candidates, in DataFrame operations only.

High-recall generators propose spans that may overlap: the base formats (email, ip, card, phone), looser shapes of them, and long runs
of letters and digits that may be secrets. A base span that passes its check always stays. The other candidates are scored by boosted
trees over format and context features; trees are fitted on a bounded sample of candidates and compiled into column expressions.

Weak labels come from evidence that no feature shows. A number is real if a checked base span is part of it. No base span is part of an
address without "@", so the sample's checked emails also stand in it rewritten to that form; other candidates of the form are negatives, but for
those that look like an address, which have no label. A run is a secret where a word such as "token" and "=" or ":" stand before it,
which the features don't read; other runs that change between letters and digits as often have no label, the rest are negatives. Since
secrets are rare, the sample also holds digests of its base spans in their place, and names made of its words and a number.

Isotonic calibration on the half of the sample that no tree saw gives each kind the threshold from which nine in ten candidates
are real; without such a threshold the kind adds nothing. Added spans never overlap another.

Null texts are empty and have no spans. Positions are code points, ends exclusive. Repeated rows get equal results; only the text is
read, whole. Matching takes time in proportion to the text: no pattern retries inside a run of its own characters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, sha256_hex
from .quality import Condition, _tree
from .toxicity import isotonic

# The base formats in their order. Possessive forms match what the plain ones match, without deep backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser shapes, each with a text that it cannot do without.
LOOSE = {
    "email_like": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "number_like": r"(?<![0-9.])[(0-9][0-9](?:[\x20().-]{0,2}[0-9]){7,30}+(?![0-9.])",
    "secret": r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
_NEED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "email_like": r"[(\[]at[)\]]", "number_like": r"[0-9][\x20().-]{0,2}[0-9]", "secret": r"[A-Za-z0-9+/_-]{20}"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# What stands for "@" in rewritten emails, and the last label of a host name.
_FORMS = (" [at] ", "[at]", " (at) ", "(at)")
_ENDING = r"\.[A-Za-z]{2,}$"
FEATURES = ("size", "digits", "share", "gaps", "luhn", "plus", "glued_before", "glued_after", "cue", "shape", "ending", "turns", "letters")
_CUE = r"(?i)(?:phone|tel|call|fax|card|mail|contact|ip|ssn|account|iban)[^0-9A-Za-z]{0,4}$"
# What stands before a secret.
_SECRET_CUE = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|auth|credential|private[_-]?key)[A-Za-z0-9_-]{0,10}[\"']?\x20?[:=]\x20?[\"']?$"
_TURN = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, need: str) -> Column:
    """Array of (start, stop, value): the leftmost matches that don't overlap, from the pieces between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["a"])
        stop = start + F.length(x["b"])
        return F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), stop.alias("stop"), x["b"].alias("value"))).alias("out"))

    # The piece after the last match has no match beside it.
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(need), found).otherwise(none)


def _tagged(text: str, kind: str, nth: int, pattern: str, check: bool = False) -> Column:
    """Matches of one pattern as spans (start, nth, stop, kind, value)."""
    found = matches(F.col(text), pattern, _NEED[kind])
    if check:
        found = F.filter(found, lambda m: accepted(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(nth).alias("nth"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``: the checked spans (start, nth, stop, kind, value) in order of start and kind."""
    return df.withColumn("base", F.sort_array(F.concat(*[_tagged(text, k, i, p, True) for i, (k, p) in enumerate(BASE.items())])))


def loose_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``loose``: candidates of the looser shapes, like ``base``."""
    return df.withColumn("loose", F.sort_array(F.concat(*[_tagged(text, k, i, p) for i, (k, p) in enumerate(LOOSE.items(), len(BASE))])))


def turns(value: Column) -> Column:
    """How often a letter stands beside a digit."""
    return (F.length(F.regexp_replace(value, _TURN, "|")) - F.length(value)).cast("double")


def features(span: Column, text: Column) -> list[Column]:
    """FEATURES of a candidate, as doubles."""
    value, size = span["value"], F.length(span["value"])
    digits = digits_of(value)
    before = F.substring(text, F.greatest(span["start"] - 11, F.lit(1)), F.least(span["start"], F.lit(12)))
    after = F.substring(text, span["stop"] + 1, F.lit(1))
    gaps = F.length(F.regexp_replace(value, r"[^\x20().-]", ""))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        size.cast("double"), F.length(digits).cast("double"), F.length(digits) / size, gaps.cast("double"), flag((F.length(digits) > 1) & luhn(digits)), flag(value.startswith("+")),
        flag(before.rlike(r"[A-Za-z0-9._=/\"'+-]$")), flag(after.rlike(r"^[A-Za-z0-9_/=\"'-]")), flag(before.rlike(_CUE)), span["nth"].cast("double"),
        flag(value.rlike(_ENDING)), turns(value) / size, F.length(F.regexp_replace(value, "[^A-Za-z]", "")) / size,
    ]


@dataclass
class SpanModel:
    bias: float = 0.0
    leaves: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    threshold: dict[str, float] = field(default_factory=dict)

    def score(self, values: list[Column]) -> Column:
        total = F.lit(float(self.bias))
        for path, step in self.leaves:
            test = F.lit(True)
            for f, low, v in path:
                test = test & ((values[f] <= F.lit(v)) if low else (values[f] > F.lit(v)))
            total = total + F.when(test, F.lit(float(step))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _candidate(kind: str, start: Column, stop: Column, value: Column) -> Column:
    nth = len(BASE) + list(LOOSE).index(kind)
    return F.struct(start.cast("int").alias("start"), F.lit(nth).alias("nth"), stop.cast("int").alias("stop"), F.lit(kind).alias("kind"), value.alias("value"))


def rewritten(base: Column) -> Column:
    """The emails of checked spans as candidates of email_like: in their place, with a form of "[at]" chosen by hash."""
    form = lambda b: F.element_at(F.array(*map(F.lit, _FORMS)), (F.pmod(F.xxhash64(b["value"]), F.lit(len(_FORMS))) + 1).cast("int"))
    like = lambda b: _candidate("email_like", b["start"], b["stop"], F.replace(b["value"], F.lit("@"), form(b)))
    return F.transform(F.filter(base, lambda b: b["kind"] == "email"), like)


def digests(base: Column) -> Column:
    """Checked spans as candidates of secret: in their place a digest, in hexadecimal or base 64, of 20 to 63 characters."""

    def one(b: Column) -> Column:
        digest, chosen = F.sha2(b["value"], 256), F.pmod(F.xxhash64(b["value"]), F.lit(88)).cast("int")
        text = F.when(chosen < 44, digest).otherwise(F.concat(F.base64(F.unhex(digest)), digest))
        return _candidate("secret", b["start"], b["stop"], F.substring(text, F.lit(1), 20 + chosen % 44))

    return F.transform(base, one)


def names(text: Column) -> Column:
    """One candidate of secret that is none: four words of the text and a number, joined by hyphens or underscores."""
    words = F.slice(F.regexp_extract_all(F.substring(text, 1, 400), F.lit("[A-Za-z]{3,}"), F.lit(0)), 1, 4)
    chosen = F.pmod(F.xxhash64(text), F.lit(1000))
    joined = F.concat(F.array_join(words, "-"), F.lit("-"), chosen.cast("string"))
    joined = F.when(chosen % 2 == 0, F.translate(joined, "-", "_")).otherwise(joined)
    return F.when(F.length(joined) >= 20, F.array(_candidate("secret", F.lit(0), F.length(joined), joined)))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def fit(docs: DataFrame, text: str = "text", documents: int = 6000, candidates: int = 20_000, trees: int = 12, depth: int = 3, precision: float = 0.9, seed: int = 23) -> SpanModel:
    """Learn from a hash sample of about ``documents`` texts and at most ``candidates`` of their candidate spans."""
    n = docs.count()
    sample = docs.where(F.col(text).isNotNull() & hash_fraction(F.xxhash64(text), documents / max(n, 1), seed)).select(F.col(text).alias("text"))
    spans = loose_spans(base_spans(sample, "text"), "text")
    # Base matches that fail their check are candidates too; they are the hard negatives.
    raw = [_tagged("text", k, i, p) for i, (k, p) in enumerate(BASE.items())]
    known = lambda spans, y: F.transform(spans, lambda c: F.struct(c.alias("c"), F.lit(y).cast("int").alias("known")))
    planted = [known(rewritten(F.col("base")), 1), known(digests(F.col("base")), 1), known(F.coalesce(names(F.col("text")), F.array().cast(spans.schema["loose"].dataType)), 0)]
    each = spans.select("text", "base", F.inline(F.concat(known(F.concat("loose", *raw), None), *planted)))
    part = F.exists("base", lambda b: _overlaps(b, F.col("c")))
    before = F.substring(F.col("text"), F.greatest(F.col("c.start") - 39, F.lit(1)), F.least(F.col("c.start"), F.lit(40)))
    secret = F.col("c.kind") == "secret"
    real = F.coalesce(F.col("known"), F.when(secret, before.rlike(_SECRET_CUE)).otherwise(part).cast("int"))
    values = [f.alias(x) for f, x in zip(features(F.col("c"), F.col("text")), FEATURES, strict=True)]
    # In order of a hash, so that the limit takes a uniform sample.
    order = F.xxhash64("text", "c.start", "c.kind", "c.value")
    # A checked number is no secret's evidence either way.
    unlike = (F.col("c.kind") == "secret") & F.col("known").isNull() & part
    labelled = each.where(~unlike).select(real.alias("y"), F.col("c.kind").alias("kind"), F.pmod(F.xxhash64("text", "c.start"), F.lit(2)).alias("half"), order.alias("order"), *values)
    address = (F.col("kind") == "email_like") & (F.col("y") == 0) & (F.col("ending") == 1) & (F.col("glued_before") + F.col("glued_after") == 0)
    random = (F.col("kind") == "secret") & (F.col("y") == 0) & (F.col("turns") >= 0.2)
    rows = labelled.where(~address & ~random).orderBy("order").limit(candidates).collect()
    y = np.array([r["y"] for r in rows], float)
    if len(y) < 50 or y.min() == y.max():
        return SpanModel()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    half, kinds = np.array([r["half"] for r in rows]), np.array([r["kind"] for r in rows])
    a = half == 0
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    p = np.clip(y[a].mean(), 0.01, 0.99) if a.any() else 0.5
    model = SpanModel(float(np.log(p / (1 - p))))
    margin = np.full(len(y), model.bias)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        paths, step = _tree(codes[a], edges, (y - q)[a], (q * (1 - q))[a], depth)
        inner = {path[:-1] for path in paths}
        for path in paths:
            if path in inner:
                continue
            hit = np.all([(x[:, f] <= v) == low for f, low, v in path], 0)
            first = np.flatnonzero(hit[a])
            value = 0.4 * float(step[first[0]]) if len(first) else 0.0
            model.leaves.append((path, value))
            margin[hit] += value
    score = 1 / (1 + np.exp(-margin))
    for kind in LOOSE:
        mine = ~a & (kinds == kind)
        if mine.sum() >= 20:
            knots, levels = isotonic(score[mine], y[mine], np.ones(mine.sum()))
            good = knots[levels >= precision]
            if len(good):
                model.threshold[kind] = float(good.min())
    return model


def find(df: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans`` (base ones and those that the model adds), arrays of (start, nth, stop, kind, value).

    ``df`` must not have columns of these names; ``text`` must hold no nulls.
    """
    out = base_spans(df, text)
    if not model.threshold:
        return out.withColumn("spans", F.col("base"))
    bars = F.lit(2.0)
    out = loose_spans(out, text)

    def wanted(c: Column) -> Column:
        bar = bars
        for kind, value in model.threshold.items():
            bar = F.when(c["kind"] == kind, F.lit(value)).otherwise(bar)
        return ~F.exists("base", lambda b: _overlaps(b, c)) & (model.score(features(c, F.col(text))) >= bar)

    likely = F.filter("loose", wanted)
    # In order of start, a span that overlaps the one kept before it goes.
    apart = F.aggregate(likely, F.struct(F.lit(0).alias("stop"), F.slice("loose", 1, 0).alias("out")), lambda acc, c: F.when(c["start"] >= acc["stop"], F.struct(c["stop"].alias("stop"), F.array_append(acc["out"], c).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return out.withColumn("spans", F.sort_array(F.concat("base", apart))).drop("loose")


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with ``[kind]`` in place of each run of overlapping spans (of its first span's kind)."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], sha256_hex(joined(F.col("base")).cast("binary")).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
