"""Quality classifier: a sparse ensemble of rules.

Boosted shallow trees over text statistics propose rules (the conjunctions on the paths to their nodes); a logistic
regression with an L1 penalty weighs the rules and drops most; the rest are compiled into one Spark column expression over the
statistics, so scoring a text is a projection. Statistics cover the whole text. Null and empty texts have zero for every
statistic and get the score of those. Labels that are null or of no document are skipped, a document labelled twice counts by
its larger label; with one label only, the score is that label, and without labels 1 (nothing is known against a text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACED, hash_fraction, held_out, range_hash, running, steps, word_ranges

STATISTICS = ("words", "mean_word", "long_words", "upper", "digits", "marks", "symbols", "bars", "shouts", "stops", "unique_words", "unique_lines", "words_a_line", "one_letter", "beyond_ascii", "top_word", "repeated_pairs")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_CLASSES = {"upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"), "marks": _MARKS, "symbols": _class(b"#$%&*@^~<>{}[]\\=+_"), "bars": _class(b"|"), "shouts": _class(b"!?"), "stops": _class(b".,;:")}
_INLINE = np.ones(256, bool)
_INLINE[0x0A] = False


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the number of distinct keys and the times of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    times, own = np.diff(np.append(new, len(k))), o[new]
    most = np.zeros(n)
    np.maximum.at(most, own, times)
    return np.bincount(own, minlength=n).astype(float), most


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    sums = running(data)
    begin, end, owner = word_ranges(SPACED[data], at)
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    keys = range_hash(sums, begin, end)
    unique, most = _distinct(keys, owner, n)
    pair = owner[1:] == owner[:-1]
    pairs, _ = _distinct((keys[1:] + np.uint64(3) * keys[:-1])[pair], owner[1:][pair], n)
    lb, le, lo = word_ranges(_INLINE[data], at)
    lines = np.bincount(lo, minlength=n).astype(float)
    distinct_lines, _ = _distinct(range_hash(sums, lb, le), lo, n)
    length = (end - begin).astype(float)
    share = {}
    for name, chars in _CLASSES.items():
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(chars[data], out=total[1:])
        share[name] = (total[at[1:]] - total[at[:-1]]) / (size if name in ("upper", "digits", "marks", "symbols") else some)
    high = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data >= 0x80, out=high[1:])
    out = {
        "words": words, "mean_word": np.bincount(owner, length, n) / some, "long_words": np.bincount(owner, length > 20, n) / some, **share,
        "unique_words": unique / some, "unique_lines": distinct_lines / np.maximum(lines, 1), "words_a_line": words / np.maximum(lines, 1), "one_letter": np.bincount(owner, length == 1, n) / some,
        "beyond_ascii": (high[at[1:]] - high[at[:-1]]) / size, "top_word": most / some, "repeated_pairs": np.where(words > 1, 1 - pairs / np.maximum(words - 1, 1), 0),
    }
    return np.stack([out[s] for s in STATISTICS], 1)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` (all its columns, names in STATISTICS aside) with a column ``stat_<name>`` for each statistic.

    ``text`` is a column, or the field of one that is a struct, as in ``row.text``.
    """
    stats = [f"stat_{s}" for s in STATISTICS]
    names = [c for c in df.columns if c not in stats]
    kept = df.select(*names)
    column, *fields = text.split(".")

    def run(batches):
        for batch in batches:
            texts = batch.column(column)
            texts = pc.struct_field(texts, fields) if fields else texts
            rows = [statistics_of(data, at) for _, _, data, at in steps(texts)]
            table = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(table[:, i]) for i in range(len(STATISTICS)))], [*names, *stats])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *(StructField(s, DoubleType()) for s in stats)]))


Condition = tuple[int, bool, float]  # statistic, whether it is at most the value, the value


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self) -> Column:
        """The score as an expression over the columns ``stat_<name>``."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for s, low, value in rule:
                c = F.col(f"stat_{STATISTICS[s]}")
                test = test & ((c <= F.lit(value)) if low else (c > F.lit(value)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[s]} {'<=' if low else '>'} {v:.4g}" for s, low, v in r) for r, w in self.rules]


def _tree(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths of one regression tree on gradients, and its step for each row."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(g))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
        if len(path) == depth or len(rows) < 20:
            return
        best = (1e-6, -1, -1)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for s in range(codes.shape[1]):
            k = len(edges[s]) + 1
            if k < 2:
                continue
            left_g, left_h, left_n = (np.cumsum(np.bincount(codes[rows, s], w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = left_g**2 / (left_h + 1) + (g[rows].sum() - left_g) ** 2 / (h[rows].sum() - left_h + 1) - whole
            gain[(left_n < 5) | (len(rows) - left_n < 5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], s, i)
        _, s, i = best
        if s < 0:
            return
        low = codes[rows, s] <= i
        grow(rows[low], (*path, (s, True, float(edges[s][i]))))
        grow(rows[~low], (*path, (s, False, float(edges[s][i]))))

    grow(np.arange(len(g)), ())
    return paths, step


def _lasso(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weighted logistic regression with an L1 penalty by accelerated proximal gradient."""
    w = w / w.sum()
    beta, bias = np.zeros(x.shape[1]), float(np.log((w * y).sum() / (w * (1 - y)).sum()))
    rate = 4.0 / (np.linalg.eigvalsh((x * w[:, None]).T @ x)[-1] + 1)
    old, old_bias, t = beta.copy(), bias, 1.0
    for _ in range(rounds):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        z, zb, t = beta + m * (beta - old), bias + m * (bias - old_bias), t2
        r = w * (1 / (1 + np.exp(-np.clip(x @ z + zb, -35, 35))) - y)
        old, old_bias = beta, bias
        beta = z - rate * (x.T @ r)
        beta = np.sign(beta) * np.maximum(np.abs(beta) - rate * penalty, 0)
        bias = zb - rate * r.sum()
    return bias, beta


def fit_rules(table: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 5e-4) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(40.0, [])
    if y.min() == y.max():
        return RuleEnsemble(40.0 if y[0] else -40.0, [])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 42)[1:-1], method="lower")) for c in table.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, table.T, strict=True)], 1)
    margin, found = np.zeros(len(y)), {}
    w = w / w.mean()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _tree(codes, edges, w * (y - p), w * p * (1 - p), depth)
        margin += 0.3 * step
        found.update(dict.fromkeys(tuple(sorted(p)) for p in paths))
    rules = list(found)
    if not rules:  # too few rows for a split
        rate = float((w * y).sum() / w.sum())
        return RuleEnsemble(float(np.log(rate / (1 - rate))), [])
    holds = np.stack([np.all([(table[:, s] <= v) == low for s, low, v in r], 0) for r in rules], 1).astype(float)
    _, first = np.unique(holds, axis=1, return_index=True)
    rules, holds = [rules[i] for i in sorted(first)], holds[:, sorted(first)]
    bias, beta = _lasso(holds, y, w, penalty)
    return RuleEnsemble(bias, [(r, float(b)) for r, b in zip(rules, beta, strict=True) if b != 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 5000, seed: int = 17, **how) -> RuleEnsemble:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``: statistics of about ``per_label`` rows of each label."""
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | ((F.col("y") == y) & hash_fraction(F.col("doc_id"), per_label / n, seed))
    # per_label bounds the sample, so its ids may be broadcast and its statistics collected.
    sample = docs.select("doc_id", "text").join(F.broadcast(given.where(chosen)), "doc_id")
    rows = with_statistics(sample.select("y", "text")).drop("text").toPandas()
    y = rows["y"].to_numpy(float)
    stands = np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y])
    return fit_rules(rows[[f"stat_{s}" for s in STATISTICS]].to_numpy(float).reshape(len(y), len(STATISTICS)), y, stands, **how)


def score(df: DataFrame, model: RuleEnsemble, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``score`` and the statistics, for every row of ``df``."""
    narrow = df.select(*keep, F.col(text).alias("__read"))
    stats = with_statistics(narrow, "__read").drop("__read")
    return stats.select(*keep, model.column().alias("score"), *[f"stat_{s}" for s in STATISTICS])


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; one document in four is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4, 2))
    model = fit(docs.where(~F.col("held_out")), labels)
    found = score(docs, model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
