"""Language identification by a bit-sliced Bloom filter of byte n-grams.

Fitting learns, for each language, all n-grams (3 and 4 bytes of a lower-cased word with a blank on either side) of its learned
documents. The filter has one row per bit position and one bit per language in that row, in as many 64-bit words as languages need, so
the AND of an n-gram's rows is the bitmask of *all* languages that hold it. A text's score for a language is the popcount of
its column of masks, corrected for the filter's false positives: of N n-grams with c hits at false-positive rate f, about
(c - N f) / (1 - f) are true. The best corrected count decides, ties by the language's name.

Null texts and texts without a letter give ``und`` with score 0. Rows with a null id or null language are never learned
from; without any learned language, as in an empty table, all texts give ``und``. Repeated rows and extra columns, whatever their
names, change nothing: only the text is read, in steps of whole texts, so a very long one is a step of its own. Of more than ``max_languages`` values of
lang those with most documents are learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, held_out, mix, range_hash, running, steps

SIZES = (3, 4)
#: Letters stay, in lower case; every other ASCII byte is a blank.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)


@dataclass
class LanguageFilter:
    langs: list[str]
    rows: np.ndarray  # (word, bit position): bitmasks of 64 languages a word
    hashes: int
    false_rate: np.ndarray  # by language
    fallback: int  # the most frequent learned language


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n-grams of texts that stand one after the other; no n-gram crosses a word's bounds."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    padded = np.full(len(data) + n + 1, 0x20, np.uint8)
    padded[np.arange(len(data)) + owner + 1] = LETTERS[data]
    blank = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(padded == 0x20, out=blank[1:])
    sums, starts = running(padded), at[:-1] + np.arange(n)
    found, texts = [], []
    for size in SIZES:
        begin = np.arange(max(0, len(padded) - size + 1))
        begin = begin[blank[begin + size - 1] == blank[begin + 1]]
        found.append(range_hash(sums, begin, begin + size))
        texts.append(np.searchsorted(starts, begin, side="right") - 1)
    return np.concatenate(found), np.concatenate(texts)


def _positions(grams: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    """Double hashing: ``hashes`` bit positions for each n-gram."""
    step = mix(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((grams + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(hashes)]


def fit(docs: DataFrame, per_language: int = 3000, max_bits: int = 1 << 20, hashes: int = 3, seed: int = 11, max_languages: int = 1024) -> LanguageFilter:
    """Learn from ``docs(doc_id, text, lang)``: a hash sample of about ``per_language`` documents of each language.

    Bounds: the driver gets one row per language and at most ``max_bits`` bit positions a word of 64 languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), hashes, np.zeros(0), -1)
    shares = [(lang, i, int(min(1.0, per_language / counts[lang]) * (1 << 30))) for i, lang in enumerate(langs)]
    few = docs.sparkSession.createDataFrame(shares, "lang string, tag int, bar int")
    drawn = F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < F.col("bar")

    def count(batches):
        kept: dict[int, tuple[list, list]] = {}
        size = 0
        for batch in batches:
            tags = np.asarray(batch.column("tag"), np.int64)
            for first, last, data, at in steps(batch.column("text")):
                grams, texts = _grams(data, at)
                order = np.lexsort((grams, texts))
                grams, texts = grams[order], texts[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (texts[1:] != texts[:-1])
                grams, own = grams[new], tags[first:last][texts[new]]
                for tag in np.unique(own):
                    values, n = np.unique(grams[own == tag], return_counts=True)
                    mine = kept.setdefault(int(tag), ([], []))
                    mine[0].append(values)
                    mine[1].append(n)
                    size += len(values)
            if size > 2_000_000:
                yield from flush(kept)
                kept, size = {}, 0
        yield from flush(kept)

    def flush(kept):
        for tag, (values, n) in kept.items():
            grams, where = np.unique(np.concatenate(values), return_inverse=True)
            total = np.bincount(where, np.concatenate(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), tag, np.int64)), pa.array(grams.view(np.int64)), pa.array(total)], ["tag", "gram", "n"])

    sample = known.join(F.broadcast(few), "lang").where(drawn).select("text", "tag")
    learned = sample.mapInArrow(count, "tag long, gram long, n long").select("tag", "gram").distinct()
    bits = max_bits

    def place(batches):
        for batch in batches:
            grams = np.asarray(batch.column("gram")).view(np.uint64)
            tag = np.asarray(batch.column("tag")).astype(np.uint64)
            flag = np.left_shift(np.uint64(1), tag & np.uint64(63)).view(np.int64)
            at = _positions(grams, hashes, bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile((tag >> np.uint64(6)).astype(np.int64), hashes)), pa.array(np.concatenate(at)), pa.array(np.tile(flag, hashes))], ["word", "at", "flag"])

    placed = learned.mapInArrow(place, "word long, at long, flag long").groupBy("word", "at").agg(F.bit_or("flag").alias("flag")).toPandas()
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    rows = np.zeros((-(-len(langs) // 64), bits), np.uint64)
    rows[placed["word"].to_numpy(np.int64), placed["at"].to_numpy(np.int64)] = placed["flag"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([((rows[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return LanguageFilter(langs, rows.astype(kind), hashes, fill**hashes, max(range(len(langs)), key=lambda i: (counts[langs[i]], -i)))


def masks_of(model: LanguageFilter, grams: np.ndarray) -> np.ndarray:
    """(word, n-gram): the bitmask of languages that hold each n-gram, false positives included."""
    out = None
    for p in _positions(grams, model.hashes, model.rows.shape[1]):
        out = model.rows[:, p] if out is None else out & model.rows[:, p]
    return out


def predict(df: DataFrame, model: LanguageFilter, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, lang_pred, score and ngrams (how many were looked up) for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*keep, F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def run(batches):
        m = shared.value
        k = len(m.langs)
        for batch in batches:
            lang, score, looked = [], [], []
            letter = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool)
            for first, last, data, at in steps(batch.column("__text"), STEP_BYTES):
                n = last - first
                grams, texts = _grams(data, at)
                total = np.bincount(texts, minlength=n).astype(float)
                if k:
                    mask = masks_of(m, grams)
                    hits = np.stack([np.bincount(texts, ((mask[i // 64] >> mask.dtype.type(i % 64)) & mask.dtype.type(1)), minlength=n) for i in range(k)], 1)
                    true = np.clip((hits - total[:, None] * m.false_rate) / np.maximum(1 - m.false_rate, 1e-9), 0, None)
                    best, top = true.argmax(1), true.max(1)
                    rest = np.partition(true, -2, axis=1)[:, -2] if k > 1 else np.zeros(n)
                    own = np.where(top > 0, top / np.maximum(top + rest, 1e-9), 0.0)
                    best = np.where(top > 0, best, m.fallback)
                for i in range(n):
                    ok = k and letter[first + i]
                    lang.append(m.langs[best[i]] if ok else "und")
                    score.append(float(own[i]) if ok else 0.0)
                looked.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(np.concatenate(looked).astype(np.int64) if looked else [], pa.int64())], [*keep, "lang_pred", "score", "ngrams"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{types + ', ' if types else ''}lang_pred string, score double, ngrams long")


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document; one document in five is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    model = fit(kept.where(~F.col("held_out")))
    return predict(kept, model, keep=("doc_id", "held_out"))
