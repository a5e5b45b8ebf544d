"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Terms are words and their first four and five bytes, so that inflected forms meet. Every term of the sampled examples is in the vocabulary;
its weight is its inverse document frequency over all documents times a label weight r / (r + half), where r is the log-likelihood
ratio of the labels with and without the term (copies of one passage count once). So a long clean text does not drown a few telling
words, and nothing is cut off. Terms that no example has, or that say nothing of the label (r = 0), weigh nothing.

Examples stand in blocks. The lightest terms, which hold LIGHT of the examples' squared weights together, are bounded by the lengths of both vectors' parts
in them and not read. Of the others, long lists (terms of more than an eighth of the examples) are kept as dense columns with the largest weight of each
block, short ones as postings. A query adds up its short lists; with the long lists' block maxima and the lengths this bounds every cosine of a block.
Blocks are read from the highest bound down until one falls below the k-th best sum. Sums are of 32-bit weights; every example that could be among the
k best by them is compared anew by its whole vector in 64 bits, so the k nearest are exact (ties: smaller example id). Their
labels vote, weighted by cosine and by how many labelled rows an example stands for; isotonic regression over leave-one-out votes
of all examples calibrates the score. A text without weighing terms gets the rate of such examples, or of all where there are none.

Null and empty texts have no terms; a very long text is a step of its own and is read whole; an empty table gives no rows, and columns besides id and text are not read. Labels that are null or of no document are skipped, a document labelled twice counts
by its larger label, and without any label every score is 0; where all labels agree, terms weigh by frequency alone. Repeated rows get equal
results. The driver gets the bounded sample's terms and vectors, never those of other documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, hash_fraction, held_out, range_hash, running, stage, steps, word_ranges

PREFIXES = (4, 5)
BLOCK = 64
#: Queries that are answered together.
GROUP = 64
#: Lists of more than one in so many examples are dense columns.
LONG_LIST = 8
#: Share of the examples' squared weights that short lists of the least weights may hold to be bounded by their length instead of read.
LIGHT = 0.003


def _terms(data: np.ndarray, at: np.ndarray, context: bool = False) -> tuple[np.ndarray, ...]:
    """(term, text) of every word and of the prefixes of longer words; with ``context`` also the word before (0: none)."""
    low = LOWER[data]
    begin, end, text = word_ranges(ALNUM[low], at)
    sums = running(low)
    words = range_hash(sums, begin, end)
    before = np.zeros(len(words), np.uint64)
    same = text[1:] == text[:-1]
    before[1:][same] = words[:-1][same]
    found, texts, befores = [words], [text], [before]
    for size in PREFIXES:
        longer = end - begin > size
        found.append(range_hash(sums, begin[longer], begin[longer] + size))
        texts.append(text[longer])
        befores.append(before[longer])
    out = np.concatenate(found), np.concatenate(texts)
    return (*out, np.concatenate(befores)) if context else out


class Vocabulary:
    """Places in a sorted array of hashes, found by their first bits."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms, bits = terms, int(np.clip(np.ceil(np.log2(len(terms) + 1)) + 2, 8, 24))
        self.shift = np.uint64(64 - bits)
        self.start = np.append(0, np.cumsum(np.bincount((terms >> self.shift).astype(np.int64), minlength=1 << bits))).astype(np.int32)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the asked terms are known, their places)."""
        part = (asked >> self.shift).astype(np.int64)
        at, end = self.start[part], self.start[part + 1]
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], asked[open_]
        which, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(open_):
            same = self.terms[at] == wanted
            which.append(open_[same])
            places.append(at[same])
            more = np.flatnonzero(~same & (at + 1 < end))
            open_, at, end, wanted = open_[more], at[more] + 1, end[more], wanted[more]
        return np.concatenate(which), np.concatenate(places)


def _vectors(data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term's place in the vocabulary, times) in order of text and place."""
    terms, texts = _terms(data, at)
    known, place = vocabulary.find(terms)
    size = max(len(vocabulary.terms), 1)
    both = np.sort(texts[known].astype(np.int64) * size + place)
    new = np.flatnonzero(np.diff(both, prepend=-1))
    both, times = both[new], np.diff(np.append(new, len(both)))
    return both // size, both % size, times


@dataclass
class BlockMaxIndex:
    """Unit vectors of labelled examples by term, cut into blocks, with the largest weight of each cut of a long list."""

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    stands_for: np.ndarray
    k: int = 15
    empty_rate: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    sent: object = None

    def __getstate__(self) -> dict:
        """The vectors in the fewest bytes; lists, columns and maxima are made anew from them where they arrive."""
        state = {k: getattr(self, k) for k in ("vocabulary", "idf", "ids", "label", "stands_for", "k", "empty_rate", "knots", "levels")}
        return state | {"vectors": self.vectors}

    def __setstate__(self, state: dict) -> None:
        places, times, sizes = state.pop("vectors")
        self.__dict__.update(state, sent=None)
        cuts = np.cumsum(sizes)[:-1]
        self.build(list(zip(np.split(places, cuts), np.split(times, cuts), strict=True)) if len(sizes) else [])
        del self.vectors

    def shared(self, df: DataFrame):
        """One broadcast for all uses; what calibrates comes later and travels beside it."""
        if self.sent is None:
            self.sent = df.sparkSession.sparkContext.broadcast(self)
        return self.sent

    def weigh(self, places: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A unit vector; all 0 if no term weighs anything."""
        w = (1 + np.log(times)) * self.idf[places]
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        n, v = len(vectors), len(self.vocabulary)
        self.blocks = -(-n // BLOCK)
        terms, times = (np.concatenate([x[i] for x in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32) for i in (0, 1))
        sizes = np.array([len(p) for p, _ in vectors], np.int32)
        self.vectors = terms, times.astype(np.uint16) if times.max(initial=0) < 1 << 16 else times, sizes
        self.sizes = sizes
        self.first = np.append(0, np.cumsum(sizes, dtype=np.int64))
        # Vectors name terms by rank, the most frequent ones first, so that what is looked up most stands together.
        self.rank = np.empty(v, np.int32)
        self.rank[np.argsort(-np.bincount(terms, minlength=v), kind="stable")] = np.arange(v, dtype=np.int32)
        self.ranked = self.rank[terms]
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        share = 1 + np.log(times)
        del times
        weight = share * self.idf[terms]
        norm = np.sqrt(np.bincount(row, weight * weight, n))
        norm[norm == 0] = 1.0
        weight /= norm[row]
        share /= norm[row]
        self.share = share
        # Of a query's terms while it is answered.
        self.asked = np.zeros(v)
        square = np.bincount(terms, weight * weight, v)
        by = np.argsort(self.idf, kind="stable")
        light = np.zeros(v, bool)
        light[by] = np.cumsum(square[by]) <= LIGHT * n
        mine = light[terms]
        self.light = np.sqrt(np.bincount(row[mine], weight[mine] ** 2, self.blocks * BLOCK)).astype(np.float32)
        some = (weight > 0) & ~mine
        terms, row, weight = terms[some], row[some], weight[some]
        long = np.flatnonzero(np.bincount(terms, minlength=v) * LONG_LIST > n)
        self.column = np.where(light, -2, -1).astype(np.int32)
        self.column[long] = np.arange(len(long))
        mine = self.column[terms] >= 0
        dense = np.zeros((self.blocks * BLOCK, len(long)), np.float32)
        dense[row[mine], self.column[terms[mine]]] = weight[mine]
        self.dense = dense.reshape(self.blocks, BLOCK, len(long))
        self.bound = self.dense.max(axis=1)
        # Products of 32-bit weights only choose candidates; this is twice the most that they can be wrong by.
        self.slack = (len(long) + 64) * 2.0**-23
        terms, row, weight = terms[~mine], row[~mine], weight[~mine]
        order = np.argsort(terms, kind="stable")
        # Postings of 8 bytes: weight, example.
        self.posting = np.empty(len(order), [("weight", np.float32), ("row", np.int32)])
        self.posting["weight"], self.posting["row"] = weight[order], row[order]
        self.posting = self.posting.view(np.int64)
        self.start = np.append(0, np.cumsum(np.bincount(terms, minlength=v)))
        return self

    def nearest(self, places: np.ndarray, weights: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest with a cosine over 0, examples of the id ``without`` aside."""
        return self.nearest_of([(places, weights)], None if without is None else [without])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query; a block is read once for all queries that still need it."""
        n, q = self.blocks * BLOCK, len(queries)
        rest, light = np.zeros((q, n), np.float32), np.zeros((q, 1), np.float32)
        own = np.zeros((q, self.bound.shape[1]), np.float32)
        for i, (places, weights) in enumerate(queries):
            column = self.column[places]
            rest[i] = self.short_lists(places[column == -1], weights[column == -1])
            light[i] = np.sqrt((weights[column == -2] ** 2).sum())
            own[i, column[column >= 0]] = weights[column >= 0]
        own_rows = None if without is None else np.asarray(without)[:, None] == self.ids
        bound = (rest + light * self.light).reshape(q, self.blocks, BLOCK).max(axis=2, initial=0) + own @ self.bound.T
        order = np.argsort(-bound, axis=1, kind="stable")
        # What is surely reached, of blocks read so far.
        score, least, top = np.full((q, self.blocks, BLOCK), -2, np.float32), np.zeros(q), np.full((q, self.k), -2, np.float32)
        flat, rest = score.reshape(q, n), rest.reshape(q, self.blocks, BLOCK)
        first, size = 0, 4
        self.read = 0
        while first < self.blocks:
            # The next blocks of each query, four times as many each time; a block too many changes nothing.
            mine = order[:, first : first + size]
            high = np.take_along_axis(bound, mine, axis=1)
            who, where = np.nonzero((high > 0) & (high >= least[:, None] - self.slack))
            if not len(who):
                break
            blocks = mine[who, where]
            self.read += len(blocks)
            by = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[by], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                block, which = blocks[by[a]], who[by[a:b]]
                score[which, block] = rest[which, block] + own[which] @ self.dense[block].T
            first, size = first + size, 4 * size
            if own_rows is not None:
                flat[:, : len(self.ids)][own_rows] = -2
            top = np.sort(np.concatenate([top, np.take_along_axis(score, mine[:, :, None], axis=1).reshape(q, -1)], axis=1), axis=1)[:, -self.k :]
            least = np.maximum(top[:, 0], 0)
        return [self.best(*queries[i], np.flatnonzero((most > 0) & (most >= least[i] - self.slack))) for i, most in enumerate(flat + light * self.light)]

    def short_lists(self, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each example's sum over the short lists of ``places``."""
        begin, end = self.start[places], self.start[places + 1]
        lists = [self.posting[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        both = np.concatenate(lists) if lists else self.posting[:0]
        products = both.view(np.float32)[::2] * np.repeat(weights.astype(np.float32), end - begin)
        return np.bincount(both.view(np.int32)[1::2], products, self.blocks * BLOCK)

    def best(self, places: np.ndarray, weights: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k best of the examples ``found``, whose cosines are made anew from their vectors."""
        asked = self.rank[places]
        self.asked[asked] = weights * self.idf[places]
        cosine = np.zeros(len(found))
        for a in range(0, len(found), 256):
            part = found[a : a + 256]
            cuts = list(zip(self.first[part].tolist(), self.first[part + 1].tolist(), strict=True))
            products = self.asked[np.concatenate([self.ranked[i:j] for i, j in cuts])]
            products *= np.concatenate([self.share[i:j] for i, j in cuts])
            cosine[a : a + 256] = np.add.reduceat(products, np.cumsum(self.sizes[part]) - self.sizes[part])
        self.asked[asked] = 0
        found, cosine = found[cosine > 0], np.round(cosine[cosine > 0], 12)
        top = np.lexsort((self.ids[found], -cosine))[: self.k]
        return found[top], cosine[top]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = self.stands_for[found] * cosine**2
        return float((w * self.label[found]).sum() / w.sum()) if len(found) else self.empty_rate

    def calibrated(self, vote: float) -> float:
        return level(vote, self.knots, self.levels)


def level(vote: float, knots: np.ndarray, levels: np.ndarray) -> float:
    return float(np.clip(np.interp(vote, knots, levels), 0, 1))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares fit that never falls (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, hi, s, c2 = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = hi, pools[-1][2] + s, pools[-1][3] + c2
    return np.array([v for p in pools for v in (p[0], p[1])]), np.array([v for p in pools for v in (p[2] / p[3],) * 2])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 4000, half: float = 20.0, k: int = 15, seed: int = 12, corpus: DataFrame | None = None) -> BlockMaxIndex:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``: about ``per_label`` rows of each label, whole texts.

    Document frequencies come from all texts of ``corpus`` (``docs`` if not given). Bounds: the driver gets the vectors and the vocabulary
    of the sampled rows.
    """
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in given.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for y, n in counts.items():
        chosen = chosen | ((F.col("y") == y) & hash_fraction(F.col("doc_id"), per_label / n, seed))
    # The sample is bounded by per_label, so its ids may be broadcast.
    sample = stage(docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(given.where(chosen)), "doc_id"), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    na, nb = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    model = BlockMaxIndex(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), k)
    if na + nb == 0:
        return model.build([])
    terms = sample_terms(sample).toArrow()
    order = np.argsort(names := terms.column("term").to_numpy().view(np.uint64))
    a, b = (terms.column(c).to_numpy().astype(float)[order] for c in ("a", "b"))
    model.vocabulary = names[order]
    every = docs if corpus is None else corpus
    frequency = document_frequencies(every, model.vocabulary)
    model.idf = (np.log((1 + every.where(F.col("text").isNotNull()).count()) / (1 + frequency)) + 0.1) * label_weights(a, b, na, nb, half)
    made = vectorise(sample, model).toArrow().to_pylist()
    made = [(r["doc_id"], r["y"], np.frombuffer(r["terms"], np.int32), np.frombuffer(r["times"], np.int32)) for r in made]
    # Examples with the same heaviest term stand together, which makes the blocks' maxima tell.
    heaviest = [int(p[np.argmax(model.weigh(p, t))]) if len(p) and model.idf[p].any() else -1 for _, _, p, t in made]
    made = [made[i] for i in sorted(range(len(made)), key=lambda i: (heaviest[i], made[i][0]))]
    filled = np.array([h >= 0 for h in sorted(heaviest)])
    y = np.array([r[1] for r in made])
    stands = np.array([counts[v] / sizes[v] for v in y.tolist()])
    rate = lambda which: float((stands * y)[which].sum() / stands[which].sum())
    model.empty_rate = rate(~filled) if (~filled).any() else rate(filled)
    model.ids, model.label, model.stands_for = np.array([r[0] for r in made], np.int64)[filled], y[filled].astype(float), stands[filled]
    model.build([(p, t) for (_, _, p, t), f in zip(made, filled, strict=True) if f])
    del made, terms, names, a, b
    if filled.any():
        votes = leave_one_out(sample, model)
        x, seen, w = (votes.column(c).to_numpy().astype(float) for c in ("vote", "y", "one"))
        w = w * np.array([counts[v] / sizes[v] for v in seen.astype(int).tolist()])
        model.knots, model.levels = isotonic(np.append(x, model.empty_rate), np.append(seen, model.empty_rate), np.append(w, 1.0))
    return model


def label_weights(a: np.ndarray, b: np.ndarray, na: float, nb: float, half: float) -> np.ndarray:
    """r / (r + half) for terms in ``a`` of ``na`` examples of label 1 and ``b`` of ``nb`` others; 1 where all labels agree."""
    if not na or not nb:
        return np.ones(len(a))

    def part(x, n, of):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) * (na + nb) / np.maximum(n * of, 1e-300)), 0.0)

    r = 2 * (part(a, na, a + b) + part(b, nb, a + b) + part(na - a, na, na + nb - a - b) + part(nb - b, nb, na + nb - a - b))
    r = np.where(r > 1e-9, r, 0.0)
    return r / (r + half)


def _distinct(*keys: np.ndarray) -> np.ndarray:
    """Places of one row for each combination of ``keys``."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order[new]


def sample_terms(sample: DataFrame) -> DataFrame:
    """(term, a, b): in how many examples of label 1 and of the others each term is, or after how many different words, if that is less (copies of one
    text repeat a term's neighbour, independent uses don't)."""

    def count(batches):
        for batch in batches:
            y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), np.int64)
            for first, last, data, at in steps(batch.column("text")):
                found, texts, before = _terms(data, at, True)
                own = y[first:last][texts]
                # One row for each text that has the term (its neighbour null), one for each neighbour.
                near, held = _distinct(found, own, before), _distinct(found, texts)
                values, where = np.unique(found[held], return_inverse=True)
                label = own[held]
                ones, others = np.bincount(where, label, len(values)), np.bincount(where, 1 - label, len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(ones.astype(np.int64)), pa.array(others.astype(np.int64)), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.int64())], ["term", "a", "b", "y", "context"])
                none = pa.array(np.zeros(len(near), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found[near].view(np.int64)), none, none, pa.array(own[near]), pa.array(before[near].view(np.int64))], ["term", "a", "b", "y", "context"])

    rows = sample.mapInArrow(count, "term long, a long, b long, y long, context long").groupBy("term", "y", "context").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    near = F.col("y").isNotNull()
    all_ = rows.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.when(near, F.col("y")).otherwise(0)).alias("a2"), F.sum(F.when(near, 1 - F.col("y")).otherwise(0)).alias("b2"))
    return all_.select("term", F.least("a", "a2").alias("a"), F.least("b", "b2").alias("b"))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many of all texts have each term of the sorted ``vocabulary``; tasks add up their own texts first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        names = Vocabulary(shared.value)
        total = np.zeros(len(names.terms), np.int64)
        for batch in batches:
            for _, _, data, at in steps(batch.column("text")):
                _, places, _ = _vectors(data, at, names)
                total += np.bincount(places, minlength=len(names.terms))
        some = np.flatnonzero(total)
        for cut in range(0, len(some), 1 << 16):
            part = some[cut : cut + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["place", "n"])

    found = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary))
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def leave_one_out(sample: DataFrame, model: BlockMaxIndex) -> pa.Table:
    """(y, vote, one) of every example with weighing terms, voted on by the others."""
    shared = model.shared(sample)

    def run(batches):
        m = shared.value
        names = Vocabulary(m.vocabulary)
        for batch in batches:
            ids, y = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
            out = []
            for first, _, data, at in steps(batch.column("text")):
                texts, places, times = _vectors(data, at, names)
                cuts = np.flatnonzero(np.diff(texts, prepend=-1, append=-1))
                asked = [(first + int(texts[a]), places[a:b], m.weigh(places[a:b], times[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                asked = [x for x in asked if x[2].any()]
                for a in range(0, len(asked), GROUP):
                    group = asked[a : a + GROUP]
                    nearest = m.nearest_of([(p, w) for _, p, w in group], [ids[i] for i, _, _ in group])
                    out += [(y[i], m.vote(*x)) for (i, _, _), x in zip(group, nearest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([v for _, v in out], pa.float64()), pa.array([1] * len(out), pa.int32())], ["y", "vote", "one"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, "y int, vote double, one int").toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])


def vectorise(sample: DataFrame, model: BlockMaxIndex) -> DataFrame:
    """doc_id, y, and the places of its terms and their times as 64-bit numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(model.vocabulary)

    def run(batches):
        names = Vocabulary(shared.value)
        for batch in batches:
            out = [(b"", b"")] * batch.num_rows
            for first, last, data, at in steps(batch.column("text")):
                texts, places, times = _vectors(data, at, names)
                cuts = np.searchsorted(texts, np.arange(last - first + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out[first + i] = places[a:b].astype(np.int32).tobytes(), times[a:b].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["doc_id", "y", "terms", "times"])

    return sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, terms binary, times binary")


def score(df: DataFrame, model: BlockMaxIndex, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, score and evidence (the nearest examples: id, cosine, label) for every row of ``df``."""
    shared, knots, levels = model.shared(df), model.knots, model.levels
    blank = (model.calibrated(model.empty_rate) if len(model.ids) else model.empty_rate, np.zeros(0, np.int32), np.zeros(0))
    kept = df.select(*keep, F.col(text).alias("__text"))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        m = shared.value
        names = Vocabulary(m.vocabulary)
        seen: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out = [blank] * batch.num_rows
            for first, _, data, at in steps(batch.column("__text")):
                texts, places, times = _vectors(data, at, names)
                cuts = np.flatnonzero(np.diff(texts, prepend=-1, append=-1))
                keys = [hashlib.blake2b(places[a:b].tobytes() + times[a:b].tobytes(), digest_size=32).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if len(seen) > 20_000:
                    seen.clear()
                asked = [(k, places[a:b], m.weigh(places[a:b], times[a:b])) for k, (a, b) in {k: x for k, x in zip(keys, zip(cuts[:-1], cuts[1:], strict=True), strict=True) if k not in seen}.items()]
                for a in range(0, len(asked), GROUP):
                    group = asked[a : a + GROUP]
                    for (k, _, _), (found, cosine) in zip(group, m.nearest_of([(p, w) for _, p, w in group]), strict=True):
                        seen[k] = level(m.vote(found, cosine), knots, levels), found.astype(np.int32), cosine
                for a, k in zip(cuts[:-1], keys, strict=True):
                    out[first + texts[a]] = seen[k]
            row = np.concatenate([x[1] for x in out]) if out else blank[1]
            cut = np.append(0, np.cumsum([len(x[1]) for x in out])).astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(m.ids[row], pa.int64()), pa.array(np.concatenate([x[2] for x in out]) if out else blank[2]), pa.array(m.label[row].astype(np.int32))], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in out], pa.float64()), pa.ListArray.from_arrays(pa.array(cut), near).cast(kind)], [*keep, "score", "evidence"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name in keep)
    return kept.mapInArrow(run, f"{types}score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; one document in five is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    model = fit(docs.where(~F.col("held_out")), labels, corpus=docs)
    found = score(docs, model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
