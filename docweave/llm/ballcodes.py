"""Codes of vectors by k-means over each of their parts, with balls that tell which entries a part can move to.

Vectors become integers, floor(scale * x), and are cut into equal parts; each part position has a codebook of its own. A round assigns
every part to its nearest entry and moves each entry to the floor of its parts' mean. After the first round a part knows its entry, and

* an entry's ball holds its parts: its radius is the farthest part's distance, known from the last round, and how far the entry has moved;
* entries nearer to it than twice that radius are its neighbours, in order of distance; no part of the ball can be nearer to any other;
* a part nearer to its entry than half the way to the nearest neighbour is in the stable core and is skipped;
* the others lie in rings, cut where half the way to the next neighbour ends: a part is compared with the neighbours up to its ring only.

All distances are exact integers, so the codes are those of comparing with every entry; ties go to the lower index. Tasks hold one
step of vectors and the codebooks, entries' sums come back as one row for each task and entry, and are added up by Spark; only codebooks
and radii pass through the driver. Each round is written to the shared folder with its vectors, so a lost executor repeats one round's part.

Vectors that are null or hold null or non-finite components are dropped. The codebooks start as the parts of the smallest ids, each id once
(of several vectors the smallest); fewer than ``entries`` ids make smaller codebooks. Rows with a null id are coded but start no entry.
Vectors whose length is not that of the smallest id's, or is not divisible by ``parts``, stay with null code and error. Components
are clamped where squared distances would pass 60 bits (for 16 components a part at 2^27, so |x| at 131,072). Repeated ids are rows of their own.
An empty table gives no rows; null labels are one label. Only id, vector and label are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_join, stage

#: Parts that one step works on.
STEP_PARTS = 1 << 16
_ROW = "vec_id {id}, label {label}, v array<long>, codes binary, error long"
_STAT = "part int, entry int, n long, sums array<long>, far long"


def cut(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", scale: int = 1024) -> DataFrame:
    """(vec_id, label, v): usable rows with integer components."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.where(usable).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def clamp(width: int) -> int:
    """The largest component for parts of ``width``: squared distances stay under 2^60, so that those of all parts add up."""
    return isqrt((1 << 60) // max(1, width)) // 2 - 1


def first_entries(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the ``entries`` smallest ids, in their order. Tasks send that many ids at most."""

    def least(batches):
        best: dict = {}
        for batch in batches:
            ids = batch.column("vec_id")
            bar = max(best) if len(best) >= entries else None
            for i, key in enumerate(ids.to_pylist()):
                if key is None or (bar is not None and key > bar):
                    continue
                v = batch.column("v")[i].as_py()
                if key not in best or v < best[key]:
                    best[key] = v
                    if len(best) > entries:
                        del best[max(best)]
                        bar = max(best)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), batch_type), pa.array(list(best.values()), pa.list_(pa.int64()))], ["vec_id", "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(vectors.schema["vec_id"].dataType)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = vectors.select("vec_id", "v").mapInArrow(least, f"vec_id {kind}, v array<long>").groupBy("vec_id").agg(F.min("v").alias("v"))
    return [list(r["v"]) for r in found.orderBy("vec_id").limit(entries).collect()]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): exact squared distances; as one product in floating point where its sums stay below 2^53."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * a.shape[1] * largest * largest < 2**53:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j, entry in enumerate(b):
        out[:, j] = ((a - entry) ** 2).sum(1)
    return out


class Balls:
    """One part's codebook with each entry's neighbours, in order of distance (squared), by radius."""

    def __init__(self, book: np.ndarray, radius: list[int]) -> None:
        self.book, self.near, self.way = book, [], []
        between = squared(book, book)
        for i, r in enumerate(radius):
            order = np.lexsort((np.arange(len(book)), between[i]))
            order = order[(order != i) & (between[i][order] <= 4 * r * r)]
            self.near.append(order)
            self.way.append(between[i][order])

    def assign(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entries, squared distances, distances computed) of parts that had the entries ``old``."""
        own = ((x - self.book[old]) ** 2).sum(1)
        new, far, work = old.copy(), own.copy(), len(x)
        order = np.argsort(old, kind="stable")
        cuts = np.searchsorted(old[order], np.arange(len(self.book) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[i] : cuts[i + 1]]
            # 2 * own distance reaches so many neighbours; none: the stable core.
            ring = np.searchsorted(self.way[i], 4 * own[rows], side="right")
            deep = np.ceil(np.log2(np.maximum(ring, 1))).astype(int)
            for depth in np.unique(deep[ring > 0]):
                some = rows[(deep == depth) & (ring > 0)]
                near = np.sort(self.near[i][: 1 << depth])
                d = squared(x[some], self.book[near])
                work += d.size
                best = d.argmin(1)
                value, entry = d[np.arange(len(some)), best], near[best]
                moved = (value < own[some]) | ((value == own[some]) & (entry < i))
                new[some[moved]], far[some[moved]] = entry[moved], value[moved]
        return new, far, work


def _passes(books: np.ndarray, radii: list[list[int]] | None, kinds: tuple, shared):
    """The work of one round over batches of (vec_id, label, v, codes): rows with new codes, then one row for each entry met."""
    parts, entries, width = books.shape

    def run(batches):
        balls = None
        sums, n, far = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, entries), np.int64)
        books, radii = shared.value
        names = ["vec_id", "label", "v", "codes", "error", "part", "entry", "n", "sums", "far"]
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, STEP_PARTS // parts)):
                b = batch.slice(at, max(1, STEP_PARTS // parts))
                lists = b.column("v")
                flat, offsets = np.asarray(lists.flatten(), np.int64), np.asarray(lists.offsets, np.int64)
                offsets = offsets - offsets[0]
                fits = np.flatnonzero(np.diff(offsets) == parts * width)
                x = flat[offsets[fits][:, None] + np.arange(parts * width)].reshape(len(fits), parts, width)
                x = np.clip(x, -clamp(width), clamp(width))
                codes, error = np.zeros((len(fits), parts), np.int64), np.zeros(len(fits), np.int64)
                old = None
                if radii is not None:
                    balls = balls or [Balls(book, radius) for book, radius in zip(books, radii, strict=True)]
                    given = b.column("codes").take(pa.array(fits)).to_pylist()
                    old = np.frombuffer(b"".join(given), np.uint8).reshape(len(fits), parts).astype(np.int64)
                for p in range(parts):
                    if old is None:
                        d = squared(x[:, p], books[p])
                        codes[:, p] = d.argmin(1) if len(fits) else 0
                        distance = d[np.arange(len(fits)), codes[:, p]]
                    else:
                        codes[:, p], distance, _ = balls[p].assign(x[:, p], old[:, p])
                    error += distance
                    np.add.at(sums[p], codes[:, p], x[:, p])
                    np.add.at(n[p], codes[:, p], 1)
                    np.maximum.at(far[p], codes[:, p], distance)
                coded, wrong = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
                coded[fits], wrong[fits] = [bytes(c) for c in codes.astype(np.uint8)], error
                none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists, pa.array(coded, pa.binary()), pa.array(wrong, pa.int64()), *none], names)
        p, e = np.nonzero(n)
        none = [pa.nulls(len(p), t) for t in (*kinds, pa.list_(pa.int64()), pa.binary(), pa.int64())]
        stats = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64())), pa.array(far[p, e])]
        yield pa.RecordBatch.from_arrays([*none, *stats], names)

    return run


def _moved(made: DataFrame, books: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """The codebooks after a round and a radius for each entry's ball around its new place, from the rows that tasks left."""
    stats = made.where(F.col("part").isNotNull())
    total = stats.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x")).collect()
    counts = {(r["part"], r["entry"]): (r["n"], r["far"]) for r in stats.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    new = books.copy()
    for r in total:
        new[r["part"], r["entry"], r["at"]] = r["x"] // counts[r["part"], r["entry"]][0]
    radii = []
    for p in range(len(books)):
        shift = ((new[p] - books[p]) ** 2).sum(1)
        radii.append([isqrt(counts.get((p, e), (0, 0))[1]) + 1 + isqrt(int(shift[e])) + 1 for e in range(books.shape[1])])
    return new, radii


def compress(vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of ``vectors(vec_id, label, v)``, one byte a part, and the codebooks (part, entry, component)."""
    spark = vectors.sparkSession
    start = first_entries(vectors, entries)
    width = len(start[0]) // parts if start and len(start[0]) % parts == 0 else 0
    if not width:
        return vectors.select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    from pyspark.sql.pandas.types import to_arrow_type

    start = [v for v in start if len(v) == parts * width]
    books = np.clip(np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2), -clamp(width), clamp(width)).copy()
    kinds = {c: vectors.schema[c].dataType for c in ("vec_id", "label")}
    schema = _ROW.format(id=kinds["vec_id"].simpleString(), label=kinds["label"].simpleString()) + ", " + _STAT
    rows, radii = vectors.withColumn("codes", F.lit(None).cast("binary")), None
    for at in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, radii))
        work = _passes(books, radii, tuple(to_arrow_type(kinds[c]) for c in ("vec_id", "label")), shared)
        made = stage(rows.select("vec_id", "label", "v", "codes").mapInArrow(work, schema), "codes-round")
        rows = made.where(F.col("part").isNull())
        if at < rounds:
            books, radii = _moved(made, books)
    return rows.select("vec_id", "label", "codes", "error"), books


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """Every usable vector's code, its error, that of its label, and the digest of the codebooks."""
    coded, books = compress(cut(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    sums = stage(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    out = small_join(coded, sums, F.col("label").eqNullSafe(F.col("of")), "label", "of", F.xxhash64("vec_id", "codes"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_PARTS_SQL = """, a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.vec_id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c USING (part, pos) GROUP BY ALL) GROUP BY ALL)
"""
_BOOK_SQL = """, c{n} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT x.part, a.entry, x.pos, CAST(floor(sum(x.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM x JOIN a{r} a USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))
"""
OP11_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT vec_id, label, len(embedding) // 4 AS width, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), x AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM v)),
k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256),
c0 AS MATERIALIZED (SELECT x.part, k.entry, x.pos, x.x FROM x JOIN k USING (vec_id))
"""
    + "".join(_PARTS_SQL.format(r=r) + _BOOK_SQL.format(r=r, n=r + 1) for r in range(4))
    + _PARTS_SQL.format(r=4)
    + """, e AS (SELECT v.vec_id, any_value(v.label) AS label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM v JOIN a4 a USING (vec_id) GROUP BY v.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c4) AS codebooks_sha256 FROM e
"""
)
