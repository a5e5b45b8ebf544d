"""Exact top-k inner products by the three-phase uniform threshold.

A vector's score is the sum over groups of dimensions of its local scores. Each task keeps the score lists of its share of the
vectors, one per group and query:

1. every list gives its k best local scores, with the totals of those entries, and its least one; the k-th best of these totals
   is a floor under the k-th best of all;
2. the floor goes to all tasks; an entry that lies, in every group, below the floor's equal share above the least local scores
   cannot reach it, so each list gives only its entries at or above its share, and sums with the share in place of what is
   missing drop those that cannot reach the floor;
3. the missing local scores of the rest alone are added exactly, each task's k best go on, and the k best of all are the result.

Queries are handled in blocks of a bounded size, which alone is broadcast; every block is scored against all rows. Components
become floor(scale * x) and sums are exact 64-bit integers. Vectors that are null, or hold null or non-finite components, and
rows with a null id take no part; vectors of another length than a query's are not its candidates. Ties go to the smaller id. Rows that
repeat an id, with equal vectors or not, are one candidate each time but never candidates of their own id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, stage

GROUPS = 2
#: Local scores that one step works on.
STEP_SCORES = 1 << 22
_RESULT = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(vec_id, v): usable rows with integer components."""
    x = F.col(vector)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.where(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))).alias("v"))


def _matrices(batches):
    """(ids, float matrix) by length of vector; sums of products stay exact while they are below 2**53, else integers are used."""
    for batch in batches:
        lists = batch.column("v")
        flat, at = np.asarray(lists.flatten(), np.int64), np.asarray(lists.offsets, np.int64)
        at = at - at[0]
        ids, length = np.asarray(batch.column("vec_id"), np.int64), np.diff(at)
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            yield ids[rows], flat[(at[rows][:, None] + np.arange(n))]


def _row_hash(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows' ids and components."""
    with np.errstate(over="ignore"):
        h = mix(ids)
        for column in x.T:
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + column.astype(np.uint64))
    return h.view(np.int64)


def _steps(batches, queries: int, n: int):
    """(ids, matrix) of rows of length ``n``, so few at a time that their local scores are about STEP_SCORES."""
    rows = max(1, STEP_SCORES // (queries * GROUPS))
    for vec, x in _matrices(batches):
        if x.shape[1] == n:
            for i in range(0, len(vec), rows):
                yield vec[i : i + rows], x[i : i + rows]


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def open_entries(local: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """(queries, rows): the entries that may reach the floor, from local scores (group, query, row) above the least ones.

    Only scores of at least the floor's share count as sent; the share, rounded up, stands in for those that were not.
    """
    share = -(-floor // GROUPS)[None, :, None]
    sent = local >= share
    return sent.any(0) & (np.where(sent, local, share).sum(0) >= floor[:, None])


def _parts(n: int) -> list[slice]:
    cuts = [round(i * n / GROUPS) for i in range(GROUPS + 1)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Top k for one block of queries of one length."""
    sc = vectors.sparkSession.sparkContext
    shared, parts, least = sc.broadcast((ids, q)), _parts(q.shape[1]), np.int64(-(1 << 62))

    def first(batches):
        own, q = shared.value
        lows = np.full((len(own), GROUPS), np.iinfo(np.int64).max)
        best: dict[int, tuple] = {}
        for vec, x in _steps(batches, len(own), q.shape[1]):
            row = _row_hash(vec, x)
            local = [_product(q[:, part], x[:, part]) for part in parts]
            for g, s in enumerate(local):
                lows[:, g] = np.minimum(lows[:, g], s.min(1))
                ranked = np.where(own[:, None] == vec[None, :], least, s)
                top = np.argpartition(-ranked, min(k, ranked.shape[1]) - 1, axis=1)[:, :k]
                total = sum(np.take_along_axis(part, top, 1) for part in local)
                new = vec[top], row[top], np.take_along_axis(ranked, top, 1), total
                if g in best:
                    new = tuple(np.concatenate(b, 1) for b in zip(best[g], new, strict=True))
                order = np.argsort(-new[2], axis=1, kind="stable")[:, :k]
                best[g] = tuple(np.take_along_axis(b, order, 1) for b in new)
        names = ["q", "g", "vec_id", "row", "score"]
        for g, (v, h, s, total) in best.items():
            real = s > least
            rows = np.repeat(np.arange(len(own)), real.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, np.full(len(rows), g), v[real], h[real], total[real])], names)
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(np.full(len(own), g)), none, none, pa.array(lows[:, g])], names)

    lists = stage(vectors.mapInArrow(first, "q long, g long, vec_id long, row long, score long"), "topk-lists")
    lowest = lists.where(F.col("vec_id").isNull()).groupBy("q", "g").agg(F.min("score").alias("low")).toPandas()
    # Equal rows count once; others of one id are apart.
    seen = lists.where(F.col("vec_id").isNotNull()).groupBy("q", "vec_id", "row").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    floors = seen.withColumn("r", rank).where(F.col("r") == k).select("q", "score").toPandas()
    low = np.zeros((len(ids), GROUPS), np.int64)
    low[lowest["q"], lowest["g"]] = lowest["low"]
    floor = np.zeros(len(ids), np.int64)  # fewer than k candidates: nothing may be dropped
    floor[floors["q"]] = np.maximum(0, floors["score"] - low[floors["q"]].sum(1))
    cutoff = sc.broadcast((low, floor))

    def rest(batches):
        (own, q), (low, floor) = shared.value, cutoff.value
        out_i, out_s = np.full((len(own), k), -1, np.int64), np.full((len(own), k), least)
        for vec, x in _steps(batches, len(own), q.shape[1]):
            local = np.stack([_product(q[:, p], x[:, p]) for p in parts]) - low.T[:, :, None]
            still = open_entries(local, floor) & (own[:, None] != vec[None, :])
            for r in np.flatnonzero(still.any(1)):
                c = np.flatnonzero(still[r])
                i, t = np.concatenate([out_i[r], vec[c]]), np.concatenate([out_s[r], local[:, r, c].sum(0) + low[r].sum()])
                order = np.lexsort((i, -t))[:k]
                out_i[r], out_s[r] = i[order], t[order]
        real = out_s > least
        if real.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, real.sum(1))), pa.array(out_i[real]), pa.array(out_s[real])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(rest, _RESULT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The ``k`` best of ``vectors(vec_id, v)`` for each row of ``queries``: query_id, rank, vec_id, score.

    At most ``block_bytes`` of query components are broadcast at a time; results of each block but a single one are staged.
    """
    spark = vectors.sparkSession
    spans = queries.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy("n").collect()
    done = []
    for span in spans:
        blocks = -(-span["rows"] * span["n"] * 8 // block_bytes)
        for b in range(blocks):
            part = queries.where((F.size("v") == span["n"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).orderBy("vec_id").toPandas()
            if len(part):
                part = part.drop_duplicates("vec_id")
                found = _block(vectors, part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.int64), k)
                done.append(found if len(spans) == 1 and blocks == 1 else stage(found, "topk-block"))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every hundredth vector with all others."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP5_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
