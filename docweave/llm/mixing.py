"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of all words, at most ``limit`` times its size; what is over goes to the others by weight until
no source is above. Every document of a source then has the same expected number of copies, target over size. Its whole part is
taken outright. The fractions are rounded in pairs: one document gives the other words, in a direction drawn so that neither's expectation
changes, until one of the two has a whole number of copies. The sum of a source's words is kept in every step.

Documents are dealt by hash into groups of about ``GROUP``, which leave one fractional document each. These residuals meet again, 64
groups at a time, up a tree; at the root they meet about ``GROUP`` documents of the source that were held back, largest first, which
take up what the large ones have left. The root's last residual is rounded to the side from which the
largest documents of the root that fit into the difference can pay most of it, so the source ends within a few words of the target wherever
small documents are at hand, and within half the residual's size otherwise. Draws are keyed hashes of a document, its size and its place in the tree, so reruns agree, however rows are partitioned.

Equal rows (id, source and size) count as one unit of several documents, of which at most one is fractional. Null and empty texts have
size 0 and are never taken; a source of only such documents has target 0. Sources are ordered by code point, null last, and are ranked
without gathering them. Null ids, very long texts, empty tables and extra columns need no care: only id, source and size are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_by_ranges
from .common import mix, small_join, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one rounding group, and groups whose residuals meet.
GROUP, FAN = 4096, 64
#: Units of more equal rows than this are spread over tasks before they are written out.
MANY = 10_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """(source, s, n, source_size, target) for ``sizes(source, size)``: each source with its rank from 0, rows, words and target.

    Only sums over the sources pass through the driver, once for each round in which a source reaches its limit.
    """
    each = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = rank_by_ranges(each, [], [F.asc_nulls_last("source")]).withColumn("s", F.col("nth") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    known = stage(ranked.select("source", "s", "n", "source_size", weight.alias("weight"), (F.col("source_size") * limit).alias("most")), "mix-sources")
    words = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        now = known.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)).alias("kept"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if now["full"] == full or not now["open"]:
            break
        level, full = (words - now["kept"]) / now["open"], now["full"]
    return known.select("source", "s", "n", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def pivot(size: np.ndarray, words: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(up, words, last) of fractional documents in the given order: 1 or 0 where decided, -1 at ``last``, the one that stays fractional (-1: none).

    ``words`` of a document are its fraction times its size; they move between the two documents of a pair.
    """
    n, up, last = len(size), np.full(len(size), -1, np.int64), -1
    x, w, out = words.astype(float).tolist(), size.astype(float).tolist(), up.tolist()
    for b in range(n):
        if last >= 0:
            a, gain, loss = last, min(w[last] - x[last], x[b]), min(x[last], w[b] - x[b])
            moved = gain if draws[b] * (gain + loss) < loss else -loss
            x[a], x[b] = x[a] + moved, x[b] - moved
            for i in (a, b):
                if x[i] <= 1e-9 * w[i] or x[i] >= w[i] * (1 - 1e-9):
                    out[i] = int(2 * x[i] > w[i])
            last = a if out[a] < 0 else b if out[b] < 0 else -1
        elif 0 < x[b] < w[b]:
            last = b
        else:
            out[b] = int(x[b] > 0)
    return np.array(out, np.int64), np.array(x), last


def settle(size: np.ndarray, words: np.ndarray, up: np.ndarray, last: int) -> np.ndarray:
    """``up`` with the residual rounded and the words it is off paid by the largest documents that fit; of both sides the one that ends nearer."""
    if last < 0:
        return up
    order, best = np.argsort(-size, kind="stable"), None
    near = int(2 * words[last] > size[last])
    for side in (near, 1 - near):
        made = up.copy()
        made[last] = side
        owed = float(words[last] - side * size[last])
        for i in order:
            if i != last and size[i] <= abs(owed) and made[i] == (owed < 0):
                made[i] = 1 - made[i]
                owed -= size[i] if owed > 0 else -size[i]
        if best is None or abs(owed) < best[0]:
            best = abs(owed), made
    return best[1]


def _rounded(seed: int, root: bool):
    """The rounding of one group, for ``applyInArrow``."""

    def run(table: pa.Table) -> pa.Table:
        size, key = np.asarray(table["size"], np.int64), np.asarray(table["h"], np.int64)
        order = np.lexsort((key, -size))
        table, size, key = table.take(pa.array(order)), size[order], key[order]
        draws = (mix(key.view(np.uint64) ^ mix(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(float) / 2.0**53
        up, words, last = pivot(size, np.asarray(table["words"], float), draws)
        up = settle(size, words, up, last) if root else up
        table = table.set_column(table.column_names.index("words"), "words", pa.array(words))
        return table.set_column(table.column_names.index("up"), "up", pa.array(up))

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0, seed: int = 13, key: str = "doc_id", source: str = "source", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: ``taken`` are its words in the mix, whole copies of the document."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("k")), "mix-sizes")
    plan = targets(sizes.select("source", (F.col("size") * F.col("k")).alias("size"), "k"), weights, limit)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(0.0)
    plan = stage(plan.select(F.col("source").alias("of"), "s", "n", "source_size", "target", F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("part")), "mix-plan")
    units = small_join(sizes, plan, F.col("source").eqNullSafe(F.col("of")), "source", "of", F.xxhash64("doc_id", "size")).drop("of")
    wanted = F.col("k") * F.col("part")
    base = F.floor(wanted)
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "s")
    units = units.select("doc_id", "size", "k", "s", "n", "source_size", "target", "whole", base.alias("base"), ((wanted - base) * F.col("size")).alias("words"), h.alias("h"), F.lit(-1).cast("long").alias("up"))
    open_ = (F.col("words") > 0) & (F.col("words") < F.col("size"))
    units = stage(units.withColumn("up", F.when(~open_, F.lit(0)).otherwise(F.col("up"))), "mix-units")
    done, rest = [units.where("up >= 0")], units.where("up < 0")
    held = (F.col("n") <= group) | (F.pmod(F.col("h"), F.col("n")) < group)
    roots, nodes = rest.where(held), rest.where(~held)
    most = plan.agg(F.max("n")).first()[0] or 0
    many, level = -(-most // group), 0
    if most > group:
        nodes = nodes.withColumn("node", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.ceil(F.col("n") / group)))
        while True:
            level += 1
            made = stage(nodes.groupBy("s", "node").applyInArrow(_rounded(seed + level, False), nodes.schema), "mix-level")
            done.append(made.where("up >= 0").drop("node"))
            nodes = made.where("up < 0")
            if many <= FAN:
                break
            nodes, many = nodes.withColumn("node", F.floor(F.col("node") / FAN)), -(-many // FAN)
        roots = roots.unionByName(nodes.drop("node"))
    done.append(stage(roots.groupBy("s").applyInArrow(_rounded(seed, True), roots.schema), "mix-root"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    each = F.explode(F.sequence(F.lit(1), F.least("k", F.lit(MANY))))
    few = out.where(F.col("k") <= MANY).withColumn("j", each)
    runs = out.where(F.col("k") > MANY).withColumn("from", F.explode(F.sequence(F.lit(0), F.floor((F.col("k") - 1) / MANY)))).repartition("h", "from")
    many_ = runs.withColumn("j", F.explode(F.sequence(F.col("from") * MANY + 1, F.least("k", (F.col("from") + 1) * MANY)))).drop("from")
    rows = few.unionByName(many_)
    extra = (F.col("j") <= F.col("base")) | ((F.col("j") == F.col("base") + 1) & (F.col("up") == 1))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra.cast("long"))).alias("taken"))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights 5, 2, 1 of their sources."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
