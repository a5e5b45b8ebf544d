"""Exact n-gram Jaccard join by prefixes under several global token orders.

Texts become sets of hashed word shingles. Texts with equal sets are one class from there on. If two sets reach a similarity t,
their first n - ceil(t n) + 1 tokens share one *whatever* the global order, so a pair must share a prefix token under each
of three orders: the first order's prefixes are joined, the others' filter the pairs, and what is left is verified on the sets.
Each order puts rare tokens first (by a sketch of hashed counters over all texts, which only settles the order, never the
result) and breaks ties by its own hash.

A prefix token's group whose members could make more than FEW pairs each is crowded and is not expanded. It is dealt anew by size;
where a band of sizes is crowded still, its members meet only its largest set, the hub, and their symmetric differences from it stand for them: |x ^ y| = |dx ^ dy|, so pairs that are not connected by the
hub share a token of their differences, and the prefixes of the differences, rarest tokens of the hub's members first, are joined like
those of the sets. What all members of a group share is in no difference. Groups that are crowded again get bands and hubs of their own;
after ROUNDS rounds what is left is expanded. No round loses a link between parts that are not connected yet, so components are exact.

Null and empty texts have empty sets and link with nothing. Rows that repeat an id or a text are members of their set's class; a null id
gets its class's component (null if no text of it has an id), and its class links others like any. Sets are compared by 64-bit
shingle hashes, classes by 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, mix, numbers, range_hash, running, stage, steps, word_ranges

#: Hashed counters of the sketch, in pieces of CELLS.
COUNTERS, CELLS = 1 << 21, 1 << 15
#: Bytes of ids up to which a list of documents is broadcast.
BROADCAST_BYTES = 16 << 20
#: Pairs for each member from which a group is crowded (four times as many in each round); rounds of hubs before groups are expanded all the same.
FEW, ROUNDS = 16, 6
#: Members of a hub that one task compares with it.
LANE = 256


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``width`` words; linked where ``den`` * intersection >= ``num`` * union."""

    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n + self.num * n // -self.den + 1, 0)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles in order of hash; a text of fewer words is one shingle."""
    n = len(at) - 1
    low = LOWER[data]
    begin, end, owner = word_ranges(SPACED[low], at)
    words = range_hash(running(low), begin, end)
    count = np.bincount(owner, minlength=n)
    m = max(0, len(words) - width + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for j in range(width):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + m])
        whole = owner[:m] == owner[width - 1 : width - 1 + m]
        h, own = h[whole], owner[:m][whole]
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < width))
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            more = count[short] > j
            extra[more] = mix(extra[more] * np.uint64(0xC2B2AE3D27D4EB4F) + words[first[short[more]] + j] + np.uint64(1))
    h, own = np.concatenate([h, extra]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64)


def _set_keys(h: np.ndarray, at: np.ndarray) -> pa.Array:
    """Sixteen bytes from two independent sums over each set; null for an empty one."""
    n = np.diff(at)
    out = np.zeros((len(n), 2), ">u8")
    with np.errstate(over="ignore"):
        for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
            out[:, j] = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
    whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(out.tobytes())])
    return pc.if_else(pa.array(n > 0), whole.cast(pa.binary()), None)


def _counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int32) & np.int32(COUNTERS - 1)


def token_counters(texts: DataFrame, like: Likeness) -> np.ndarray:
    """Levels (twice the binary logarithm) of hashed counters over all texts: COUNTERS bytes, whatever the input."""

    def count(batches):
        total, seen, held = np.zeros(COUNTERS, np.int32), [], 0
        for batch in batches:
            for _, _, data, at in steps(batch.column("text")):
                h, _ = shingle_sets(data, at, like.width)
                seen.append(_counter_of(h))
                held += len(h)
                if held > 3_000_000:
                    total += np.bincount(np.concatenate(seen), minlength=COUNTERS).astype(np.int32)
                    seen, held = [], 0
        if seen:
            total += np.bincount(np.concatenate(seen), minlength=COUNTERS).astype(np.int32)
        if total.any():
            cells = total.reshape(-1, CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array([c.tobytes() for c in cells], pa.binary())], ["cell", "counts"])

    def add(key, table):
        total = np.zeros(CELLS, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int32)
        # The order only needs sizes, so a counter stays at its largest number.
        top = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([top.tobytes()], pa.binary())})

    kind = "cell long, counts binary"
    parts = texts.select("text").mapInArrow(count, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    half = parts.groupBy("cell", "part").applyInArrow(add, kind)
    out = np.zeros((COUNTERS // CELLS, CELLS), np.int32)
    for r in half.groupBy("cell").applyInArrow(add, kind).collect():
        out[r["cell"]] = np.frombuffer(bytes(r["counts"]), np.int32)
    return (2 * np.log2(np.maximum(out.reshape(-1), 1).astype(np.float32))).astype(np.uint8)


def sets_of(docs: DataFrame, like: Likeness, levels: np.ndarray, keep: tuple[str, ...], whole: bool = False) -> DataFrame:
    """``keep`` columns, n and key of every row of ``docs``; ``key`` is 16 bytes that stand for the set of ``text``, null for an empty set.

    Besides ``p1``, the prefix under the first order; with ``whole`` instead ``tokens`` (the set in order of hash), ``half`` (sort keys
    of the first half of the set under the second order) and ``p3`` (the prefix under the third).
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["tokens", "half", "p3"] if whole else ["p1"]

    def lists(sizes, values, kind):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(kind)))

    def run(batches):
        for batch in batches:
            for first, last, data, at in steps(batch.column("text")):
                h, cut = shingle_sets(data, at, like.width)
                n = np.diff(cut)
                own, place, p = np.repeat(np.arange(len(n)), n), np.arange(len(h)) - np.repeat(cut[:-1], n), like.prefix(n)
                rare = shared.value[_counter_of(h)].astype(np.uint64) << np.uint64(57)
                keys = lambda j: rare | (mix(h + np.uint64(j)) >> np.uint64(7))
                in_prefix = place < np.repeat(p, n)
                if whole:
                    second_keys, third_keys = keys(2), keys(3)
                    ranked = (second_keys[np.lexsort((second_keys, own))] >> np.uint64(32)).astype(np.int32)
                    kept = place < np.repeat(np.maximum(p, (n + 1) // 2), n)
                    kept[1:] &= (ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1])
                    third = (h[np.lexsort((third_keys, own))][in_prefix] >> np.uint64(32)).astype(np.uint32)
                    made = [lists(n, h, np.int64), lists(np.bincount(own[kept], minlength=len(n)), ranked[kept], np.int32), lists(p, third, np.int32)]
                else:
                    made = [lists(p, h[np.lexsort((keys(1), own))][in_prefix], np.int64)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in keep), pa.array(n, pa.int32()), _set_keys(h, cut), *made], [*keep, "n", "key", *names])

    kinds = {"tokens": "array<long>", "half": "array<int>", "p3": "array<int>", "p1": "array<long>"}
    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}n int, key binary" + "".join(f", {x} {kinds[x]}" for x in names))


def _counted(postings: DataFrame, like: Likeness, one_each: bool) -> DataFrame:
    """Postings of groups in which a pair may be missing, with ``short``, the group's numbers of ``shorts`` and ``looses`` and its ``major`` label.

    If the first token that two sets share stands at places a and b, then a + b is at most their largest difference, so one of the two is
    short: its place is at most its own share of that. Members with equal labels are connected already; those outside a group's most
    frequent label are loose. With ``one_each`` every member has a label of its own.
    """
    marked = postings.withColumn("short", F.col("pos") * (like.den + like.num) <= F.col("n") * (like.den - like.num))
    first, largest = F.min(F.when(F.col("short"), F.col("pos"))), F.max(F.when(F.col("short"), F.col("n")))
    numbers = [F.count(F.lit(1)).alias("members"), F.count_if("short").alias("shorts"), first.alias("first"), largest.alias("largest")]
    if one_each:
        counts = marked.groupBy("g").agg(*numbers).select("g", "shorts", "first", "largest", (F.col("members") - 1).alias("looses"), F.lit(None).cast("long").alias("major"))
    else:
        top = F.max(F.struct("members", "label"))
        counts = marked.groupBy("g", "label").agg(*numbers).groupBy("g").agg(F.sum("members").alias("members"), F.sum("shorts").alias("shorts"), F.min("first").alias("first"), F.max("largest").alias("largest"), top.alias("top"))
        counts = counts.select("g", "shorts", "first", "largest", (F.col("members") - F.col("top.members")).alias("looses"), F.col("top.label").alias("major"))
    # One that is not short needs a short partner: its place must fit the least of theirs and their largest size.
    fits = (F.col("pos") + F.col("first")) * (like.den + like.num) <= (F.col("n") + F.col("largest")) * (like.den - like.num)
    open_ = counts.where((F.col("shorts") > 0) & (F.col("looses") > 0))
    return stage(marked.join(open_, "g").where(F.col("short") | fits).drop("first", "largest"), "members")


def _banded(crowded: DataFrame, like: Likeness) -> DataFrame:
    """Postings of crowded groups, dealt anew by size: sets that can reach the similarity are in one band or in two that adjoin."""
    band = F.floor(F.log("n") / F.lit(np.log(like.den / like.num) * 1.0001))
    both = crowded.drop("short", "shorts", "looses", "major").withColumn("band", F.explode(F.array(band, band + 1)))
    return both.withColumn("g", F.xxhash64("g", "band")).drop("band")


def _met(members: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of members with different labels that their places allow; each short (or each loose) member meets the whole group."""
    loose = F.col("major").isNull() | (F.col("label") != F.col("major"))
    sided = members.withColumn("leads", F.when(F.col("shorts") <= F.col("looses"), F.col("short")).otherwise(loose))
    side = lambda x: sided.select("g", *[F.col(c).alias(f"{x}_{c}") for c in ("k", "n", "pos", "left", "short", "label", "leads")])
    both = side("x").where("x_leads").join(side("y"), "g")
    once = (F.col("x_label") != F.col("y_label")) & (~F.col("y_leads") | (F.col("x_k") < F.col("y_k")))
    one_short = F.col("x_short") | F.col("y_short")
    sizes = F.least("x_n", "y_n") * like.den >= F.greatest("x_n", "y_n") * like.num
    # Tokens before the first shared one, and the surplus of one rest over the other, are in one set only.
    differ = F.col("x_pos") + F.col("y_pos") + F.abs(F.col("x_left") - F.col("y_left"))
    close = differ * (like.den + like.num) <= (F.col("x_n") + F.col("y_n")) * (like.den - like.num)
    met = both.where(once & one_short & sizes & close)
    return met.select(F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b")).distinct()


def _spokes(crowded: DataFrame) -> DataFrame:
    """(hub, k) of the members of crowded groups and their group's largest set."""
    hubs = crowded.groupBy("g").agg(F.max(F.struct("n", "k")).alias("top")).select("g", F.col("top.k").alias("hub"))
    return crowded.select("g", "k").join(hubs, "g").where("k <> hub").select("hub", "k").distinct()


def _differences(spokes: DataFrame, sides: DataFrame, like: Likeness) -> DataFrame:
    """(hub, lane, k, n, hub_n, linked, d): each member's symmetric difference from its hub, dealt over lanes of about LANE members."""
    lanes = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / LANE).cast("int").alias("lanes"))
    hubs = lanes.join(_only(sides, [lanes.select("hub")]).select(F.col("k").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "hub_n", "hub_tokens")
    dealt = spokes.join(lanes, "hub").select("hub", F.pmod(F.xxhash64("k"), F.col("lanes")).cast("int").alias("lane"), "k")
    both = dealt.join(_only(sides, [spokes.select("k")]).select("k", "n", "tokens"), "k").join(hubs, ["hub", "lane"])

    def run(batches):
        for batch in batches:
            mine, theirs = numbers(batch.column("tokens")), numbers(batch.column("hub_tokens"))
            d = [np.setxor1d(x, h, assume_unique=True) for x, h in zip(mine, theirs, strict=True)]
            size = np.array([len(x) for x in d], np.int64)
            total = np.asarray(batch.column("n"), np.int64) + np.asarray(batch.column("hub_n"), np.int64)
            near = size * (like.den + like.num) <= total * (like.den - like.num)
            values = (mix(np.concatenate(d)) >> np.uint64(32)).astype(np.uint32) if d else np.zeros(0, np.uint32)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("hub", "lane", "k", "n", "hub_n")), pa.array(near), made], ["hub", "lane", "k", "n", "hub_n", "linked", "d"])

    return stage(both.mapInArrow(run, "hub long, lane int, k long, n int, hub_n int, linked boolean, d array<int>"), "differences")


def _hub_levels(differences: DataFrame) -> DataFrame:
    """(hub, levels): of hashed counters of the tokens in a hub's differences, about sixteen for each token of the hub.

    A level is a byte, 0 where all members with such tokens have one label, else 8 more for each doubling of the count.
    """
    kind = "hub long, counts binary, low binary, high binary"
    largest = np.iinfo(np.int64)

    def table(hubs, held):
        return pa.table({"hub": pa.array(hubs, pa.int64())} | {c: pa.array([x[j].tobytes() for x in held], pa.binary()) for j, c in enumerate(("counts", "low", "high"))})

    def count(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out():
            if held:
                yield from table(list(held), held.values()).to_batches()
            held.clear()

        for batch in batches:
            sizes, labels = np.asarray(batch.column("hub_n")), np.asarray(batch.column("label"))
            for i, (hub, d) in enumerate(zip(batch.column("hub").to_pylist(), numbers(batch.column("d"), np.int32, np.uint32), strict=True)):
                if hub not in held:
                    cells = 1 << int(np.clip(np.ceil(np.log2(16 * int(sizes[i]))), 10, 20))
                    held[hub] = np.zeros(cells, np.int64), np.full(cells, largest.max), np.full(cells, largest.min)
                counts, low, high = held[hub]
                at = d & np.uint32(len(counts) - 1)
                counts += np.bincount(at, minlength=len(counts))
                low[at], high[at] = np.minimum(low[at], labels[i]), np.maximum(high[at], labels[i])
                if i % 64 == 0 and sum(len(x[0]) for x in held.values()) > 2_000_000:
                    yield from out()
        yield from out()

    def total(rows):
        every = lambda c: (np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(c))
        return reduce(np.add, every("counts")), reduce(np.minimum, every("low")), reduce(np.maximum, every("high"))

    def add(key, rows):
        return table([key[0].as_py()], [total(rows)])

    def level(key, rows):
        counts, low, high = total(rows)
        # Counts of two labels are 2 at least.
        levels = np.where(low < high, np.minimum(np.round(8 * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)
        return pa.table({"hub": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([levels.tobytes()], pa.binary())})

    parts = differences.select("hub", "hub_n", "label", "d").mapInArrow(count, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    return parts.groupBy("hub", "part").applyInArrow(add, kind).groupBy("hub").applyInArrow(level, "hub long, levels binary")


def _postings_of(differences: DataFrame, labels: DataFrame, like: Likeness) -> DataFrame:
    """Postings of the differences' prefixes, the tokens that are rarest among a hub's differences first.

    Let x and y be members of one hub h, dx and dy their differences from it and B their largest difference. Where |dx| + |dy| <= B, both
    link with h, which is the largest. Every other linked pair shares a token of dx and dy, the first at places that sum to B at most;
    tokens of equal hashes count as one, which holds for them too. Tokens that only members of one label have come first in the order, but
    need no posting. Where x has h's label and y another, y does not link with h, which is the largest, so |dy| > B and more than half of dx
    is shared: its first shared token stands before the middle. Hubs whose members all have one label need no postings at all.
    """
    tags = differences.select("hub", "lane", "k").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    tags = stage(tags, "tags")
    split = tags.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub")
    split = stage(split.join(labels.select(F.col("k").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub")), "split")
    open_ = stage(differences.join(split.select("hub"), "hub", "left_semi").join(tags, ["hub", "lane", "k"]), "open")
    levels = tags.select("hub", "lane").distinct().join(_hub_levels(open_).join(split, "hub"), "hub")

    def run(key, members, others):
        table, hub_label = np.frombuffer(others.column("levels")[0].as_buffer(), np.uint8), others.column("hub_label")[0].as_py()
        salt = mix(np.array([key[0].as_py()]))
        n = np.asarray(members.column("n"), np.int64)
        # No partner is larger than the hub.
        partner = np.minimum(n * like.den // like.num, np.asarray(members.column("hub_n"), np.int64))
        most = (n + partner) * (like.den - like.num) // (like.den + like.num) + 1
        with_hub = np.asarray(members.column("label")) == hub_label
        rows, groups, places, lefts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, d in enumerate(numbers(members.column("d").combine_chunks(), np.int32, np.uint32)):
            seen = table[d & np.uint32(len(table) - 1)]
            order = np.lexsort((d, seen))[: min(most[i], (len(d) + 1) // 2) if with_hub[i] else most[i]]
            place = np.flatnonzero(seen[order] > 0)
            rows.append(np.full(len(place), i))
            groups.append(mix(mix(d[order[place]]) ^ salt))
            places.append(place)
            lefts.append(len(d) - place)
        at = pa.array(np.concatenate(rows))
        made = {"g": np.concatenate(groups).view(np.int64), "k": members.column("k").take(at), "n": members.column("n").take(at), "pos": np.concatenate(places).astype(np.int32)}
        return pa.table(made | {"left": np.concatenate(lefts).astype(np.int32), "label": members.column("label").take(at)})

    both = open_.select("hub", "lane", "k", "n", "hub_n", "label", "d").groupBy("hub", "lane").cogroup(levels.groupBy("hub", "lane"))
    return stage(both.applyInArrow(run, "g long, k long, n int, pos int, left int, label long"), "difference-postings")


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many short rows, to be broadcast where they are at most BROADCAST_BYTES."""
    return F.broadcast(df) if rows * 64 <= BROADCAST_BYTES else df


def _only(sides: DataFrame, keys: list[DataFrame]) -> DataFrame:
    """The rows of ``sides`` that ``keys`` name, before anything of them is dealt out."""
    named = stage(reduce(DataFrame.union, keys).toDF("k").distinct(), "named")
    return sides.join(_hinted(named, named.count()), "k", "left_semi")


def _sides(keys: DataFrame, classes: DataFrame, docs: DataFrame, like: Likeness, levels: np.ndarray) -> DataFrame:
    """(k, n, tokens, half, p3) of the classes in ``keys(k)``, once each, from texts of their representatives."""
    wanted = stage(classes.select("k", F.col("key").alias("wanted_key"), "rep").join(keys, "k", "left_semi"), "wanted")
    size = wanted.agg(F.count("rep").alias("named"), F.count_if(F.col("rep").isNull()).alias("nameless")).first()
    texts = docs.join(_hinted(wanted, size["named"]), F.col("doc_id") == F.col("rep"))
    # A row that repeats an id may have another text.
    sides = sets_of(texts, like, levels, ("k", "wanted_key"), True).where(F.col("key") == F.col("wanted_key")).drop("wanted_key")
    if size["nameless"]:
        # Classes of texts without an id are found by their keys.
        own = wanted.where(F.col("rep").isNull()).select("k", F.col("wanted_key").alias("key"))
        apart = sets_of(docs.where(F.col("doc_id").isNull() & F.col("text").isNotNull()), like, levels, (), True)
        sides = sides.unionByName(apart.join(_hinted(own, size["nameless"]), "key"))
    sides = stage(sides.drop("key"), "sides")
    if sides.count() > size["named"] + size["nameless"]:
        # Some rows repeat an id and a text.
        sides = stage(sides.dropDuplicates(["k"]), "sides")
    return sides


def share_all_orders(pairs: DataFrame, sides: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) that the other orders allow: a common prefix token, and few enough keys that only one half-set has.

    Below the smaller of two half-sets' last keys both are complete, so keys that only one has there are tokens that only one
    set has; keys that tokens share can only hide some.
    """
    side = lambda x: sides.select(F.col("k").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "half", "p3")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("a_p3", "b_p3"))
    end = F.least(F.element_at("a_half", -1), F.element_at("b_half", -1))
    upto = lambda c: F.size(F.filter(c, lambda k: k <= end))
    apart = upto("a_half") + upto("b_half") - 2 * F.size(F.array_intersect("a_half", "b_half"))
    return both.where(apart * (like.den + like.num) <= (F.col("a_n") + F.col("b_n")) * (like.den - like.num)).select("a", "b")


def verified(pairs: DataFrame, sides: DataFrame, like: Likeness) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) that reach the similarity."""
    shared = stage(share_all_orders(pairs, _only(sides, [pairs.select("a"), pairs.select("b")]), like), "shared")
    sides = _only(sides, [shared.select("a"), shared.select("b")])
    side = lambda x, t: sides.select(F.col("k").alias(x), F.col("tokens").alias(t))
    joined = shared.join(side("a", "ta"), "a").join(side("b", "tb"), "b")

    def run(batches):
        for batch in batches:
            a, b = numbers(batch.column("ta")), numbers(batch.column("tb"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)])
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
            keep = pa.array(like.den * both >= like.num * (total - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["u", "v"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected part, by alternating large and small stars."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small, "stars")
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == new:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def _parts(classes: DataFrame, docs: DataFrame, like: Likeness, levels: np.ndarray) -> DataFrame:
    """(node, root): the connected parts of classes that the similarity links."""
    postings = classes.select(F.posexplode("p1").alias("pos", "g"), "k", "n").withColumns({"left": F.col("n") - F.col("pos"), "label": F.col("k")})
    parts = sides = None
    for turn in range(ROUNDS + 1):
        members = _counted(postings, like, turn == 0)
        crowded = F.least("shorts", "looses") > (FEW << 2 * turn) if turn < ROUNDS else F.lit(False)
        bands = _counted(_banded(members.where(crowded), like), like, turn == 0)
        pairs = stage(_met(members.where(~crowded), like).union(_met(bands.where(~crowded), like)).distinct(), "pairs")
        spokes = stage(_spokes(bands.where(crowded)), "spokes")
        if turn == 0:
            ends = [pairs.select(F.col("a").alias("k")), pairs.select(F.col("b").alias("k")), spokes.select("k"), spokes.select(F.col("hub").alias("k"))]
            sides = _sides(reduce(DataFrame.union, ends).distinct(), classes, docs, like, levels)
        edges = verified(pairs, sides, like)
        if turn > 0:
            edges = edges.union(parts)
        if spokes.isEmpty():
            break
        differences = _differences(spokes, sides, like)
        parts = components(edges.union(differences.where("linked").select("hub", "k")))
        labels = parts.select(F.col("node").alias("k"), F.col("root").alias("label"))
        postings = _postings_of(differences, labels, like)
    return components(edges)


def linked(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    levels = token_counters(docs, like)
    rows = stage(sets_of(docs, like, levels, ("doc_id",)), "sets")
    some, none = rows.where(F.col("key").isNotNull()), rows.where(F.col("key").isNull())
    of_set = some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("p1").alias("p1"))
    # Numbers of classes are written down, so every later read has the same.
    classes = stage(of_set.withColumn("k", F.monotonically_increasing_id()), "classes")
    named = classes.select("k", "key", "rep")
    parts = _parts(classes, docs, like, levels).select(F.col("node").alias("k"), "root")
    inside = parts.unionByName(parts.select(F.col("root").alias("k"), "root").distinct()).join(named.select("k", "rep"), "k")
    least = inside.groupBy("root").agg(F.min("rep").alias("part_id"))
    # Only classes in parts of several need their part's smallest id; the others have their own.
    of_class = named.join(inside.join(least, "root").select("k", "part_id"), "k", "left").select("key", F.coalesce("part_id", "rep").alias("component_id"))
    full = some.select("doc_id", "n", "key").join(stage(of_class, "components"), "key", "left")
    out = full.select("doc_id", "n", "component_id").unionByName(none.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of documents linked at 0.9 on three-word shingles."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), Likeness(3, 90, 100))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
d AS (SELECT doc_id, len(s) AS n, min(doc_id) OVER (PARTITION BY s) AS rep, s FROM s),
e AS (SELECT doc_id AS rep, n, unnest(s) AS x FROM d WHERE doc_id = rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT rep, rep FROM d WHERE n > 0 UNION SELECT r.a, k.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) k ON r.b = k.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, n AS n_shingles, CASE WHEN n = 0 THEN d.doc_id ELSE component_id END AS component_id FROM d LEFT JOIN c ON c.rep = d.rep
"""
