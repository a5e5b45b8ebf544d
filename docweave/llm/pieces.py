"""Subword encoding of a merge-type SentencePiece model with seeded merge-dropout, and lossless decoding.

A text's units (a run of blanks with what follows it up to the next blank, cut around characters that no piece holds) are
encoded by an agenda: of the adjacent symbols whose join is a piece, the best-scored pair (leftmost among equals) merges first.
A candidate that a keyed hash of (seed, text, the unit's place in it, place in the unit) selects is skipped, with the
probability ``dropout``: every occurrence of a unit draws anew, while the same seed always gives the same ids. Characters
outside the vocabulary become byte pieces, and so does the model's own blank sign where a text holds it, so every
segmentation decodes to the exact text.

Distinct units of a batch are encoded without dropout once, with the merges that were made. An occurrence whose key skips none
of these merges has that encoding, since its agenda then pops the same candidates; all others go through an agenda of their own.
All units of a batch are handled at a time, one merge of each in a round; very long units use a heap. A worker keeps plain
encodings of units that came more than once and compares their characters before it uses them again. Null texts have null
ids, empty texts and tables no ids; very long texts are taken in runs of units. Repeated rows get equal ids; only the text is
read, whole, and columns of other names are passed on only if ``keep`` names them (not ``ids``, ``n_ids``, ``lossless`` or ``__text``).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, range_hash, running, steps

BLANK = "▁"
NEVER = np.int64(1 << 62)
#: Units of more symbols than this go through the heap.
LONG = 200


@dataclass
class Pieces:
    chars: np.ndarray  # id of each code point, -1 outside the vocabulary
    keys: np.ndarray  # open addressing: left id * 2**32 + right id, -1 free
    joined: np.ndarray  # id of the joined piece
    rank: np.ndarray  # by id, smaller merges first
    text: np.ndarray  # bytes of all pieces, one after the other
    text_at: np.ndarray
    byte_id: np.ndarray  # id of each byte piece

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the joined pieces, -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        size = np.uint64(len(self.keys) - 1)
        slot = (mix(key) & size).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            there = self.keys[slot[open_]]
            same = there == key[open_]
            out[open_[same]] = self.joined[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
            slot[open_] = (slot[open_] + 1) & int(size)
        return out


def load(model_file: str) -> Pieces:
    """Tables of the model, read on the driver; they are as large as its vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    known = {p: i for i, p in enumerate(names) if plain[i]}
    chars = np.full(0x110000, -1, np.int32)
    for p, i in known.items():
        if len(p) == 1:
            chars[ord(p)] = i
    chars[0x20], chars[ord(BLANK)] = known[BLANK], -1
    byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    pairs = {(known[p[:c]] << 32) | known[p[c:]]: i for p, i in known.items() for c in range(1, len(p)) if p[:c] in known and p[c:] in known}
    size = 1 << (4 * len(pairs)).bit_length()
    keys, joined = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for key, slot in zip(pairs, (mix(np.array(list(pairs), np.int64)) & np.uint64(size - 1)).tolist(), strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], joined[slot] = key, pairs[key]
    scores = np.array([sp.get_score(i) for i in range(n)])
    rank = np.empty(n, np.int64)
    rank[np.argsort(-scores, kind="stable")] = np.arange(n)
    bytes_of = [p.replace(BLANK, " ").encode() if plain[i] else b"" for i, p in enumerate(names)]
    for b, i in enumerate(byte_id):
        bytes_of[i] = bytes([b])
    return Pieces(chars, keys, joined, rank, np.frombuffer(b"".join(bytes_of), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in bytes_of])]), byte_id)


def _skips(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins [begin, middle) and [middle, end) of a unit is skipped."""
    if dropout <= 0:
        return np.zeros(len(key), bool)
    with np.errstate(over="ignore"):
        place = begin.astype(np.uint64) * np.uint64(0x100000001B3) + middle.astype(np.uint64) * np.uint64(0x1F123BB5) + end.astype(np.uint64)
        return (mix(key + mix(place)) >> np.uint64(11)).astype(float) < dropout * float(1 << 53)


def _packed(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The three places of a candidate of a unit of at most LONG symbols as one number."""
    return ((begin << 20) | (middle << 10) | end).astype(np.int32)


def _by_heap(t: Pieces, ids: np.ndarray, key: np.uint64, dropout: float) -> list[int]:
    """One unit: symbols that are left, as indices of where they begin, with ids written into ``ids``."""
    n = len(ids)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(pairs: list[tuple[int, int]]) -> None:
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        new = t.join(ids[a], ids[b])
        end = np.array([stop[x] for x in b])
        skip = _skips(np.full(len(a), key), a, b, end, dropout)
        for x, y, e, i, s in zip(a.tolist(), b.tolist(), end.tolist(), new.tolist(), skip.tolist(), strict=True):
            if i >= 0 and not s:
                heapq.heappush(heap, (int(t.rank[i]), x, y, e, i))

    if n > 1:
        offer([(i, i + 1) for i in range(n - 1)])
    while heap:
        _, a, b, e, i = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and after[a] == b and stop[b] == e and stop[a] == b):
            continue
        ids[a], alive[b], stop[a], after[a] = i, False, e, after[b]
        if after[b] < n:
            before[after[b]] = a
        near = [(before[a], a)] * (before[a] >= 0) + [(a, after[a])] * (after[a] < n)
        if near:
            offer(near)
    return [i for i in range(n) if alive[i]]


def _in_rounds(t: Pieces, ids: np.ndarray, at: np.ndarray, key: np.ndarray, dropout: float, made: list | None = None) -> np.ndarray:
    """Many units at once: merges in place, returns which symbols are left. Each round's merges go to ``made``, as units and places."""
    n = len(ids)
    alive = np.ones(n, bool)
    unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
    base = at[unit]
    after = np.arange(1, n + 1)
    after[at[1:] - 1] = -1
    before = np.arange(-1, n - 1)
    before[at[:-1]] = -1
    stop = np.arange(1, n + 1)
    joins = np.full(n, -1, np.int64)
    order = np.full(n, NEVER)

    def offer(a: np.ndarray) -> None:
        """New candidates of symbols ``a`` with what follows them."""
        b = after[a]
        has = b >= 0
        order[a[~has]] = NEVER
        a, b = a[has], b[has]
        new = t.join(ids[a], ids[b])
        ok = new >= 0
        order[a[~ok]] = NEVER
        a, b, new = a[ok], b[ok], new[ok]
        skip = _skips(key[unit[a]], a - base[a], b - base[a], stop[b] - base[a], dropout)
        joins[a] = new
        order[a] = np.where(skip, NEVER, (t.rank[new] << 10) | (a - base[a]))

    offer(np.arange(n))
    live = np.flatnonzero(np.minimum.reduceat(order, at[:-1]) < NEVER) if n else np.zeros(0, int)
    sizes = np.diff(at)
    while len(live):
        # The symbols of the units that still have candidates, one after the other.
        size = sizes[live]
        cut = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(cut[-1]) + np.repeat(at[live] - cut[:-1], size)
        best = np.minimum.reduceat(order[flat], cut[:-1])
        go = best < NEVER
        live, best = live[go], best[go]
        a = at[live] + (best & 1023)
        b = after[a]
        if made is not None:
            made.append((live, _packed(a - base[a], b - base[a], stop[b] - base[a])))
        ids[a] = joins[a]
        alive[b] = False
        order[b] = NEVER
        stop[a], after[a] = stop[b], after[b]
        c = after[a]
        before[c[c >= 0]] = a[c >= 0]
        left = before[a]
        offer(np.concatenate([a, left[left >= 0]]))
    return alive


class Ranges:
    """Ranges of values, one after the other."""

    def __init__(self, kind: type) -> None:
        self.values, self.start, self.size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """Append ranges, then put all ranges in ``order``; the values stay where they are."""
        start = np.cumsum(size) - size + len(self.values)
        self.values = np.concatenate([self.values, values.astype(self.values.dtype)])
        self.start, self.size = np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]


class Known:
    """Plain encodings of units that came more than once, of one model; at most ``limit``. Their characters are kept, since keys may collide."""

    def __init__(self, limit: int = 300_000) -> None:
        self.limit, self.keys = limit, np.zeros(0, np.uint64)
        self.ids, self.points, self.merges = Ranges(np.int64), Ranges(np.uint32), Ranges(np.int32)

    def find(self, keys: np.ndarray, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Places of the units (their keys, and where they lie in ``points``), -1 where one isn't known."""
        place = np.full(len(keys), -1)
        if not len(self.keys):
            return place
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        maybe = np.flatnonzero((self.keys[at] == keys) & (self.points.size[at] == length))
        mine, cut = spread(points, begin[maybe], length[maybe])
        theirs, _ = spread(self.points.values, self.points.start[at[maybe]], length[maybe])
        unlike = np.add.reduceat(mine != theirs, cut[:-1]) if len(maybe) else np.zeros(0, int)
        same = maybe[unlike == 0]
        place[same] = at[same]
        return place

    def add(self, keys: np.ndarray, ids: tuple, points: tuple, merges: tuple) -> None:
        """Keep units: the values and sizes of their ids, characters and merges, one unit after the other."""
        if len(self.keys) >= self.limit or not len(keys):
            return
        order = np.argsort(both := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = both[order]
        for kept, new in ((self.ids, ids), (self.points, points), (self.merges, merges)):
            kept.add(*new, order)


#: Of this worker, by model.
_KNOWN: dict[str, Known] = {}


def spread(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``pool``, one after the other, and their offsets."""
    at = np.concatenate([[0], np.cumsum(size)])
    return pool[np.arange(at[-1]) + np.repeat(start - at[:-1], size)], at


def _runs(size: np.ndarray, limit: int = 1 << 20) -> list[slice]:
    """Runs of units of about ``limit`` symbols."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    edges = [0, *cuts.tolist(), len(size)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def _distinct(key: np.ndarray, cps: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each key, which of these each unit is, times each comes); units of one key are compared, since a collision would lose text."""
    _, first, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    r = first[which]
    alike = not (size[r] != size).any()
    for run in _runs(size) if alike else ():
        alike &= np.array_equal(spread(cps, begin[run], size[run])[0], spread(cps, begin[r[run]], size[run])[0])
    if not alike:
        first = which = np.arange(len(key))
        times = np.ones(len(key), np.int64)
    return first, which, times


def _encode_units(t: Pieces, ids: np.ndarray, cps: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, dropout: float, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, how many each has); ``merges`` takes (units, places) of the merges of units that aren't long."""
    left, place, unit = ([np.zeros(0, np.int64)] for _ in range(3))
    short = np.flatnonzero(size <= LONG)
    for run in _runs(size[short]):
        part = short[run]
        own, at = spread(ids, begin[part], size[part])
        made = None if merges is None else []
        alive = np.flatnonzero(_in_rounds(t, own, at, key[part], dropout, made))
        of = np.searchsorted(at, alive, side="right") - 1
        left.append(own[alive])
        place.append(begin[part[of]] + alive - at[of])
        unit.append(part[of])
        if made:
            merges += [(part[u], where) for u, where in made]
    for u in np.flatnonzero(size > LONG):
        own = ids[begin[u] : begin[u] + size[u]].copy()
        keep = np.array(_by_heap(t, own, key[u], dropout), np.int64)
        left.append(own[keep])
        place.append(begin[u] + keep)
        unit.append(np.full(len(keep), u))
    left, place, unit = np.concatenate(left), np.concatenate(place), np.concatenate(unit)
    if len(short) < len(size):
        order = np.argsort(unit, kind="stable")
        left, place, unit = left[order], place[order], unit[order]
    odd = np.flatnonzero(left < 0)
    if len(odd):  # symbols outside the vocabulary become their bytes
        raw = [list(chr(c).encode()) for c in cps[place[odd]].tolist()]
        each = np.ones(len(left), np.int64)
        each[odd] = [len(x) for x in raw]
        where = np.repeat(left < 0, each)
        left, unit = np.repeat(left, each), np.repeat(unit, each)
        left[where] = t.byte_id[np.array([b for x in raw for b in x])]
    return left, np.bincount(unit, minlength=len(size))


def _departs(merges: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
    """Of occurrences with the plain merges at ``start``: whether their key skips one of these."""
    out = np.zeros(len(key), bool)
    for run in _runs(count):
        some = np.flatnonzero(count[run]) + run.start
        if len(some):
            m, at = spread(merges, start[some], count[some])
            out[some] = np.logical_or.reduceat(_skips(np.repeat(key[some], count[some]), m >> 20, (m >> 10) & 1023, m & 1023, dropout), at[:-1])
    return out


def encode_texts(t: Pieces, data: np.ndarray, at: np.ndarray, seed: int = 0, dropout: float = 0.1, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's)."""
    known = known or Known(0)
    n = len(at) - 1
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = lead[at]
    # A blank goes before each text that isn't empty.
    some = np.diff(at) > 0
    shift = np.cumsum(some)
    cps = np.full(len(points) + int(some.sum()), 0x20, np.uint32)
    cps[np.arange(len(points)) + np.repeat(shift, np.diff(at))] = points
    at = np.concatenate([[0], at[1:] + shift])
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    ids = t.chars[cps].astype(np.int64)
    blank = cps == 0x20
    cut = np.ones(len(cps), bool)
    cut[1:] = (blank[1:] & ~blank[:-1]) | (ids[1:] < 0) | (ids[:-1] < 0)
    cut[at[:-1][some]] = True
    begin = np.flatnonzero(cut)
    size = np.append(begin[1:], len(cps)) - begin
    sums = running(cps)
    unit = range_hash(sums, begin, begin + size)
    text = np.searchsorted(at, begin, side="right") - 1
    first, which, times = _distinct(unit, cps, begin, size)
    place = known.find(unit[first], cps, begin[first], size[first])
    # Long units are encoded without dropout only where that is asked for.
    fresh = np.flatnonzero((place < 0) & ((size[first] <= LONG) | (dropout <= 0)))
    ub, us = begin[first[fresh]], size[first[fresh]]
    steps_made: list = []
    made, made_count = _encode_units(t, ids, cps, ub, us, unit[first[fresh]], 0.0, steps_made)
    steps_of = np.concatenate([np.zeros(0, np.int64), *(u for u, _ in steps_made)])
    merges = np.concatenate([np.zeros(0, np.int32), *(m for _, m in steps_made)])[np.argsort(steps_of, kind="stable")]
    merge_count = np.bincount(steps_of, minlength=len(fresh))
    old = np.flatnonzero(place >= 0)

    def ranges(kept: Ranges, values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, start and size of each distinct unit's) of known and new units together."""
        where, many = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        where[old], many[old] = kept.start[place[old]], kept.size[place[old]]
        where[fresh], many[fresh] = np.cumsum(count) - count + len(kept.values), count
        return np.concatenate([kept.values, values]), where, many

    pool, start, count = ranges(known.ids, made, made_count)
    start, count = start[which], count[which]
    if dropout > 0:
        own = range_hash(sums, at[:-1], at[1:])
        with np.errstate(over="ignore"):
            key = mix(unit + mix(own[text] + mix((begin - at[text]).astype(np.uint64)) + np.uint64(seed & 0xFFFFFFFF)))
        all_merges, merge_start, merges_each = ranges(known.merges, merges, merge_count)
        vary = np.flatnonzero(_departs(all_merges, merge_start[which], merges_each[which], key, dropout) | (size > LONG))
        lead_of, same, _ = _distinct(key[vary], cps, begin[vary], size[vary])
        varied, varied_count = _encode_units(t, ids, cps, begin[vary[lead_of]], size[vary[lead_of]], key[vary[lead_of]], dropout)
        start[vary], count[vary] = (np.cumsum(varied_count) - varied_count + len(pool))[same], varied_count[same]
        pool = np.concatenate([pool, varied])
    result, _ = spread(pool, start, count)
    often = np.flatnonzero((times[fresh] > 1) & (us <= LONG))
    at_ids, at_merges = (np.cumsum(c) - c for c in (made_count, merge_count))
    known.add(
        unit[first[fresh[often]]],
        (spread(made, at_ids[often], made_count[often])[0], made_count[often]),
        (spread(cps, ub[often], us[often])[0], us[often]),
        (spread(merges, at_merges[often], merge_count[often])[0], merge_count[often]),
    )
    return result, np.concatenate([[0], np.cumsum(np.bincount(text, count, n).astype(np.int64))])


def decode_ids(t: Pieces, ids: np.ndarray, at: np.ndarray) -> list[str]:
    size = np.diff(t.text_at)[ids]
    cut = np.concatenate([[0], np.cumsum(size)])
    body = t.text[np.arange(cut[-1]) + np.repeat(t.text_at[ids] - cut[:-1], size)].tobytes()
    bounds = cut[at]
    return [body[a + 1 : b].decode() if b > a else "" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _types(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep)


def encode(df: DataFrame, model_file: str = "/opt/tokenizers/piece_bpe_32k.model", text: str = "text", keep: tuple[str, ...] = (), seed: int = 0, dropout: float = 0.1, check: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` and ``n_ids`` for every row of ``df``; with ``check`` also ``lossless``: the ids were decoded again and give the text."""
    shared = df.sparkSession.sparkContext.broadcast(load(model_file))
    kept = df.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        t, known = shared.value, _KNOWN.setdefault(model_file, Known())
        for batch in batches:
            valid = np.asarray(batch.column("__text").is_valid())
            for first, last, data, at in steps(batch.column("__text"), 1 << 19):
                ids, cut = encode_texts(t, data, at, seed, dropout, known)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(~valid[first:last]))
                made = [*(batch.column(c).slice(first, last - first) for c in keep), lists, pa.array(np.diff(cut), pa.int64())]
                if check:
                    texts = batch.column("__text").slice(first, last - first).to_pylist()
                    made.append(pa.array([(x or "") == y for x, y in zip(texts, decode_ids(t, ids, cut), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(made, [*keep, "ids", "n_ids", *(["lossless"] if check else [])])

    return kept.mapInArrow(run, f"{_types(kept, keep)}ids array<int>, n_ids long{', lossless boolean' if check else ''}")


def decode(df: DataFrame, model_file: str = "/opt/tokenizers/piece_bpe_32k.model", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``text`` for every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(load(model_file))
    kept = df.select(*keep, F.col(ids).alias("__ids"))

    def run(batches):
        t = shared.value
        for batch in batches:
            lists = batch.column("__ids")
            at = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values, np.int64)
            texts = decode_ids(t, flat[at[0] : at[-1]], at - at[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x if ok else None for x, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())], [*keep, "text"])

    return kept.mapInArrow(run, f"{_types(kept, keep)}text string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to its exact text (null: to null)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, keep=("doc_id",), seed=7, check=True).select("doc_id", "n_ids", "lossless", "ids")
