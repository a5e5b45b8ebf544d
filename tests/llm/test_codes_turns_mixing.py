"""Vector codes, conversation repair and mixing against brute force, on nulls, ties, repeats, long texts, empty tables and clashing columns."""

import collections
import functools
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import ballcodes, mixing, turns


def plain_codes(rows, entries, rounds=4):
    """Codes and codebooks of {row: vector of integers}, by comparing with every entry."""
    books = [[v[p * len(v) // 4 : (p + 1) * len(v) // 4] for v in entries] for p in range(4)]
    cutting = lambda v: [v[p * len(v) // 4 : (p + 1) * len(v) // 4] for p in range(4)]
    for at in range(rounds + 1):
        codes = {r: [min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)) for x, book in zip(cutting(v), books)] for r, v in rows.items()}
        if at < rounds:
            for p, book in enumerate(books):
                for i in range(len(book)):
                    own = [cutting(v)[p] for r, v in rows.items() if codes[r][p][1] == i]
                    if own:
                        book[i] = [sum(c) // len(own) for c in zip(*own)]
    return {r: ("".join(f"{i:02x}" for _, i in c), sum(d for d, _ in c)) for r, c in codes.items()}, books


@pytest.mark.parametrize("spread", [40, 2])  # few values make many ties
def test_codes_equal_brute_force(spark, spread):
    rng = random.Random(spread)
    rows = [(i // 2 if i < 40 else i, [rng.randrange(-spread, spread) / 1024 for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for i in range(300)]
    odd = [(1, None, 0), (2, [0.0, None] * 4, 0), (3, [float("nan")] * 8, 0), (4, [float("inf")] * 8, 0), (None, [0.5] * 8, 7), (900, [0.1] * 4, 7), (901, [], None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("codes", F.lit("x")).withColumn("of", F.lit(1)).withColumn("error", F.lit(2))
    vectors = ballcodes.cut(df)
    coded, books = ballcodes.compress(vectors, entries=16)
    whole = {(i, tuple(r)): [math.floor(1024 * x) for x in r] for i, r in [(r["vec_id"], r["embedding"]) for r in df.collect()] if r and len(r) == 8 and all(x is not None and math.isfinite(x) for x in r)}
    first = {}
    for (i, _), v in whole.items():
        if i is not None:
            first[i] = min(first.get(i, v), v)
    want, expected = plain_codes(whole, [first[i] for i in sorted(first)[:16]])
    found = collections.Counter((r["vec_id"], bytes(r["codes"]).hex(), r["error"]) for r in coded.collect() if r["codes"] is not None)
    held = collections.Counter((r["vec_id"], tuple(r["embedding"])) for r in df.collect() if (r["vec_id"], tuple(r["embedding"] or ())) in want)
    assert found == collections.Counter({}) + sum((collections.Counter({(i, *want[i, v]): n}) for (i, v), n in held.items()), collections.Counter())
    assert books.tolist() == expected
    assert sorted(r["vec_id"] for r in coded.collect() if r["codes"] is None) == [900, 901]
    assert ballcodes.compress(vectors.limit(0))[0].count() == 0


def test_balls_skip_work_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (16, 6))
    x = np.concatenate([c + rng.integers(-40, 40, (200, 6)) for c in centres])
    old = np.repeat(np.arange(16), 200)
    far = [math.isqrt(int(((x[old == i] - c) ** 2).sum(1).max())) + 1 for i, c in enumerate(centres)]
    new, distance, work = ballcodes.Balls(centres, far).assign(x, old)
    every = ballcodes.squared(x, centres)
    assert (new == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert work < 3 * len(x) < every.size
    wrong = rng.integers(0, 16, len(x))  # any old entry gives the same codes, if balls hold their parts
    far = [math.isqrt(int(((x[wrong == i] - c) ** 2).sum(1).max())) + 1 for i, c in enumerate(centres)]
    assert (ballcodes.Balls(centres, far).assign(x, wrong)[0] == every.argmin(1)).all()
    large = 10**8
    assert ballcodes.squared(np.array([[large, 0]]), np.array([[-large, 1]])).tolist() == [[4 * large**2 + 1]]


def plain_repair(rows):
    """(cost, audit, repaired rows) of [(role, text, fault)] by trying every edit at every place."""

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        if inserted < 4:
            c, a, r = best(i, turns.NEXT[state], inserted + 1)
            options.append((3 + c, "I" + a, ((turns.EXPECTED[state], ""), *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = best(i + 1, state, 0)
            options.append((4 + c, "D" + a, r))
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                for edit, to, cost in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((to[:1], state))
                    if after:
                        c, a, r = best(i + 1, after, 0)
                        options.append((cost + late + c, edit + a, ((to, text), *r)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, 0, 0)


def plain_conversation(rows):
    """The result of [(turn, role, text)] in order."""
    seen, faulty, roles = set(), [], []
    for turn, role, text in rows:
        last = text.rstrip("\x20\t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
        roles.append(role[:1])
    known = [t for t, _, _ in rows if t is not None]
    cost, audit, fixed = plain_repair(tuple(faulty))
    count = collections.Counter(f for _, _, f in faulty)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    body = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, body), fixed


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", " \n", "", "Why?\n ", "é!", "x" * 50_000 + ".", None]
    rows = [(c if c else None, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "User"]), rng.choice(texts)) for c in range(120) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("h", F.lit(1)).withColumn("head", F.lit("x")).withColumn("copy", F.lit(0))
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(kind, text)
        by[c].extend([] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
        by[c] = by[c]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    want = {c: plain_conversation(sorted(r, key=order)) for c, r in by.items()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    damaged = turns.damaged(df)
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in turns.repair(damaged).collect()} == {c: w for c, (w, _) in want.items()}
    fixed = collections.defaultdict(list)
    for r in turns.repair(damaged, keep=True).orderBy("at").collect():
        fixed[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: list(f) for c, (_, f) in want.items() if f} == dict(fixed)
    assert turns.repair(turns.damaged(df.limit(0))).count() == 0


def test_lost_conversations_and_shared_suffixes(spark):
    lost = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = turns.repair(turns.damaged(spark.createDataFrame([(*lost, "user", "Hi.")], "conv_id int, turn int, role string, text string"))).collect()
    assert tuple(row) == (lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    suffixes, strings = turns.Suffixes(), [bytes(s) for s in itertools.product(b"uaUx", repeat=4)]
    for s in sorted(strings):
        suffixes.read(s)
        rows = tuple(({"u": "user", "a": "assistant", "U": "user", "x": "user"}[chr(c)], "t", {"U": "truncated", "x": "blank"}.get(chr(c), "")) for c in s[::-1])
        assert suffixes.best() == plain_repair(rows)[:2]
    assert suffixes.made == 1 + 4 + 16 + 64 + 256  # each suffix once


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full, words = {s: weights[i % len(weights)] for i, s in enumerate(names)}, set(), sum(sizes.values())
    while True:
        share = (words - sum(limit * sizes[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        above = {s for s in names if s not in full and weight[s] * share > limit * sizes[s]}
        if not above:
            return {s: limit * sizes[s] if s in full else weight[s] * share for s in names}
        full |= above


@pytest.mark.parametrize("group, fan", [(4096, 64), (8, 2)])
def test_mixing_hits_targets(spark, monkeypatch, group, fan):
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "MANY", 3)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "é", "b", None, "c"]), "w " * rng.choice([1, 3, 9, 40, 500])) for i in range(900)]
    rows += [(1001, "a", "w w w"), (1001, "a", "w w w"), (None, "a", "w"), (1002, "d", None), (1003, "d", " \t"), *[(1005, "b", "w w")] * 8]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("k", F.lit(1)).withColumn("s", F.lit(2))
    got = mixing.mix_sources(df, group=group).collect()
    sizes, own = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, source, text in rows:
        n = len((text or "").split())
        sizes[source] += n
        own[source][i, n] += 1
    want = plain_targets(sizes)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == sum(own.values(), collections.Counter())
    taken = collections.Counter()
    of = {(i, n): s for s, c in own.items() for i, n in c}
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and abs(r["taken"] / r["size"] - want[s] / sizes[s]) < 1
        taken[s] += r["taken"]
    assert {s: (taken[s], want[s], sizes[s]) for s in sizes if abs(taken[s] - want[s]) > (5 if group > 900 else 250)} == {}
    again = mixing.mix_sources(df.repartition(5), group=group).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_pivot_keeps_sums_and_expectations():
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(1, 50, 30))[::-1].copy()
    part, total = rng.random(30), np.zeros(30)
    for _ in range(4000):
        up, words, last = mixing.pivot(size, part * size, rng.random(30))
        assert abs(words.sum() - (part * size).sum()) < 1e-6
        assert ((up >= 0) | (np.arange(30) == last)).all()
        total += words / size
    assert np.abs(total / 4000 - part).max() < 0.05
