"""Operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import decontaminate, jaccard, langid, licenses, pieces, pii, quality, topk, toxicity, warc
from docweave.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é"), (5, "Mixed CASE text of Ten words to be sure here"), (5, "Mixed CASE text of Ten words to be sure here"), (None, "no id at all"), (7, LONG), (8, "9" * 30_000), (9, "a@b" * 5_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("base", F.lit(2)).withColumn("n", F.lit(3)).withColumn("lang", F.lit(None).cast("string"))


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want, cols = c.sql(ORACLES[name]), sorted(df.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(str([r[x] for x in cols]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_language(spark, odd):
    learn = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de")] * 20)]
    model = langid.fit(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "the dog"), (2, "und der hund"), (3, None), (4, "12 34 !"), (5, "")], "doc_id long, text string"), model, keep=("doc_id",))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    empty = langid.fit(odd)
    assert {r["lang_pred"] for r in langid.predict(odd, empty, keep=("doc_id",)).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_language_and_labels_held_out(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    got = QUERIES["op1_language"](spark, DATA.replace("0.001", "0.01")).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    got = QUERIES["op7_quality"](spark, DATA.replace("0.001", "0.01")).where("held_out").join(labels, "doc_id")
    assert got.where("quality = predicted").count() / got.count() > 0.95
    some = {r["doc_id"]: r["held_out"] for r in QUERIES["op7_quality"](spark, DATA).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in some.items())


def test_nearest_examples_are_exact(spark):
    rng = np.random.default_rng(1)
    vocab = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    index = toxicity.BlockMaxIndex(vocab, rng.random(40) + 0.1, np.arange(500), rng.integers(0, 2, 500).astype(float), np.ones(500), 7)
    vectors = [(np.sort(rng.choice(40, rng.integers(1, 8), False)), None) for _ in range(500)]
    vectors = [(p, rng.integers(1, 4, len(p))) for p, _ in vectors]
    index.build(vectors)
    dense = np.zeros((500, 40))
    for i, (p, t) in enumerate(vectors):
        dense[i, p] = index.weigh(p, t)
    for p, t in vectors[:40]:
        q = np.zeros(40)
        q[p] = index.weigh(p, t)
        cosine = np.round(dense @ q, 9)
        want = sorted((i for i in range(500) if cosine[i] > 0), key=lambda i: (-cosine[i], i))[:7]
        found, values = index.nearest(p, index.weigh(p, t))
        assert np.allclose(values, cosine[want]) and (np.round(values, 9) == cosine[found]).all()


def test_nearest_examples_with_light_terms():
    """Terms of little weight are not read and many examples are alike: still the exact nearest, for groups and without own ids."""
    rng = np.random.default_rng(12)
    idf = np.concatenate([np.full(300, 0.02), rng.random(200) * 2 + 0.3, [0.0]])
    ids = rng.integers(0, 900, 1000)
    index = toxicity.BlockMaxIndex(np.arange(501, dtype=np.uint64), idf, ids, np.zeros(1000), np.ones(1000), 9)
    chosen = [np.sort(np.append(rng.choice(300, 12, False), 300 + rng.choice(200, 5, False))) for _ in range(700)]
    chosen += [np.array([500]), np.array([3, 500])] + [chosen[i] for i in rng.integers(0, 40, 298)]
    vectors = [(p, rng.integers(1, 4, len(p)) if i < 700 else np.ones(len(p), int)) for i, p in enumerate(chosen)]
    vectors = index.build(vectors).vectors and vectors
    light = index.column == -2
    assert light[:300].any() and len(index.posting) < sum((~light[p]).sum() for p, _ in vectors) + 1
    dense = np.zeros((1000, 501))
    for i, (p, t) in enumerate(vectors):
        dense[i, p] = index.weigh(p, t)
    asked = [i for i in range(0, 1000, 9) if dense[i].any()]
    for without in (None, [int(ids[i]) for i in asked]):
        got = index.nearest_of([(vectors[i][0], index.weigh(*vectors[i])) for i in asked], without)
        for n, (i, (found, values)) in enumerate(zip(asked, got, strict=True)):
            cosine = np.round(dense @ dense[i], 12)
            if without:
                cosine[ids == without[n]] = 0
            want = sorted((j for j in range(1000) if cosine[j] > 0), key=lambda j: (-cosine[j], ids[j]))[:9]
            assert np.allclose(values, cosine[want], atol=1e-11) and (ids[found] == ids[want]).all()


def test_vocabulary_places():
    rng = np.random.default_rng(13)
    for size in (0, 1, 50, 5000):
        terms = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
        asked = rng.permutation(np.concatenate([terms, terms, rng.integers(0, 1 << 63, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
        which, places = toxicity.Vocabulary(terms).find(asked)
        assert sorted(which) == list(np.flatnonzero(np.isin(asked, terms))) and (terms[places] == asked[which]).all()


def test_classifiers_take_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (None, 1, 1), (99, 1, 0), (1, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        for given in (labels, labels.limit(0)):
            model = module.fit(odd, given, name)
            rows = module.score(odd, model, keep=("doc_id",)).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


def test_decontamination(spark, odd):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (None, item), (4, ""), (2, "Short item")], "item_id long, text string")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(20, f"x {item.upper()} y"), (21, item[: item.rindex(" ")]), (22, "a short, ITEM b short item"), (23, item.replace("seven", "7"))], "doc_id long, text string")).withColumn("n_hit", F.lit(0))
    got = collections.defaultdict(list)
    for r in decontaminate.contamination(docs, items).collect():
        got[r["doc_id"]].append(r)
    for i, t in docs.select("doc_id", "text").collect():
        assert got[i][0]["n_words"] == len(words(t))
    assert (got[20][0]["n_hit"], got[20][0]["n_items"], got[21][0]["n_hit"], got[22][0]["n_hit"], got[23][0]["n_hit"]) == (14, 1, 13, 4, 0)
    assert got[22][0]["items_sha256"] == hashlib.sha256(b"2").hexdigest() and got[1][0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert len(got[5]) == 2 and not got[5][0]["contaminated"] and got[20][0]["contaminated"]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    base, w = decontaminate.keyed(docs), decontaminate.windows_of(items)
    rarest = decontaminate.rarest_terms(w, decontaminate.term_counts(base, w))
    near = decontaminate.proximity_matches(decontaminate.build_index(base, rarest), rarest, 3)
    assert near.where("apart > 3").count() == 0 and near.count() > 0


def test_archive(spark):
    from docweave.llm.common import scratch_dir

    big, huge = "payload " * 20, "x" * 300_000
    rows = [(3, "u3", big), (1, "u1\r\nX: y", big), (2, None, big), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", None), (7, "u7", ""), (None, "n", big), (8, "u8", huge), (3, "u3", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("salt", F.lit(0))
    path = f"{scratch_dir(spark)}/archive-test"
    warc.write_archive(pages, path)
    got = {}
    for r in warc.read_records(spark, path).collect():
        got.setdefault(r["page_id"], r)
    assert {k: r["record_type"] for k, r in got.items()} == {"1": "response", "2": "revisit", "3": "revisit", "4": "response", "5": "response", "6": "response", "7": "response", "8": "response", None: "revisit"}
    assert got["3"]["refers_to"] == "1" and got["6"]["payload_bytes"] == 0 and got["8"]["payload_digest"] == hashlib.sha256(huge.encode()).hexdigest()
    whole = warc.original_records(spark, path).collect()
    assert len(whole) == len(rows)
    for r in whole:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert b"\nX: y" not in head and head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        digest = re.search(rb"sha256:(\w+)", head)[1].decode()
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == digest == r["digest"]
        revisit = b"WARC-Type: revisit" in head
        assert rest[:-4] == (b"" if revisit else bytes(r["payload"])) and int(re.search(rb"\nContent-Length: (\d+)", head)[1]) == len(rest) - 4
        assert revisit == (b"WARC-Profile: " in head)
    assert all(r["intact"] for r in got.values())
    # Each payload is stored once, though rows of one id repeat it.
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    # Payloads that are lost or altered are reported; no record vanishes.
    records, stored = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    records.write.parquet(f"{path}-hurt/records")
    hurt = stored.where("size != 300000").withColumn("body", F.when(F.col("size") == 5, F.lit("smalx").cast("binary")).otherwise(F.col("body")))
    hurt.write.parquet(f"{path}-hurt/payloads")
    bad = {r["page_id"]: r["payload_bytes"] for r in warc.read_records(spark, path + "-hurt").where("NOT intact").collect()}
    assert bad == {"4": 5, "5": 5, "8": None} and warc.read_records(spark, path + "-hurt").count() == len(rows)
    # Many rows of a null id and one payload, more than one copy of it serves.
    crowd = spark.range(5000).select(F.lit(None).cast("long").alias("page_id"), F.col("id").cast("string").alias("url"), F.lit(big).alias("html"))
    warc.write_archive(crowd, path + "-crowd")
    assert spark.read.parquet(f"{path}-crowd/payloads").count() == 1
    assert warc.read_records(spark, path + "-crowd").where("intact AND record_type = 'response'").count() == 5000
    warc.write_archive(pages.limit(0), path + "-empty")
    assert warc.read_records(spark, path + "-empty").count() == 0


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (62, [float("nan")] * 6), (None, [1.0] * 6), (63, [1e6] * 6), (64, [1.0, 2.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    good = {i: [int(np.floor(1024 * x)) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], e, strict=True)), i) for i, e in good.items() if i != q and len(e) == len(good[q]))[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    for size in (4 << 20, 100):
        assert {tuple(r) for r in topk.top_k(v, v.where("vec_id % 10 = 0"), 5, size).collect()} == want
    assert topk.top_k(v, v.limit(0)).count() == 0


def test_pieces(spark, odd):
    texts = odd.select("doc_id", "text").union(spark.createDataFrame([(30, "▁ sign  and   blanks "), (31, "漢字😀\r\n"), (32, "ab" * 3000)], "doc_id long, text string"))
    plain = {}
    for seed in (1, 2):
        ids = pieces.encode(texts.select("doc_id", F.col("text").alias("t")), text="t", keep=("doc_id", "t"), seed=seed, dropout=0.3)
        back = pieces.decode(ids, keep=("doc_id", "t", "ids"))
        assert back.where(~F.col("t").eqNullSafe(F.col("text"))).count() == 0
        plain[seed] = {r["doc_id"]: r["ids"] for r in back.collect()}
        assert plain[seed][1] is None and plain[seed][2] == []
    assert plain[1][7] != plain[2][7]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    for r in pieces.encode(texts.where("text NOT LIKE '%▁%'"), keep=("doc_id", "text"), dropout=0.0).collect():
        assert r["ids"] == sp.encode(r["text"])


def plain_agenda(t, symbols, key, dropout):
    """Merge-dropout as its definition reads: each step joins the best candidate that isn't skipped (one symbol id, first place and end each)."""
    parts = [(int(s), i, i + 1) for i, s in enumerate(symbols)]
    while True:
        best = None
        for n, ((a, i, m), (b, _, j)) in enumerate(zip(parts, parts[1:], strict=False)):
            made = int(t.join(np.array([a]), np.array([b]))[0])
            if made >= 0 and not pieces._skips(np.array([key], np.uint64), np.array([i]), np.array([m]), np.array([j]), dropout)[0]:
                rank = (int(t.rank[made]), i)
                best = min(best, (rank, n, made)) if best else (rank, n, made)
        if best is None:
            return [i for _, i, _ in parts]
        _, n, made = best
        parts[n : n + 2] = [(made, parts[n][1], parts[n + 1][2])]


def test_pieces_agenda():
    """Rounds and heap agree with a plain agenda at every dropout, and a unit under another unit's key is encoded anew."""
    t = pieces.load("/opt/tokenizers/piece_bpe_32k.model")
    rng = random.Random(4)
    for dropout in (0.0, 0.2, 0.5, 1.0):
        for _ in range(25):
            unit = " " + "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 30)))
            ids = t.chars[np.array([ord(c) for c in unit])].astype(np.int64)
            key = np.uint64(rng.getrandbits(64))
            want = plain_agenda(t, ids, key, dropout)
            alive = pieces._in_rounds(t, ids.copy(), np.array([0, len(ids)]), np.array([key]), dropout)
            assert np.flatnonzero(alive).tolist() == want
            assert list(pieces._by_heap(t, ids.copy(), key, dropout)) == want
    data = np.frombuffer(b"another another other other", np.uint8)
    known, at = pieces.Known(100), np.array([0, len(data)])
    first, _ = pieces.encode_texts(t, data, at, 3, 0.1, known)
    assert len(known.keys) and pieces.encode_texts(t, data, at, 3, 0.1, known)[0].tolist() == first.tolist()
    known.points.values = known.points.values[::-1].copy()
    assert pieces.encode_texts(t, data, at, 3, 0.1, known)[0].tolist() == first.tolist()


def test_pieces_draw_for_each_occurrence(monkeypatch):
    """Taking the plain encoding where no merge of it is skipped equals an agenda for every occurrence; a word has as many segmentations as its draws give."""
    t = pieces.load("/opt/tokenizers/piece_bpe_32k.model")
    rng = random.Random(9)
    words = ["internationalisation", "reading", "the", "x" * 230, "漢字", "newspapers"]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(4)]
    texts += [texts[0], "", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    known = pieces.Known(100)
    for dropout in (0.0, 0.1, 0.6):
        got, cut = pieces.encode_texts(t, data, at, 5, dropout, known)
        again, _ = pieces.encode_texts(t, data, at, 5, dropout, known)
        assert got.tolist() == again.tolist() and pieces.decode_ids(t, got, cut) == texts
        assert got[cut[0] : cut[1]].tolist() == got[cut[4] : cut[5]].tolist()
        if dropout:
            with monkeypatch.context() as m:
                m.setattr(pieces, "_departs", lambda merges, start, count, key, dropout: np.ones(len(key), bool))
                m.setattr(pieces, "_runs", lambda size: [slice(i, min(i + 7, len(size))) for i in range(0, len(size), 7)])
                assert pieces.encode_texts(t, data, at, 5, dropout)[0].tolist() == got.tolist()
    many = b" ".join([b"internationalisation"] * 2000)
    ids, _ = pieces.encode_texts(t, np.frombuffer(many, np.uint8), np.array([0, len(many)]), 5, 0.1)
    raw = [bytes(t.text[t.text_at[i] : t.text_at[i + 1]]).decode() for i in ids]
    seen, word = set(), []
    for piece in raw:
        if piece.startswith(" ") and word:
            seen.add(tuple(word))
            word = []
        word.append(piece)
    assert len(seen) > 50


def brute_components(rows, like):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + like.width]) for i in range(len(w) - like.width + 1)} if len(w) >= like.width else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and like.den * both >= like.num * (len(x) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), (least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("like", [jaccard.Likeness(3, 90, 100), jaccard.Likeness(5, 80, 100)])
def test_jaccard_join(spark, like):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = list(ODD[:7])
    for i in range(100, 260):  # a star of copies with a few words changed, many too far from each other
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    common = " ".join(f"c{j}" for j in range(30))
    rows += [(i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(12))) + " " + common) for i in range(300, 380)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0))
    got = sorted(map(str, (tuple(r) for r in jaccard.linked(df, like).collect())))
    assert got == sorted(map(str, brute_components(rows, like)))
    assert jaccard.linked(df.limit(0), like).count() == 0


def test_personal_data(spark, odd):
    samples = ["mail a.b+c@d-e.co.uk, b@c.d@e.f or x@y", "ips 1.2.3.4 and 999.1.1.1 0255.0.0.1 1.2.3.4.5.6.7.8", "cards 4785380592391139 4785-3805 9239 1139 4785380592391138 1-2", "call +49 (30) 123-4567 89. +1 2 +12345678901234567", "+4478", "é😀 q@w.de é"]
    docs = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).union(spark.createDataFrame([(40 + i, t) for i, t in enumerate(samples)], "doc_id long, text string"))
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, value):
        d = [int(c) for c in value if c.isdigit()]
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
        return all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else kind != "phone" or 10 <= len(d) <= 15

    found = pii.find(docs, pii.SpanModel())
    for r in found.withColumn("s", pii.joined(F.col("base"))).withColumn("red", pii.redact(F.col("text"), F.col("spans"))).collect():
        want = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(plain.items()) for m in re.finditer(p, r["text"], re.A) if good(k, m.group()))
        assert r["s"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert want or r["red"] == r["text"]
        assert not any(r["text"][a:b] in r["red"] for a, _, b, k in want if k == "email")
    assert pii.fit(docs).threshold == {}
    forced = pii.SpanModel(5.0, [], {k: 0.5 for k in pii.LOOSE})
    for r in pii.find(docs, forced).collect():
        ends = sorted((s["start"], s["stop"]) for s in r["spans"] if s["kind"] in pii.LOOSE)
        assert all(a[1] <= b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_licenses(spark, odd):
    texts = [(50, "Licensed under teh Apache Licence"), (51, "CC-BY 4.0, All  rights -- reserved. cc by"), (52, "acc by; General Public Licensee"), (53, "the General Public License"), (54, None)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licenses.scan(df, keep=("doc_id",)).collect()}
    assert "apache" in got[50]["labels"] and 0 < got[50]["score"] < 1 and got[50]["base_labels"] == ""
    assert (got[51]["n_base"], got[51]["first_word"], got[51]["last_word"], got[51]["base_labels"]) == (3, 0, 7, "cc-by,reserved")
    assert got[52]["n_base"] == 0 and got[53]["base_labels"] == "gpl" and got[54]["n_words"] == 0
    for i, t in df.collect():
        assert got[i]["n_words"] == len(words(t))
    rng = random.Random(4)
    for text, label, errors in licenses.NOTICES:
        for _ in range(5):
            wrong = list(text)
            for _ in range(errors):
                at = rng.randrange(len(wrong))
                wrong[at : at + 1] = rng.choice([[], ["~"], [wrong[at], "~"]])
            assert label in {x[0] for x in licenses.fuzzy("some words " + "".join(wrong) + " more")}


CLASH = ("key", "base", "spans", "loose", "stat_words", "score", "__score", "row", "own_key", "bad_id", "component_id", "n", "k")


def test_pipeline(spark):
    """Each stage against a plain rule, on the table with odd rows and columns whose names clash with those of the stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd_rows = spark.createDataFrame([(d if d is None else d + 10**6, t) for d, t in ODD], "doc_id long, text string")
    docs = docs.unionByName(odd_rows, allowMissingColumns=True).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    now = docs
    for name, function in corpus_pipeline.STAGES:
        before, now = now, corpus_pipeline.stage(function(spark, now, DATA), f"test-{name}")
        if name == "quality":
            now = corpus_pipeline.stage(now.unionByName(docs.where("doc_id > 1000000 OR doc_id IS NULL")).distinct(), "test-odd")
        if name != "pieces":
            assert now.columns == docs.columns
            assert now.where(" OR ".join(f"`{c}` <> 'own {c}'" for c in CLASH)).count() == 0
        rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
        left = now.select("doc_id", *(["text"] if name != "pieces" else ["ids"])).collect()
        if name == "quality":
            assert all(labels.get(i) != 1 for i in {d for d, _ in rows} - {r["doc_id"] for r in left})
        if name == "near_duplicates":
            keep = {d for d, _, c in brute_components(rows, jaccard.Likeness()) if d == c or d is None}
            assert sorted(str(r["doc_id"]) for r in left) == sorted(str(d) for d, _ in rows if d in keep)
        if name == "decontamination":
            assert sorted(str(r["doc_id"]) for r in left) == sorted(str(d) for d, t in rows if not brute_contaminated(t, items))
        if name == "personal_data":
            assert sorted(str(r["doc_id"]) for r in left) == sorted(str(d) for d, _ in rows)
            assert not any(re.search(r'token = "[0-9a-f]{40}"|@[a-z0-9-]+[.]', r["text"] or "") for r in left)
        if name == "pieces":
            back = pieces.decode(now, keep=("doc_id",))
            assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(map(str, rows))
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), DATA).count() == 0


def brute_contaminated(text, items):
    own = words(text)
    hit, places = set(), collections.defaultdict(list)
    for j, w in enumerate(own):
        places[w].append(j)
    for item in items:
        w = words(item)
        for i in range(len(w) - 12) if len(w) >= 13 else range(bool(w)):
            window = w[i : i + 13]
            for j in places[window[0]]:
                if own[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_personal_data_beyond_the_base_formats(spark):
    """A fitted model adds addresses without "@" and numbers without "+"; other uses of "[at]" and other numbers stay."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    texts = []
    for i in range(300):
        texts.append(f"{name()} write to {name()}.{rng.randrange(99)}@{name()}.org or {name()}")
        texts.append(f"{name()} phone +1 {number()} {name()}")
        texts.append(f"{name()} cost {rng.randrange(9)}.{rng.randrange(10**9, 10**10)} {name()} sold {rng.randrange(9)} (at) {rng.randrange(99)}.{rng.randrange(10, 99)} {name()}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(docs)
    assert set(model.threshold) == set(pii.LOOSE)
    new = [(0, "please ask jane.roe [at] host.org today", "please ask [email_like] today"), (1, "call phone 415-555-2671 now", "call phone [number_like] now"), (2, "sold 7 (at) 12.50 today", "sold 7 (at) 12.50 today")]
    found = pii.find(spark.createDataFrame([r[:2] for r in new], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["red"] for r in found.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("red")).collect()} == {i: red for i, _, red in new}
    # Addresses that are in the sample already don't count against the kind.
    more = docs.union(spark.createDataFrame([(1000 + i, f"{name()} ask {name()} [at] {name()}.org {name()}") for i in range(300)], "doc_id long, text string"))
    assert "email_like" in pii.fit(more).threshold


def test_jaccard_links_through_texts_without_id(spark):
    base = [f"w{j}" for j in range(200)]
    near = lambda places: " ".join(f"x{j}" if j in places else w for j, w in enumerate(base))
    rows = [(1, near((10, 50, 90))), (2, near((110, 150, 190))), (None, near(())), (None, near(())), (3, "some other text of its own words")]
    like = jaccard.Likeness(3, 90, 100)
    got = sorted(map(str, (tuple(r) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), like).collect())))
    assert got == sorted(map(str, brute_components(rows, like)))
    assert sum(x.endswith(" 1)") for x in got) == 4


def test_topk_of_one_id_on_two_vectors(spark):
    rows = [(0, [1.0] * 8), (5, [50.0, 50.0, -50.0, -50.0] + [0.0] * 4), (5, [-50.0, -50.0, 50.0, 50.0] + [0.0] * 4), (6, [-0.5] * 4 + [21.0] * 4)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    v = v.coalesce(1)  # one list has the best of both rows
    assert [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0"), 1).collect()] == [(0, 1, 6, 82 << 20)]
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(c) for c in x]) for i, x in zip(rng.integers(0, 60, 150), rng.integers(-9, 9, (150, 8)), strict=True)] + [(100, [1.0] * 8), (101, [float(c) for c in range(8)])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id >= 100"), 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q, x in rows[-2:]:
        best = sorted((-int(np.dot(x, y)) << 20, i) for i, y in rows if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


def test_jaccard_crowded_groups(spark, monkeypatch):
    """A large family of copies at all distances, families inside a passage that many share, and few pairs allowed: hubs of hubs."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    monkeypatch.setattr(jaccard, "LANE", 16)
    rng = random.Random(8)
    rows = []
    for family in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 120, 121)))]
        for _ in range(90):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = rng.choice((f"x{rng.randrange(10**6)}", f"z{rng.randrange(6)}"))
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(f"c{j}" for j in range(80))
    for i in range(120):
        own = [f"y{rng.randrange(10**6)}" for _ in range(6)]
        for _ in range(3):
            rows.append((len(rows), " ".join(own[: rng.randrange(4, 7)]) + " " + passage + (f" v{rng.randrange(3)}" if i % 2 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for like, rounds in ((jaccard.Likeness(3, 90, 100), 3), (jaccard.Likeness(5, 80, 100), 1)):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        got = sorted(map(str, (tuple(r) for r in jaccard.linked(df, like).collect())))
        assert got == sorted(map(str, brute_components(rows, like)))


def test_jaccard_postings_of_differences(spark):
    """No postings of tokens that one label alone has, none from the middle on where a member has its hub's label, and no pair lost."""
    rng = random.Random(14)
    like, hub, base = jaccard.Likeness(5, 80, 100), 1000, set(range(100))
    sets = {k: base - {k % 5, 5 + k % 3, 90} | {200 + k % 4} for k in range(60)}  # all link with the hub
    far = base - set(range(40, 52)) | set(range(300, 312))
    sets |= {k: far - {rng.randrange(30)} | {200 + rng.randrange(4)} for k in range(60, 80)}  # too far from it, near each other
    rows = [(hub, k % 2, k, len(x), 100, k < 60, [v << 20 for v in sorted(x ^ base)]) for k, x in sets.items()]
    differences = spark.createDataFrame(rows, "hub long, lane int, k long, n int, hub_n int, linked boolean, d array<int>")
    label = {k: hub if k < 60 else k // 61 * 60 for k in sets}  # of those far away, one has another label
    labels = spark.createDataFrame([*label.items(), (hub, hub)], "k long, label long")
    got = jaccard._postings_of(differences, labels, like).collect()
    groups, places = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        groups[r["g"]].add(r["k"])
        places[r["k"]].add(r["pos"])
    own = {k: len(x ^ base) for k, x in sets.items()}
    shared = {v for v in set().union(*(x ^ base for x in sets.values())) if len({label[k] for k, x in sets.items() if v in x ^ base}) > 1}
    counters = collections.Counter(v for x in sets.values() for v in (x ^ base) & shared)
    assert all(2 * p < own[k] for k in range(60) for p in places[k])
    assert sum(map(len, groups.values())) < sum(counters.values()) < sum(own.values())
    for x, y in itertools.combinations(sets, 2):
        if label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            assert any({x, y} <= g for g in groups.values())


def test_topk_cutoff_prunes():
    rng = np.random.default_rng(9)
    q, x = rng.integers(-1000, 1000, (20, 16)), rng.integers(-1000, 1000, (5000, 16))
    local = np.stack([topk._product(q[:, p], x[:, p]) for p in topk._parts(16)])
    local -= local.min(2, keepdims=True)
    total = local.sum(0)
    floor = np.sort(total, 1)[:, -10]
    still = topk.open_entries(local, floor)
    assert (still | (total < floor[:, None])).all() and still.mean() < 0.5


def sellers(low, notice):
    """For each end in the text, the least edits of the notice against a substring that ends there."""
    row = list(range(len(notice) + 1))
    out = []
    for c in low:
        new = [0]
        for i, n in enumerate(notice, 1):
            new.append(min(row[i - 1] + (c != n), row[i] + 1, new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


def test_licenses_lose_no_occurrence():
    """Every substring within the errors, by a plain scan, overlaps a reported span of its notice, and spans have their exact edits."""
    assert [x[1:3] for x in licenses.fuzzy("gnu genral public license, gnu general public license", (("gnu general public license", "g", 2),))] == [(0, 25), (27, 53)]
    rng = random.Random(10)
    for text, label, errors in licenses.NOTICES:
        for _ in range(3):
            parts = []
            for _ in range(4):
                wrong = list(text)
                for _ in range(rng.randrange(errors + 1)):
                    at = rng.randrange(len(wrong))
                    wrong[at : at + 1] = rng.choice([[], ["~"], [wrong[at], "~"]])
                parts.append("".join(wrong) + rng.choice(("", " ", ", and ")))
            low = "".join(parts)
            one = ((text, label, errors),)
            spans = licenses.fuzzy(low, one)
            assert all(a[2] <= b[1] for a, b in zip(spans[:-1], spans[1:], strict=True))
            for _, a, b, e in spans:
                assert e <= errors and sellers(low[a:b], text)[-1] <= e
            for end, least in enumerate(sellers(low, text), 1):
                if least <= errors and text not in licenses.PHRASES:
                    assert any(a < end and b > end - len(text) + errors for _, a, b, _ in spans)


def test_topk_steps_are_bounded():
    import pyarrow as pa

    x = np.arange(3000 * 2).reshape(-1, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.tolist(), pa.list_(pa.int64()))], ["vec_id", "v"])
    found = list(topk._steps([batch], 8192, 2))
    assert all(len(i) * 8192 * topk.GROUPS <= topk.STEP_SCORES for i, _ in found)
    assert (np.concatenate([m for _, m in found]) == x).all()
