"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Test items are cut into windows of 13 consecutive words (an item of fewer words is one window). A first pass counts the test
terms in the corpus; a second stores the postings (term, document, position) of each window's rarest terms. A window's candidates
come from the list of its rarest term, shifted by the term's offset in the window, and are intersected with the shifted lists
of the next ones; windows with a term that the corpus lacks are gone by then. What is left is compared word for word. Proximity
matches need a window's two rarest terms within ``slop`` words of their places.

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. Null and empty texts have no words and no hits. Items with a
null id or without words take no part, repeated items count once, items of one id are one item. Documents are told apart by
id and text, so repeated rows get equal results and a null id is an id like any other. Only columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, stage

WINDOW = 13
#: Lists that are intersected before the word-for-word check.
LISTS = 3
#: Bytes of names up to which a table of the test side is broadcast; beyond it is shuffled.
BROADCAST_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text; empty for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def bounded(table: DataFrame, name: str) -> DataFrame:
    """``table``, to be broadcast if it is small enough as measured."""
    size = table.agg(F.sum(F.octet_length(F.col(name).cast("string")) + 64).alias("n")).first()["n"] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(phrase_id, phrase, words, item_ids): distinct windows and the items that hold them."""
    w = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.least(F.size("w"), F.lit(width))).alias("words"))
    named = each.groupBy(F.array_join("words", " ").alias("phrase"), "words").agg(F.collect_set("item_id").alias("item_ids"))
    return named.select(F.xxhash64("phrase").alias("phrase_id"), "phrase", "words", "item_ids")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.withColumn("key", F.xxhash64("doc_id", "text"))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): how often the corpus has each term of the windows; terms that it lacks are left out."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    test = bounded(terms, "term")
    if test is not terms:
        return found.join(test, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term", "left_semi")


def rarest_terms(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(phrase_id, nth, term, offset): each window's rarest terms, the rarest first; windows with a missing term are left out."""
    each = windows.select("phrase_id", "phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    known = each.join(bounded(counts, "term"), "term").groupBy("phrase_id", "phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("all"))
    whole = known.where(F.size("all") == F.col("size"))
    return whole.select("phrase_id", F.posexplode(F.slice("all", 1, lists)).alias("nth", "x")).select("phrase_id", F.col("nth"), F.col("x.term").alias("term"), F.col("x.offset").alias("offset")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (term, key, position) of ``terms``."""
    wanted = terms.select("term").distinct()
    found = docs.select("key", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return stage(found.join(bounded(wanted, "term"), "term").select("term", "key", "position"), "postings")


def shifted(index: DataFrame, rarest: DataFrame, nth: int) -> DataFrame:
    """(key, phrase_id, start): where each window would begin, by the list of its nth rarest term."""
    mine = rarest.where(F.col("nth") == nth).select("term", "phrase_id", "offset")
    start = F.col("position") - F.col("offset")
    return index.join(bounded(mine, "term"), "term").select("key", "phrase_id", start.alias("start")).where(F.col("start") >= 0)


def candidates(index: DataFrame, rarest: DataFrame, lists: int = LISTS) -> DataFrame:
    """(key, phrase_id, start) that all lists agree on, from the rarest on."""
    found = shifted(index, rarest, 0).distinct()
    for nth in range(1, lists):
        # Windows with fewer terms than lists pass the lists they don't have.
        has = rarest.where(F.col("nth") == nth).select("phrase_id").distinct()
        more, less = found.join(bounded(has, "phrase_id"), "phrase_id", "left_semi"), found.join(bounded(has, "phrase_id"), "phrase_id", "left_anti")
        found = more.join(shifted(index, rarest, nth), ["key", "phrase_id", "start"], "left_semi").unionByName(less)
    return found


def exact_matches(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, doc_id, hits): the candidates that hold word for word, as structs of start, size, phrase_id and phrase."""
    phrases = windows.select("phrase_id", "phrase", F.size("words").alias("size"))
    per_doc = found.join(bounded(phrases, "phrase"), "phrase_id").groupBy("key").agg(F.collect_set(F.struct("start", "size", "phrase_id", "phrase")).alias("maybe"))
    w = docs.select("key", "doc_id", "text").join(per_doc, "key").select("key", "doc_id", "maybe", words_of(F.col("text")).alias("w"))
    same = F.filter("maybe", lambda c: F.array_join(F.slice(F.col("w"), c["start"] + 1, c["size"]), " ") == c["phrase"])
    return w.select("key", "doc_id", same.alias("hits")).where(F.size("hits") > 0).dropDuplicates(["key", "doc_id"])


def proximity_matches(index: DataFrame, rarest: DataFrame, slop: int = 5) -> DataFrame:
    """(key, phrase_id, start, apart): the two rarest terms of a window within ``slop`` words of their places; the least distance for each start."""
    a = shifted(index, rarest, 0)
    b = shifted(index, rarest, 1).withColumnRenamed("start", "other")
    cell = F.lit(slop + 1)
    left = a.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / cell) + i for i in (-1, 0, 1)])))
    near = left.join(b.withColumn("cell", F.floor(F.col("other") / cell)), ["key", "phrase_id", "cell"]).where(F.abs(F.col("start") - F.col("other")) <= slop)
    return near.groupBy("key", "phrase_id", "start").agg(F.min(F.abs(F.col("start") - F.col("other"))).alias("apart"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, keep_key: bool = False) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``keep_key`` also the hash of id and text."""
    base = keyed(docs, doc_id, text)
    windows = stage(windows_of(items, item_id, item_text, width), "windows")
    rarest = stage(rarest_terms(windows, term_counts(base, windows)), "rarest")
    index = build_index(base, rarest)
    found = stage(exact_matches(base, candidates(index, rarest), windows), "matches")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    spans = found.select("key", "doc_id", F.size(covered).cast("long").alias("n_hit"))
    owners = windows.select("phrase", F.explode("item_ids").alias("item"))
    pairs = found.select("key", "doc_id", F.explode(F.array_distinct(F.transform("hits", lambda h: h["phrase"]))).alias("phrase")).join(bounded(owners, "phrase"), "phrase")
    named = pairs.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    named = named.withColumnsRenamed({"key": "key2", "doc_id": "id2"})
    facts = stage(spans.join(named, (F.col("key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("id2"))).select("key", F.col("doc_id").alias("id"), "n_hit", "items"), "contamination")
    counted = base.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(facts, (counted["key"] == facts["key"]) & counted["doc_id"].eqNullSafe(facts["id"]), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        *([counted["key"]] if keep_key else []), "doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        sha256_hex(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary")).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS p FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
