"""Hot keys, date forms and stored merges."""

import collections
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import scalars as S
from docweave.operators import extraction, grouping, lifecycle, matching, promotion, ranking
from docweave.sources import merged

#: Texts and their dates in UTC, by hand.
DATES = {
    "2025-09-07": "2025-09-07", "2025-09-07T10:00:00Z": "2025-09-07", "2025-09-07T23:30:00-05:00": "2025-09-08", "2025-09-07T01:00:00+05:30": "2025-09-06", "2025-09-07 01:00:00+0530": "2025-09-06", "2025-09-07T10:00:00.123Z": "2025-09-07",
    "2025-9-7": "2025-09-07", "2025/01/12": "2025-01-12", "2025/1/2": "2025-01-02", "2025.01.12": "2025-01-12", "01/12/2025": "2025-01-12", "1-2-2025": "2025-01-02", "05-08-2025": "2025-05-08", "15-08-2025": "", "12.31.2025": "2025-12-31",
    "12 Jan 2025": "2025-01-12", "12-Jan-2025": "2025-01-12", "1 january 2025": "2025-01-01", "12 Sept 2025": "2025-09-12", "Jan 12, 2025": "2025-01-12", "Jan 12 2025": "2025-01-12", "January 12, 2025": "2025-01-12", "Dec. 1, 2024": "2024-12-01",
    "Sun Jan 12 2025": "2025-01-12", "Sunday, January 12, 2025": "2025-01-12", "Sun, 12 Jan 2025 23:00:00 GMT": "2025-01-12", "Sun Jan 12 2025 22:00:00 GMT-0300": "2025-01-13", "Jan 12, 2025 11:30 PM": "2025-01-12", "Jan 12, 2025 12:10 AM": "2025-01-12",
    "Sun Jan 12 2025 01:00:00 GMT+0200 (Eastern European Time)": "2025-01-11", "2025 Jan 12": "2025-01-12", "02-30-2025": "2025-03-02", "2024-02-30": "2024-03-01", "13/13/2025": "", "2025-00-10": "", "12 Foo 2025": "", "no date": "", "": "", " 2025-09-07 ": "2025-09-07", "2025-12-31T22:00:00-03:00": "2026-01-01",
}


def test_date_forms(spark):
    df = spark.createDataFrame([(k,) for k in DATES] + [(None,)], "a string")
    got = {r["a"]: r["d"] for r in df.select("a", S.normalize_date(F.col("a")).alias("d")).collect()}
    assert got == DATES | {None: ""}
    dmy = {r["a"]: r["d"] for r in df.select("a", S.normalize_date(F.col("a"), "dmy").alias("d")).collect()}
    assert (dmy["15-08-2025"], dmy["01/12/2025"], dmy["Jan 12, 2025"], dmy["2025/01/12"]) == ("2025-08-15", "2025-12-01", "2025-01-12", "2025-01-12")


def test_one_users_rows_are_ranked_over_all_tasks(spark, tmp_path):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("u"), F.xxhash64("id").alias("x"), "id")
    got = ranking.rank_by_ranges(df, ["u"], [F.desc("x"), F.asc("id")])
    want = collections.defaultdict(list)
    for r in df.collect():
        want[r["u"]].append((-r["x"], r["id"]))
    assert {(r["u"], r["id"]): (r["nth"], r["total"]) for r in got.collect()} == {(u, i): (n, len(rows)) for u, rows in want.items() for n, (_, i) in enumerate(sorted(rows), 1)}
    dealt = [r["count"] for r in df.repartitionByRange(8, "u", F.desc("x"), "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(dealt) < 2 * sorted(dealt)[len(dealt) // 2]
    page = ranking.rank_by_ranges(df, ["u"], [F.desc("x"), F.asc("id")], (101, 150))
    assert {(r["u"], r["nth"]) for r in page.collect()} == {(u, n) for u, rows in want.items() for n in range(101, 151) if n <= len(rows)}
    assert ranking.rank_by_ranges(df.limit(0), ["u"], [F.asc("id")]).count() == 0


def test_placeholder_numbers_make_linear_rows(spark):
    rows = [("u", "N/A", str(i)) for i in range(3000)] + [("u", "MAT/UP/24-25/1", "a"), ("u", "MAT/24-25/1", "b"), ("u", "MAT/MH/24-25/001", "c"), ("v", "N/A", "d"), ("u", None, "e"), (None, "N/A", "f")]
    df = spark.createDataFrame(rows, "user_id string, invoice_number string, id string")
    left, right, links = matching.match_classes(df, df, "id", "id")
    assert left.count() == right.count() == 3005 and links.count() == 2 + 7  # placeholders of two users; 3 x 3 without UP-MH
    few = df.where("id IN ('0', '1', 'a', 'b', 'c', 'd')")
    assert {(r["left_id"], r["right_id"]) for r in matching.match_invoices(few, few, "id", "id").collect()} == {(a, b) for x in ("01", "ab", "bc", "d") for a in x for b in x}


def test_pages_of_one_name_share_no_key(spark):
    n = 20_000
    single = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.concat(F.lit("single/u/"), F.col("id"), F.lit("/page_1.pdf")).alias("pdf_path"), F.lit("uploaded").alias("status"))
    parsed = single.where("id % 2 = 0").select("user_id", F.concat(F.lit("https://store.example/x/"), "pdf_path").alias("file_url"))
    open_ = matching.unparsed_pages(single, parsed)
    assert open_.count() == n // 2 and open_.where("id % 2 = 0").count() == 0
    odd = spark.createDataFrame([("1", "u", "/a/b.pdf", "failed"), ("2", "u", "b.pdf", "failed"), ("3", "u", "c.pdf", "failed"), ("4", "v", "b.pdf", "failed"), ("5", "u", None, "failed"), ("6", "u", "b.pdf", "processed")], "id string, user_id string, pdf_path string, status string")
    files = spark.createDataFrame([("u", "https://h/a/b.pdf"), ("u", None), (None, "b.pdf"), ("u", "https://h/a/b.pdf")], "user_id string, file_url string")
    assert {r["id"] for r in matching.unparsed_pages(odd, files).collect()} == {"3", "4", "5"}


def test_history_is_filtered_before_it_is_shuffled(spark):
    history = spark.range(50_000).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("user_id"), F.lit("invoice").alias("document_type"), F.timestamp_seconds("id").alias("created_at"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("business_fingerprint"))
    batch = spark.createDataFrame([("b1", "h", "invoice", "7"), ("b2", "x", "invoice", "hot"), ("b3", "x", "eft_receipt", "8"), ("b4", "x", "invoice", "none"), ("b5", "x", "invoice", None)], "id string, user_id string, document_type string, business_fingerprint string")
    got = matching.duplicates_against_history(batch, history)
    assert {tuple(r) for r in got.collect()} == {("b1", "7", 1, True), *(("b2", str(3 * i), i + 1, False) for i in range(5))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_chunks_hold_the_whole_membership_in_bounded_rows(spark):
    kind = "id string, user_id string, document_type string, anchor_key string, raw_json string, file_url string, created_at timestamp"
    docs = [(str(i), "u", random.Random(i).choice(["invoice", "eft_receipt", "e-way-bill"]), "N/A" if i % 3 else f"A/24-25/{i}", "{}", None, None) for i in range(2000)]
    df = spark.createDataFrame([*docs, ("x", None, "invoice", "N/A", "{}", None, None), ("y", "u", None, "", "", None, None)], kind)
    chunks = grouping.group_chunks(df, size=50).collect()
    assert max(len(r["ids"]) for r in chunks) == 50
    whole = {(r["user_id"], r["invoice_number"]): r for r in grouping.group_documents(df, grouping.business_rules(spark)).collect()}
    parts = collections.defaultdict(list)
    for r in sorted(chunks, key=lambda r: r["chunk"]):
        parts[r["user_id"], r["invoice_number"]] += zip(r["ids"], r["types"], strict=True)
    assert {k: list(zip(r["present_document_ids"], r["present_document_types"], strict=True)) for k, r in whole.items()} == dict(parts)
    short = {(r["user_id"], r["invoice_number"]): r for r in grouping.group_summary(df, grouping.business_rules(spark), 3).collect()}
    assert {k: (r["documents"], r["newest_ids"], r["is_complete"]) for k, r in short.items()} == {k: (len(r["present_document_ids"]), r["present_document_ids"][:3], r["is_complete"]) for k, r in whole.items()}


def test_merges_touch_only_their_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/t/rows/*/bucket=*/*.parquet")}
    old = spark.range(200).select("id", F.lit("a").alias("v"), F.lit(True).alias("checked"))
    schema = spark.createDataFrame([], "id long, v string, checked boolean, city string").schema
    assert merged.merge_into(old, path, schema, ["id"], buckets=16) == 16
    before = files()
    new = spark.createDataFrame([(3, "b", False, "x"), (500, "c", False, "y")], "id long, v string, checked boolean, city string")
    assert merged.merge_into(new, path, schema, ["id"], ("checked",), 16) in (1, 2)
    assert {f: t for f, t in files().items() if f in before} == before and len(files()) <= len(before) + 2
    rows = {r["id"]: (r["v"], r["checked"], r["city"]) for r in merged.read_merged(spark, path, schema).collect()}
    assert rows == {i: ("a", True, None) for i in range(200)} | {3: ("b", True, "x"), 500: ("c", False, "y")}
    assert merged.merge_into(new, path, schema, ["id"], ("checked",), 16) == 0  # the same again
    for bad in ([(1, "p", True, None), (1, "q", True, None)], [(None, "p", True, None)]):
        with pytest.raises(Exception, match="one key|null key"):
            merged.merge_into(spark.createDataFrame(bad, schema), path, schema, ["id"], (), 16)
    assert {r["id"]: (r["v"], r["checked"], r["city"]) for r in merged.read_merged(spark, path, schema).collect()} == rows
    assert merged.merge_into(new.limit(0), path, schema, ["id"], (), 16) == 0


def test_repeated_results_hold_once(spark):
    rows = spark.createDataFrame([("i", "new", None), ("j", "new", "old"), ("k", "new", None)], "invoice_number string, status string, submission_error string")
    results = spark.createDataFrame([("i", False, "first", 1, None), ("i", True, None, 2, "c1"), ("j", True, None, 1, "c2"), ("j", False, None, 3, None), (None, True, None, 1, "c3")], "invoice_number string, ok boolean, error string, at long, collection_id string")
    got = promotion.apply_submission_results(rows, results.withColumn("at", F.timestamp_seconds("at")))
    assert {(r["invoice_number"], r["status"], r["submission_error"], r["collection_id"], r["updated_at"] is None) for r in got.collect()} == {("i", "submitted", None, "c1", False), ("j", "failed", "Unknown error", None, False), ("k", "new", None, None, True)}


def test_listed_recyclers_have_the_longer_list(spark):
    df = spark.createDataFrame([("Mira-Bhayandar Plast", ["invoice", "e-way-bill"]), ("Acme SA", ["invoice", "e-way-bill"])], "recycler_company string, present_document_types array<string>").withColumn("user_id", F.lit("u")).withColumn("invoice_number", F.lit("n"))
    assert [r["complete"] for r in grouping.group_display_status(df).collect()] == [True, False]


def test_known_references_read_documents_once(spark):
    kind = "id string, user_id string, document_type string, anchor_key string, raw_json string"
    doc = lambda i, t, own, more="", user="u": (i, user, t, own, '{"second_invoice": "%s"}' % more)
    rows = [doc("1", "invoice", "A/24-25/1"), doc("2", "eft_receipt", "B/24-25/1", "A/24-25/1"), doc("2", "eft_receipt", "A/24-25/1", "C/24-25/1"), doc("3", "e-way-bill", "C/24-25/1"), doc("4", "eft_receipt", None, "C/24-25/1"), doc("5", "invoice", "N/A", user=None), doc("6", "eft_receipt", "D/24-25/1", "N/A", None), doc("7", "eft_receipt", None, "E/24-25/1")]
    df = spark.createDataFrame(rows, kind)
    got = grouping.group_references(df, known_only=True)
    assert {(r["user_id"], r["group_key"], r["documents"], r["types"]) for r in got.collect()} == {("u", "A-24-25-001", 2, "eft_receipt,invoice"), ("u", "B-24-25-001", 1, "eft_receipt"), ("u", "C-24-25-001", 1, "e-way-bill"), (None, "N-A-00-00-00A", 1, "invoice"), (None, "D-24-25-001", 1, "eft_receipt")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_a_url_is_a_row_for_each_depth_of_the_pages_paths(spark):
    single = spark.createDataFrame([("1", "u", "single/u/a.pdf", "t", "failed"), ("2", "u", "single/u/b.pdf", "t", "failed"), ("3", "u", "c.pdf", "t", "processed"), ("4", "u", None, "t", "failed")], "id string, user_id string, pdf_path string, temp_document_id string, status string")
    parsed = spark.createDataFrame([("u", "HTTPS://h/x/y/z/single/u/A.pdf"), ("u", "https://h/c.pdf"), ("u", "pdf"), ("u", None)], "user_id string, file_url string")
    _, files, _ = matching.ending_files(single, parsed)
    assert files.count() == 5  # depths 1 and 3; "pdf" has one
    temp = spark.createDataFrame([("t", "u", "uploaded")], "id string, user_id string, status string")
    asked = spark.createDataFrame([(i, "u", t) for i, t in (("1", "single_documents"), ("2", "single_documents"), ("3", "unprocessed_documents"), ("4", "single_documents"), ("t", "unprocessed_documents"), ("9", "temp_documents"), ("1", "parsed_documents"), ("1", None))], "document_id string, user_id string, source_table string")
    got = {(r["document_id"], r["source_table"]): r["verdict"] for r in lifecycle.plan_deletions(asked, temp, single, parsed).collect()}
    assert got == {("1", "single_documents"): "processed", ("2", "single_documents"): "allowed", ("3", "unprocessed_documents"): "processed", ("4", "single_documents"): "allowed", ("t", "unprocessed_documents"): "allowed", ("9", "temp_documents"): "not_found", ("1", "parsed_documents"): "protected", ("1", None): "protected"}


def test_stored_responses_are_read_once(spark, tmp_path):
    responses = spark.createDataFrame([(str(i), "u", "f", None, '```json\n{"document_type": "invoice", "invoice": "%s"}\n```' % (i % 4) if i else "no") for i in range(8)], "id string, user_id string, file_url string, created_at timestamp, response_text string")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    history = spark.createDataFrame([("none",)], "business_fingerprint string")
    single = responses.select("id", "user_id", F.lit("uploaded").alias("status"), F.lit(None).cast("string").alias("last_error"))
    parsed, pages = extraction.store_extractions(responses.withColumn("response_text", counted.asNondeterministic()("response_text")), history, single, f"file://{tmp_path}/out")
    assert {r["id"]: r["status"] for r in pages.collect()} == {"0": "failed", "1": "processed", "2": "processed", "3": "processed", "4": "processed", "5": "skipped_duplicate", "6": "skipped_duplicate", "7": "skipped_duplicate"}
    assert {r["id"] for r in parsed.collect()} == {"1", "2", "3", "4"} and reads.value == 8
