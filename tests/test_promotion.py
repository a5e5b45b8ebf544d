"""Edge cases of promotion, the merge by key, extraction cleaning and the streaming duplicate check."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import extraction, promotion
from docweave.streaming import jobs


def test_upsert_keeps_preserved_columns_and_null_keys(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, False), (None, 3, True)], "k string, v int, checked boolean")
    new = spark.createDataFrame([("a", 10, False, "x"), ("c", 30, False, "y"), (None, 40, False, "z"), (None, 41, False, "z")], "k string, v int, checked boolean, city string")
    rows = {tuple(r) for r in promotion.upsert(old, new, ["k"], ("checked",)).collect()}
    assert rows == {("a", 10, True, "x", "updated"), ("b", 2, False, None, "kept"), ("c", 30, False, "y", "created"), (None, 3, True, None, "kept"), (None, 40, False, "z", "created"), (None, 41, False, "z", "created")}


def test_upsert_refuses_two_rows_of_one_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="two incoming rows"):
        promotion.upsert(df.limit(0), df, ["k"]).collect()


def test_groups_without_documents_are_not_promoted(spark):
    groups = spark.createDataFrame([("u", "MAT/24-25/1")], "user_id string, invoice_number string")
    parsed = spark.createDataFrame([], "id string, user_id string, document_type string, raw_json string, file_url string, created_at timestamp")
    (row,) = promotion.promote_groups(groups, parsed).collect()
    assert not row["is_promoted"] and row["missing"] == list(promotion.REQUIRED) and row["recycler_company"] == "Unknown"


def test_extraction_fences_and_keys(spark):
    texts = ['```json\n{"invoice": " A1 "}\n```', ' {"document_type":"e-way-bill","eway_bill_number":"9"} ', '{"document_type":"e-way-bill"}', "```", "", None, '{"invoice"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("d", extraction.parse_extraction(F.col("t")))
    got = {r["i"]: (r["ok"], r["k"]) for r in df.select("i", F.col("d").isNotNull().alias("ok"), extraction.anchor_key(F.col("d"), F.lit("u")).alias("k")).collect()}
    assert got[0] == (True, "A1") and got[1] == (True, "9") and got[2][1].startswith("EWAY-")
    assert all(got[i] == (False, None) for i in (3, 4, 5, 6))


def test_stream_drops_invoices_of_earlier_batches(spark, tmp_path):
    kind = "id string, user_id string, document_type string, created_at timestamp, business_fingerprint string"
    parts = [[("1", "u", "invoice", None, "f"), ("2", "u", "eft_receipt", None, "f")], [("3", "v", "invoice", None, "f"), ("4", "v", "invoice", None, "g"), ("5", "v", "eft_receipt", None, "f")]]
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    kept = {r["id"] for r in jobs.stream_deduplicate(stream).collect()}
    assert {"2", "4", "5"} <= kept and len(kept & {"1", "3"}) == 1


def test_extractions_are_stored_once_and_pages_follow(spark, tmp_path):
    kind = "id string, user_id string, file_url string, created_at timestamp, response_text string"
    rows = [
        ("1", "u", "f1", None, '{"document_type":"invoice","invoice":"A"}'), ("2", "u", "f2", None, '```json\n{"document_type":"invoice","invoice":"a"}\n```'), ("3", "u", "f3", None, "{"),
        ("4", "u", "f4", None, '{"document_type":"additional_document"}'), ("5", "u", "f5", None, '{"document_type":"eft_receipt","invoice":"A"}'), ("6", "u", "f6", None, '{"document_type":"invoice","invoice":"old"}'), ("7", None, None, None, None),
    ]
    pages = spark.createDataFrame([(str(i), "u", "uploaded", "before") for i in range(1, 9)], "id string, user_id string, status string, last_error string")
    old = spark.createDataFrame([("inv:old|wgt:0|from:|to:|date:|amt:0",), (None,)], "business_fingerprint string")
    for _ in range(2):  # a repeated run changes nothing
        parsed, single = extraction.store_extractions(spark.createDataFrame(rows, kind), old, pages, f"file://{tmp_path}/x")
        assert {(r["id"], r["anchor_key"]) for r in parsed.collect()} == {("1", "A"), ("5", "A")}
        got = {r["id"]: (r["status"], r["last_error"]) for r in single.collect()}
        assert got == {
            "1": ("processed", None), "2": ("skipped_duplicate", "Duplicate of existing document: a"), "3": ("failed", "JSON parsing failed!"), "4": ("processed", None), "5": ("processed", None),
            "6": ("skipped_duplicate", "Duplicate of existing document: old"), "7": ("failed", "JSON parsing failed!"), "8": ("uploaded", "before"),
        }


def test_plans_stay_short(spark):
    from docweave.functions import scalars as S

    df = spark.createDataFrame([], "id string, user_id string, file_url string, created_at timestamp, response_text string")
    plan = extraction.load_extractions(df, spark.createDataFrame([], "business_fingerprint string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000 and plan.count("parse_json") <= 2  # 178,000 with copied expressions
    numbers = spark.createDataFrame([], "a string").select(S.normalize_number(F.concat("a", F.lit("kg"))).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert numbers.count("regexp_extract") == 1
