"""Edge cases of stored tables, ingest, retries, payloads and restarted streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from docweave.operators import grouping, lifecycle, reports
from docweave.sources import tables
from docweave.streaming import jobs

UPLOAD = "id string, user_id string, pdf_path string, upload_date timestamp, status string, last_error string, retry_count int"
PARSED = tables.SCHEMAS["parsed_documents"]


def test_table_of_one_user_reads_its_folders_and_fills_missing_columns(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.write_table(spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", None, "z")], "id string, user_id string, more string"), path, ("user_id",))
    one = tables.read_table(spark, path, "temp_documents", ("a",))
    assert [tuple(r) for r in one.select("id", "user_id", "status").collect()] == [("1", "a", None)]
    assert re.search(r"PartitionFilters: \[[^\]]*user_id", one._jdf.queryExecution().executedPlan().toString())
    assert tables.read_table(spark, path, "temp_documents").count() == 3


@pytest.mark.parametrize("fields, missing", [({}, []), ({"city": " "}, ["city"]), ({"tonnage_value": None, "currency": ""}, ["tonnage_value", "currency"])])
def test_ingest_names_missing_fields(spark, fields, missing):
    row = dict.fromkeys(reports.INGEST_FIELDS, "x") | {"tonnage_value": "1500", "tonnage_unit": "kg", "plastic_type": "pet"} | fields
    df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in row))
    (got,) = reports.ingest_business_rows(df).collect()
    assert got["missing"] == missing and got["plastic_type"] == "PET" and got["status"] == "new"
    assert got["tonnage_tons"] == (None if "tonnage_value" in missing else 1.5)


def test_ingest_without_columns_has_everything_missing(spark):
    (got,) = reports.ingest_business_rows(spark.createDataFrame([("i",)], "invoice_number string")).collect()
    assert got["missing"] == list(reports.INGEST_FIELDS[1:])


def test_retries_reset_children_and_skips_win(spark):
    temp = spark.createDataFrame([("t", "u", "p", None, "processed", None, None), ("f", "u", "p", None, "failed", "e", 1)], UPLOAD)
    pages = [("a", "u", "p", None, "failed", "e", 2), ("b", "u", "p", None, "processed", None, 0), ("c", "u", "p", None, None, "e", None), ("d", "v", "p", None, "failed", "e", 0)]
    single = spark.createDataFrame(pages, UPLOAD).withColumn("temp_document_id", F.lit("t"))
    plan = spark.createDataFrame(
        [("t", "u", "check_children"), ("f", "u", "retry_preprocessing"), ("f", "u", "retry_preprocessing"), ("c", "u", "skip_duplicate"), ("c", "u", "retry_ai_processing"), ("x", "u", "not_found"), ("t", "u", "skip_duplicate")],
        "document_id string, user_id string, action string",
    )
    up, pg = lifecycle.apply_retries(plan, temp, single)
    rows = {r["id"]: (r["status"], r["last_error"], r["retry_count"]) for r in [*up.collect(), *pg.collect()]}
    assert rows == {
        "t": ("processed", None, None), "f": ("uploaded", None, 2), "a": ("uploaded", None, 3), "b": ("processed", None, 0), "c": ("skipped_duplicate", "Manually marked as duplicate", None), "d": ("failed", "e", 0),
    }


def test_payload_lines_hold_every_field(spark, tmp_path):
    kind = tables.SCHEMAS["recycling_docs"]
    row = {"invoice_number": "I/1", "user_id": "u", "recycler_company": "A \"B\"", "plastic_type": "pp", "weight_kg": 18050.0, "status": "new"}
    df = spark.createDataFrame([row, row | {"plastic_type": None}, row | {"status": "failed"}], kind)
    tables.export_json_lines(reports.submission_payloads(df), "payload", f"file://{tmp_path}/out")
    (line,) = [r["value"] for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    body = json.loads(line)
    assert body["no_of_copies"] == 18 and body["plastik_type"] == "PP 5" and body["name"] == 'A "B" - I/1' and body["eft_url"] == "" and len(body) == 17


def test_queue_pages_and_picks_on_empty_tables(spark):
    temp = spark.createDataFrame([], UPLOAD)
    single = spark.createDataFrame([], tables.SCHEMAS["single_documents"])
    queue = lifecycle.unprocessed_documents(single, spark.createDataFrame([], PARSED), temp)
    assert len(queue.columns) == 12 and lifecycle.unprocessed_page(queue).count() == 0
    assert lifecycle.pending_preprocess(temp).count() == 0
    (row,) = lifecycle.batch_summary(single, single, spark.createDataFrame([], "id string, ok boolean, pages int")).collect()
    assert tuple(row) == (0, 0, 0, 0, 0, 0)


def test_streams_resume_and_equal_the_batch(spark, tmp_path):
    docs = [(str(i), "u", kind, f"MAT/24-25/{i % 3}", f'{{"invoice":"MAT/24-25/{i % 3}","document_type":"{kind}"}}', "url", None) for i, kind in enumerate(["invoice", "eft_receipt", "e-way-bill"] * 4)]
    source, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    stream = lambda: spark.readStream.schema(PARSED).option("maxFilesPerTrigger", 1).parquet(source)
    rules = grouping.business_rules(spark)
    spark.createDataFrame([], PARSED).write.parquet(source)
    assert jobs.stream_upsert(stream(), f"{path}-none", rules).count() == 0
    for at in (0, 5, 9):
        spark.createDataFrame(docs[at : at + 4], PARSED).coalesce(1).write.mode("append").parquet(source)
        got = jobs.stream_upsert(stream(), path, rules)
    fed = spark.createDataFrame([d for at in (0, 5, 9) for d in docs[at : at + 4]], PARSED)
    want = grouping.group_documents(fed, rules)
    key = lambda df: sorted((r["invoice_number"], sorted(r["present_document_ids"]), r["is_complete"]) for r in df.collect())
    assert key(got) == key(want)
    assert key(jobs.stream_upsert(stream(), path, rules)) == key(want)
