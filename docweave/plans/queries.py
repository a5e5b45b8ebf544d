"""One query per operator over the input views, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extraction, grouping, lifecycle, matching, promotion, reports
from ..sources import merged, tables
from ..sources.fixtures import VIEWS, view, with_views
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add


# Rules of the comparison SQL that several queries need.
_PARSE = r"""
, pi0 AS (SELECT DISTINCT invoice_number AS inv, upper(trim(invoice_number)) AS c FROM src WHERE invoice_number IS NOT NULL AND invoice_number <> ''),
pi1 AS (SELECT *, regexp_matches(c, '^[A-Z]+[/-][A-Z]+[/-]\d{2}[/-]?\d{2}[/-]\d+$') AS f, regexp_matches(c, '^[A-Z]+[/-]\d{2}[/-]?\d{2}[/-]\d+$') AS s,
  regexp_replace(regexp_replace(regexp_replace(c, '[^A-Z0-9]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS r FROM pi0),
pi2 AS (SELECT *, string_split(r, '-') AS w,
  regexp_extract(c, '^([A-Z]+)[/-]([A-Z]+)[/-](\d{2})[/-]?(\d{2})[/-](\d+)$', ['a', 'b', 'c', 'd', 'e']) AS fm, regexp_extract(c, '^([A-Z]+)[/-](\d{2})[/-]?(\d{2})[/-](\d+)$', ['a', 'c', 'd', 'e']) AS sm FROM pi1),
pi AS (SELECT inv,
  CASE WHEN f THEN fm.a WHEN s THEN sm.a WHEN w[1] = '' THEN 'INV' ELSE w[1] END AS prefix, CASE WHEN f THEN fm.b WHEN s THEN NULL ELSE w[2] END AS region,
  CASE WHEN f THEN fm.c WHEN s THEN sm.c ELSE '00' END AS year, CASE WHEN f THEN fm.d WHEN s THEN sm.d ELSE '00' END AS period,
  CASE WHEN f THEN repeat('0', greatest(0, 3 - length(fm.e))) || fm.e WHEN s THEN repeat('0', greatest(0, 3 - length(sm.e))) || sm.e ELSE repeat('0', greatest(0, 3 - length(w[-1]))) || w[-1] END AS number,
  CASE WHEN f THEN fm.a || '-' || fm.b || '-' || fm.c || '-' || fm.d || '-' || repeat('0', greatest(0, 3 - length(fm.e))) || fm.e
       WHEN s THEN sm.a || '-' || sm.c || '-' || sm.d || '-' || repeat('0', greatest(0, 3 - length(sm.e))) || sm.e ELSE r END AS normalized FROM pi2)
"""


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "parsed_documents").select("id", "user_id", F.try_variant_get(F.try_parse_json("raw_json"), "$.invoice", "string").alias("invoice_number"))


_SRC = "WITH src AS (SELECT id, user_id, json_extract_string(raw_json, '$.invoice') AS invoice_number FROM parsed_documents)"


@query("parse_invoice_number", _SRC + _PARSE + "SELECT src.id, normalized, prefix, region, year, period, number FROM src JOIN pi ON src.invoice_number = pi.inv")
def parse_invoice_number(spark, sf_dir):
    p = S.parse_invoice_number(F.col("invoice_number"))
    return _invoices(spark, sf_dir).select("id", p.alias("p")).select("id", *[F.col(f"p.{c}").alias(c) for c in ("normalized", "prefix", "region", "year", "period", "number")])


@query("invoice_group_key", _SRC + _PARSE + "SELECT user_id || ':' || concat_ws('-', prefix, nullif(region, ''), year, period, number) AS group_key, count(*) AS documents FROM src JOIN pi ON src.invoice_number = pi.inv GROUP BY 1")
def invoice_group_key(spark, sf_dir):
    return _invoices(spark, sf_dir).groupBy(S.invoice_group_key(F.col("invoice_number"), F.col("user_id")).alias("group_key")).agg(F.count(F.lit(1)).alias("documents"))


@query("match_invoices", r"""
WITH src AS (SELECT DISTINCT user_id, invoice_number FROM document_groups_flat UNION SELECT DISTINCT user_id, invoice_number FROM recycling_docs)
""" + _PARSE + r"""
SELECT g.user_id, g.invoice_number AS left_id, r.invoice_number AS right_id
FROM (SELECT DISTINCT user_id, invoice_number FROM document_groups_flat) g JOIN pi a ON g.invoice_number = a.inv
JOIN pi b ON a.prefix = b.prefix AND a.year = b.year AND a.period = b.period AND a.number = b.number AND (a.region IS NULL OR b.region IS NULL OR a.region = b.region)
JOIN (SELECT DISTINCT user_id, invoice_number FROM recycling_docs) r ON r.invoice_number = b.inv AND r.user_id = g.user_id
""")
def match_invoices(spark, sf_dir):
    a, b = view(spark, sf_dir, "document_groups_flat"), view(spark, sf_dir, "recycling_docs")
    twice = lambda d: d.select("user_id", "invoice_number", F.col("invoice_number").alias("name")).distinct()
    return matching.match_invoices(twice(a), twice(b), "name", "name")


_TRUTHY = "CASE WHEN json_type({d}, '$.{k}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string({d}, '$.{k}') AS DOUBLE) = 0 THEN NULL ELSE nullif(json_extract_string({d}, '$.{k}'), '') END"


def _truthy(*keys: str) -> str:
    return "coalesce(" + ", ".join(_TRUTHY.format(d="raw_json", k=k) for k in keys) + ")"


def _sql_text(*keys: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({_truthy(*keys)}, '')), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _sql_number(*keys: str) -> str:
    v = _truthy(*keys)
    return rf"coalesce(printf('%.2f', TRY_CAST(nullif(regexp_extract({v}, '^\s*([+-]?[0-9]+\.?[0-9]*)', 1), '') AS DOUBLE)), '0')"


_FP = (
    f"'inv:' || {_sql_text('invoice_number', 'invoice', 'anchor_key')} || '|wgt:' || {_sql_number('weight', 'tonnage_tons', 'weight_kg')} || '|from:' || {_sql_text('bill_from_company_name')} || '|to:' || {_sql_text('bill_to_company_name')} || '|date:' || "
    + "coalesce(strftime(TRY_CAST(regexp_replace(" + _truthy("invoice_date", "document_date") + r", '^(\d{2})-(\d{2})-(\d{4})$', '\3-\1-\2') AS DATE), '%Y-%m-%d'), '')"
    + f" || '|amt:' || {_sql_number('total_invoice_amount', 'transaction_amount', 'amount')}"
)


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "parsed_documents")
    return S.with_fingerprint(p)


_FPV = f"WITH fp AS (SELECT id, user_id, document_type, created_at, {_FP} AS business_fingerprint FROM parsed_documents)"


@query("business_fingerprint", _FPV + " SELECT id, business_fingerprint FROM fp")
def business_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("id", "business_fingerprint")


@query("fingerprint_fields", _FPV + r", m AS (SELECT id, regexp_extract(business_fingerprint, '^inv:([^|]*)\|wgt:([^|]*)\|from:([^|]*)\|to:([^|]*)\|date:([^|]*)\|amt:(.*)$', ['a', 'b', 'c', 'd', 'e', 'f']) AS x FROM fp) SELECT id, coalesce(nullif(x.a, ''), 'N/A') AS invoice, coalesce(nullif(x.b, ''), 'N/A') AS weight, coalesce(nullif(x.c, ''), 'N/A') AS bill_from, coalesce(nullif(x.d, ''), 'N/A') AS bill_to, coalesce(nullif(x.e, ''), 'N/A') AS date, coalesce(nullif(x.f, ''), 'N/A') AS amount FROM m")
def fingerprint_fields(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("id", S.fingerprint_fields(F.col("business_fingerprint")).alias("x")).select("id", "x.*")


@query("mark_duplicates", _FPV + """, w AS (SELECT *, first_value(id) OVER o AS f, first_value(user_id) OVER o AS fu, count(*) OVER (PARTITION BY business_fingerprint) AS n FROM fp WINDOW o AS (PARTITION BY business_fingerprint ORDER BY created_at, id))
SELECT id, document_type, business_fingerprint, id <> f AND document_type = 'invoice' AS is_duplicate, CASE WHEN id <> f AND document_type = 'invoice' THEN f END AS first_id,
  CASE WHEN id <> f AND document_type = 'invoice' THEN user_id = fu END AS same_user, least(n, 5) AS hits FROM w""")
def mark_duplicates(spark, sf_dir):
    return matching.mark_duplicates(fingerprinted(spark, sf_dir))


@query("duplicates_against_history", _FPV + """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_fingerprint ORDER BY created_at, id) AS nth FROM fp WHERE created_at < TIMESTAMP '1996-01-01') WHERE nth <= 5)
SELECT b.id, h.id AS hit_id, CAST(h.nth AS INTEGER) AS nth, b.user_id = h.user_id AS same_user FROM fp b JOIN h USING (business_fingerprint) WHERE b.created_at >= TIMESTAMP '1996-01-01' AND b.document_type = 'invoice'""")
def duplicates_against_history(spark, sf_dir):
    f, cut = fingerprinted(spark, sf_dir), F.lit("1996-01-01").cast("timestamp")
    return matching.duplicates_against_history(f.where(F.col("created_at") >= cut), f.where(F.col("created_at") < cut))


@query("unparsed_pages", """SELECT id, status FROM single_documents s WHERE status IN ('uploaded', 'failed') AND NOT EXISTS (SELECT 1 FROM parsed_documents p WHERE p.user_id = s.user_id AND ends_with(p.file_url, s.pdf_path) AND split_part(p.file_url, '/', -1) = split_part(s.pdf_path, '/', -1))""")
def unparsed_pages(spark, sf_dir):
    return matching.unparsed_pages(view(spark, sf_dir, "single_documents"), view(spark, sf_dir, "parsed_documents")).select("id", "status")


_QUEUE = """WITH q AS (
SELECT id, user_id, upload_date, status, 'single_documents' AS source_table, page_number, total_pages FROM single_documents s WHERE status IN ('uploaded', 'failed') AND NOT EXISTS (SELECT 1 FROM parsed_documents p WHERE p.user_id = s.user_id AND split_part(p.file_url, '/', -1) = split_part(s.pdf_path, '/', -1) AND ends_with(p.file_url, s.pdf_path))
UNION ALL SELECT id, user_id, upload_date, status, 'temp_documents', NULL, NULL FROM temp_documents WHERE status IN ('uploaded', 'failed'))"""


def _queue(spark, sf_dir):
    return lifecycle.unprocessed_documents(view(spark, sf_dir, "single_documents"), view(spark, sf_dir, "parsed_documents"), view(spark, sf_dir, "temp_documents"))


@query("unprocessed_documents", _QUEUE + " SELECT id, user_id, status, source_table, page_number, total_pages FROM q")
def unprocessed_documents(spark, sf_dir):
    return _queue(spark, sf_dir).select("id", "user_id", "status", "source_table", "page_number", "total_pages")


@query("page_offset", _QUEUE + """, w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY upload_date DESC, id) AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM q)
SELECT user_id, id, CAST(nth AS INTEGER) AS nth, total, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages, 2 < ceil(total / 50.0) AS has_next, true AS has_prev FROM w WHERE nth BETWEEN 51 AND 100""")
def page_offset(spark, sf_dir):
    q = _queue(spark, sf_dir).drop("total_pages")
    return lifecycle.page_offset(q, [F.desc("upload_date"), F.asc("id")], 2, 50).select("user_id", "id", "nth", "total", "total_pages", "has_next", "has_prev")


@query("lifecycle_groups", """WITH c AS (SELECT temp_document_id AS id, count(*) AS n, count(*) FILTER (status = 'uploaded') AS u, count(*) FILTER (status = 'processed') AS p, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'skipped_duplicate') AS k, count(*) FILTER (status = 'processing') AS g, max(total_pages) AS tp FROM single_documents GROUP BY 1)
SELECT t.id, t.user_id, coalesce(tp, 1) AS total_pages, coalesce(u, 0) AS pages_uploaded, coalesce(p, 0) AS pages_processed, coalesce(f, 0) AS pages_failed, coalesce(k, 0) AS pages_skipped, t.status = 'failed' OR coalesce(f, 0) > 0 OR coalesce(u, 0) > 0 AS can_retry,
CASE WHEN t.status = 'failed' THEN 'preprocessing_failed' WHEN t.status = 'uploaded' THEN 'preprocessing_pending' WHEN t.status = 'processing' THEN 'preprocessing' WHEN n IS NULL THEN 'preprocessing_complete_no_pages' WHEN u > 0 THEN 'ai_processing_pending'
 WHEN g > 0 THEN 'ai_processing' WHEN f > 0 THEN 'ai_processing_failed' WHEN p + k = n THEN 'complete' ELSE 'partial' END AS overall_status FROM temp_documents t LEFT JOIN c ON t.id = c.id""")
def lifecycle_groups(spark, sf_dir):
    return lifecycle.lifecycle_groups(view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents"))


@query("expand_pages", """SELECT id AS temp_document_id, user_id, CASE WHEN page_count = 1 THEN replace(pdf_path, 'temp/', 'single/') ELSE replace(replace(pdf_path, 'temp/', 'single/'), '.pdf', '_page' || n || '.pdf') END AS pdf_path, CAST(n AS INTEGER) AS page_number, page_count AS total_pages FROM (SELECT *, unnest(generate_series(1, page_count)) AS n FROM temp_documents)""")
def expand_pages(spark, sf_dir):
    return lifecycle.expand_pages(view(spark, sf_dir, "temp_documents"))


@query("last_unprocessed_page", """SELECT id, sum(CASE WHEN status <> 'processed' THEN 1 ELSE 0 END) OVER (PARTITION BY temp_document_id, user_id) - CASE WHEN status <> 'processed' THEN 1 ELSE 0 END = 0 AS is_last FROM single_documents""")
def last_unprocessed_page(spark, sf_dir):
    return lifecycle.last_unprocessed_page(view(spark, sf_dir, "single_documents"))


@query("failed_documents", "SELECT id, user_id, last_error, 'preprocessing' AS stage FROM temp_documents WHERE status = 'failed' UNION ALL SELECT id, user_id, last_error, 'ai_processing' FROM single_documents WHERE status = 'failed'")
def failed_documents(spark, sf_dir):
    return lifecycle.failed_documents(view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents")).drop("upload_date")


@query("queue_counts", "SELECT user_id, CAST(sum(u) AS BIGINT) AS uploads_waiting, CAST(sum(p) AS BIGINT) AS pages_ready FROM (SELECT user_id, 1 AS u, 0 AS p FROM temp_documents WHERE status = 'uploaded' UNION ALL SELECT user_id, 0, 1 FROM single_documents WHERE status = 'uploaded') GROUP BY 1")
def queue_counts(spark, sf_dir):
    return lifecycle.queue_counts(view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents"))


@query("check_status_domain", "SELECT id, status FROM single_documents WHERE status NOT IN ('uploaded', 'processing', 'processed', 'failed')")
def check_status_domain(spark, sf_dir):
    return lifecycle.check_status_domain(view(spark, sf_dir, "single_documents"), ("uploaded", "processing", "processed", "failed")).select("id", "status")


@query("reset_stuck", "SELECT id, CASE WHEN status = 'processing' THEN 'uploaded' ELSE status END AS status FROM single_documents")
def reset_stuck(spark, sf_dir):
    return lifecycle.reset_stuck(view(spark, sf_dir, "single_documents")).select("id", "status")


@query("expire_uploads", "SELECT id FROM temp_documents WHERE upload_date >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def expire_uploads(spark, sf_dir):
    return lifecycle.expire_uploads(view(spark, sf_dir, "temp_documents"), "1998-01-01", 365).select("id")


@query("ready_for_extraction", "SELECT id, user_id FROM single_documents WHERE status = 'uploaded'")
def ready_for_extraction(spark, sf_dir):
    return lifecycle.ready_for_extraction(view(spark, sf_dir, "single_documents")).select("id", "user_id")


@query("pending_submission", "SELECT user_id, invoice_number FROM recycling_docs WHERE status IN ('new', 'updated')")
def pending_submission(spark, sf_dir):
    return reports.pending_submission(view(spark, sf_dir, "recycling_docs")).select("user_id", "invoice_number")


@query("promotable_groups", "SELECT user_id, invoice_number FROM document_groups_flat WHERE human_verified AND is_complete")
def promotable_groups(spark, sf_dir):
    return promotion.promotable_groups(view(spark, sf_dir, "document_groups_flat")).select("user_id", "invoice_number")


_PLAN = """WITH r AS (SELECT id AS document_id, user_id, CASE right(id, 1) WHEN '1' THEN 'force_ai' WHEN '2' THEN 'skip_duplicate' END AS forced FROM single_documents UNION ALL SELECT id, user_id, CASE right(id, 1) WHEN '3' THEN 'force_preprocessing' END FROM temp_documents),
plan AS (SELECT document_id, r.user_id, CASE WHEN forced = 'force_preprocessing' THEN 'retry_preprocessing' WHEN forced = 'force_ai' THEN 'retry_ai_processing' WHEN forced = 'skip_duplicate' THEN 'skip_duplicate'
 WHEN s.status IN ('failed', 'uploaded') THEN 'retry_ai_processing' WHEN s.status = 'skipped_duplicate' THEN 'already_skipped' WHEN s.status = 'processed' THEN 'already_processed' WHEN s.id IS NOT NULL THEN 'no_action_needed'
 WHEN t.status IN ('failed', 'uploaded') THEN 'retry_preprocessing' WHEN t.status = 'processed' THEN 'check_children' ELSE 'no_action_needed' END AS action
FROM r LEFT JOIN single_documents s ON s.id = document_id LEFT JOIN temp_documents t ON t.id = document_id)"""


def _retry_plan(spark, sf_dir):
    single, temp = view(spark, sf_dir, "single_documents"), view(spark, sf_dir, "temp_documents")
    last = F.expr("right(id, 1)")
    r = single.select(F.col("id").alias("document_id"), "user_id", F.when(last == "1", "force_ai").when(last == "2", "skip_duplicate").alias("forced")).unionByName(temp.select(F.col("id").alias("document_id"), "user_id", F.when(last == "3", "force_preprocessing").alias("forced")))
    return lifecycle.plan_retries(r, temp, single)


@query("plan_retries", _PLAN + " SELECT * FROM plan")
def plan_retries(spark, sf_dir):
    return _retry_plan(spark, sf_dir)


@query("apply_retries", _PLAN + """, f AS (SELECT document_id AS id, bool_or(action = 'retry_preprocessing') AS split, bool_or(action = 'retry_ai_processing') AS extract, bool_or(action = 'skip_duplicate') AS skip, bool_or(action = 'check_children') AS children FROM plan GROUP BY 1),
x AS (SELECT 'temp_documents' AS source_table, t.id, status, last_error, retry_count, coalesce(split, false) AS again, false AS skip FROM temp_documents t LEFT JOIN f ON f.id = t.id
  UNION ALL SELECT 'single_documents', s.id, status, last_error, retry_count, coalesce(f.extract, false) OR (coalesce(p.children, false) AND status IN ('failed', 'uploaded')), coalesce(f.skip, false) FROM single_documents s LEFT JOIN f ON f.id = s.id LEFT JOIN f p ON p.id = s.temp_document_id)
SELECT source_table, id, CASE WHEN skip THEN 'skipped_duplicate' WHEN again THEN 'uploaded' ELSE status END AS status, CASE WHEN skip THEN 'Manually marked as duplicate' WHEN NOT again THEN last_error END AS last_error,
  retry_count + CASE WHEN again AND NOT skip THEN 1 ELSE 0 END AS retry_count FROM x""")
def apply_retries(spark, sf_dir):
    temp, single = view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents")
    uploads, pages = lifecycle.apply_retries(_retry_plan(spark, sf_dir), temp, single)
    pick = lambda df, name: df.select(F.lit(name).alias("source_table"), "id", "status", "last_error", "retry_count")
    return pick(uploads, "temp_documents").unionByName(pick(pages, "single_documents"))


@query("existing_filename_warnings", """WITH n AS (SELECT user_id, original_filename AS file_name FROM single_documents WHERE status = 'failed' UNION SELECT user_id, pdf_path FROM temp_documents WHERE status = 'failed' UNION SELECT user_id, file_name FROM files)
SELECT user_id, file_name, CASE WHEN (user_id, file_name) IN (SELECT (user_id, pdf_path) FROM temp_documents) THEN 'temp_documents' WHEN (user_id, file_name) IN (SELECT (user_id, original_filename) FROM single_documents) THEN 'single_documents' END AS known_in FROM n""")
def existing_filename_warnings(spark, sf_dir):
    t, s, f = (view(spark, sf_dir, n) for n in ("temp_documents", "single_documents", "files"))
    new = s.where("status = 'failed'").select("user_id", F.col("original_filename").alias("file_name")).union(t.where("status = 'failed'").select("user_id", "pdf_path")).union(f.select("user_id", "file_name")).distinct()
    return matching.existing_filename_warnings(new, t, s)


_FILES = r"""WITH x AS (SELECT user_id, file_name, lower(file_name) AS l, regexp_replace(file_name, '\.[^.]+$', '') AS n FROM files), y AS (SELECT *,
 CASE WHEN contains(l, 'invoice') THEN 'invoice' WHEN contains(l, 'eway') OR contains(l, 'e way') OR contains(l, 'e-way') THEN 'eway' WHEN regexp_matches(l, '^[0-9]+\.?\s*[a-z]{2}\d+') THEN 'state_doc' WHEN contains(l, 'receipt') THEN 'receipt' WHEN contains(l, 'eft') THEN 'eft' ELSE 'other' END AS doc_type,
 coalesce(nullif(regexp_extract(n, '(?i)invoice[^0-9]*(\d+)', 1), ''), nullif(regexp_extract(n, '(?i)e.?way[^0-9]*(\d+)', 1), ''), nullif(upper(regexp_extract(n, '(?i)([A-Z]{2}\d{10,})', 1)), ''), nullif(regexp_extract(n, '(?i)(?:eft|receipt)[^0-9]*(\d+)', 1), ''),
  lower(regexp_replace(regexp_replace(regexp_replace(n, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'))) AS number FROM x)"""


@query("filename_fingerprint", _FILES + " SELECT DISTINCT user_id, file_name, doc_type, number AS business_number, user_id || ':' || doc_type || ':' || number AS fingerprint FROM y")
def filename_fingerprint(spark, sf_dir):
    n, u = F.col("file_name"), F.col("user_id")
    return view(spark, sf_dir, "files").select("user_id", "file_name", S.filename_doc_type(n).alias("doc_type"), S.filename_business_number(n).alias("business_number"), S.filename_fingerprint(n, u).alias("fingerprint")).distinct()


@query("filename_duplicate_report", _FILES + " SELECT user_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_fingerprints, count(*) FILTER (c > 1) AS duplicate_groups, count(*) FILTER (c > 1) > 0 AS has_duplicates FROM (SELECT user_id, doc_type, number, count(*) AS c FROM y GROUP BY ALL) GROUP BY 1")
def filename_duplicate_report(spark, sf_dir):
    f = view(spark, sf_dir, "files").withColumn("fingerprint", S.filename_fingerprint(F.col("file_name"), F.col("user_id")))
    return reports.filename_duplicate_report(f)


@query("listing_labels", """WITH a AS (SELECT id, 'temp_documents' AS source_table, status, last_error, CAST(page_count AS INTEGER) AS tp FROM temp_documents UNION ALL SELECT id, 'single_documents', status, last_error, total_pages FROM single_documents), l AS (SELECT *,
 CASE WHEN source_table = 'temp_documents' THEN CASE WHEN status = 'processed' THEN 'successfully_parsed' ELSE 'failed_preprocessing' END WHEN status IN ('processed', 'skipped_duplicate') THEN 'successfully_parsed' ELSE 'failed_ai_processing' END AS label FROM a)
SELECT id, label, concat_ws(',', CASE WHEN label = 'failed_preprocessing' THEN 'force_preprocessing' END, CASE WHEN source_table = 'temp_documents' AND label = 'successfully_parsed' AND tp > 1 THEN 'auto' END, CASE WHEN label = 'failed_ai_processing' THEN 'force_ai' END,
 CASE WHEN source_table = 'single_documents' AND contains(coalesce(last_error, ''), 'duplicate') THEN 'skip_duplicate' END,
 CASE WHEN label LIKE 'failed%' OR (source_table = 'temp_documents' AND tp <= 1) OR (source_table = 'single_documents' AND NOT contains(coalesce(last_error, ''), 'duplicate')) THEN 'auto' END) AS options FROM l""")
def listing_labels(spark, sf_dir):
    cols = ("id", "status", "last_error")
    t = view(spark, sf_dir, "temp_documents").select(*cols, F.lit("temp_documents").alias("source_table"), F.col("page_count").alias("tp"))
    s = view(spark, sf_dir, "single_documents").select(*cols, F.lit("single_documents").alias("source_table"), F.col("total_pages").alias("tp"))
    both = t.unionByName(s).withColumn("label", S.ui_status(F.col("source_table"), F.col("status")))
    return both.select("id", "label", F.array_join(S.retry_options(F.col("source_table"), F.col("label"), F.col("last_error"), F.col("tp")), ",").alias("options"))


_DOCS = f"""WITH d AS (SELECT user_id, coalesce(nullif(anchor_key, ''), nullif(json_extract_string(raw_json, '$.invoice'), '')) AS invoice_number, document_type, id, created_at,
 CASE WHEN document_type = 'e-way-bill' THEN upper(trim({_truthy('ship_to_country_code')})) END AS c1, upper(trim({_truthy('country')})) AS c2, CASE WHEN contains(lower({_truthy('ship_to_address', 'bill_to_address')}), 'india') THEN 'IN' END AS c3,
 {_truthy('bill_to_company_name', 'ship_to_company_name', 'recycler_company')} AS company, {_truthy('plastic_type')} AS plastic FROM parsed_documents),
g0 AS (SELECT user_id, invoice_number, string_agg(id, ',' ORDER BY created_at DESC, id DESC) AS ids, list(DISTINCT document_type) AS types, count(*) AS n, string_agg(document_type, ',' ORDER BY created_at DESC, id DESC) AS all_types,
 coalesce(first(c1 ORDER BY created_at DESC, id DESC) FILTER (c1 IS NOT NULL), first(c2 ORDER BY created_at DESC, id DESC) FILTER (c2 IS NOT NULL), first(c3 ORDER BY created_at DESC, id DESC) FILTER (c3 IS NOT NULL)) AS country,
 first(company ORDER BY created_at DESC, id DESC) FILTER (company IS NOT NULL) AS recycler_company, first(plastic ORDER BY created_at DESC, id DESC) FILTER (plastic IS NOT NULL) AS plastic_type FROM d WHERE invoice_number IS NOT NULL GROUP BY 1, 2),
g1 AS (SELECT *, CASE WHEN country = 'IN' THEN 'india' ELSE 'global' END AS rule_name, CASE WHEN country = 'IN' THEN ['invoice', 'e-way-bill'] ELSE ['invoice', 'eft_receipt', 'e-way-bill'] END AS req, CASE WHEN country = 'IN' THEN 2 ELSE 3 END AS least_n FROM g0),
grp AS (SELECT *, list_filter(req, lambda x: NOT list_contains(types, x)) AS missing, len(list_filter(req, lambda x: list_contains(types, x))) AS cnt FROM g1)"""


def grouped(spark, sf_dir):
    return grouping.group_documents(view(spark, sf_dir, "parsed_documents"), grouping.business_rules(spark))


@query("group_documents", _DOCS + " SELECT user_id, invoice_number, country, recycler_company, plastic_type, rule_name, ids, all_types AS types, array_to_string(missing, ',') AS missing, CAST(cnt AS INTEGER) AS completion_count, cnt >= least_n AS is_complete, CAST(floor(100.0 * cnt / least_n + 0.5) AS INTEGER) AS completion_percentage FROM grp")
def group_documents(spark, sf_dir):
    return grouped(spark, sf_dir).select(
        "user_id", "invoice_number", "country", "recycler_company", "plastic_type", "rule_name", F.array_join("present_document_ids", ",").alias("ids"), F.array_join("present_document_types", ",").alias("types"),
        F.array_join("missing_document_types", ",").alias("missing"), "completion_count", "is_complete", "completion_percentage",
    )


@query("rules_applied_summary", _DOCS + """, k AS (SELECT DISTINCT user_id, invoice_number, true AS known FROM document_groups_flat)
SELECT rule_name, count(*) AS groups, count(*) FILTER (cnt >= least_n) AS complete, count(*) FILTER (known IS NULL) AS created, count(*) FILTER (known) AS updated, 0 AS errors FROM grp LEFT JOIN k USING (user_id, invoice_number) GROUP BY 1""")
def rules_applied_summary(spark, sf_dir):
    return reports.rules_applied_summary(grouped(spark, sf_dir), view(spark, sf_dir, "document_groups_flat"))


@query("group_stats", _DOCS + """ SELECT p.user_id, coalesce(total, 0) AS total, coalesce(complete, 0) AS complete, coalesce(total - complete, 0) AS incomplete, documents - coalesce(CAST(grouped AS BIGINT), 0) AS ungrouped FROM (SELECT user_id, count(*) AS documents FROM parsed_documents GROUP BY 1) p
LEFT JOIN (SELECT user_id, count(*) AS total, count(*) FILTER (cnt >= least_n) AS complete, sum(n) AS grouped FROM grp GROUP BY 1) g ON p.user_id = g.user_id""")
def group_stats(spark, sf_dir):
    return reports.group_stats(grouped(spark, sf_dir).withColumn("human_verified", F.lit(False)), view(spark, sf_dir, "parsed_documents"))


@query("group_display_status", _DOCS + r""", m AS (SELECT *, regexp_matches(lower(coalesce(recycler_company, '')), 'private limited|pvt ltd|limited|ltd|enterprises|industries|india') AS dom, list_contains(types, 'invoice') AND list_contains(types, 'e-way-bill') AS two FROM grp)
SELECT user_id, invoice_number, CAST(n AS INTEGER) AS count, CASE WHEN dom AND two AND n = 2 THEN 2 ELSE 3 END AS total, CASE WHEN dom THEN two ELSE n >= 3 AND two AND list_contains(types, 'eft_receipt') END AS complete FROM m""")
def group_display_status(spark, sf_dir):
    return grouping.group_display_status(grouped(spark, sf_dir))


@query("latest_per_type", _DOCS + " SELECT user_id, invoice_number, document_type, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, invoice_number, document_type ORDER BY created_at DESC, id DESC) AS r FROM d WHERE invoice_number IS NOT NULL) WHERE r = 1")
def latest_per_type(spark, sf_dir):
    doc = F.try_parse_json("raw_json")
    named = view(spark, sf_dir, "parsed_documents").withColumn("invoice_number", S.first_truthy(F.col("anchor_key"), S.json_text(doc, "invoice"))).where("invoice_number IS NOT NULL")
    return matching.latest_per_type(named)


@query("invoice_candidates", "SELECT DISTINCT id, trim(x) AS invoice_number FROM (SELECT id, unnest([json_extract_string(raw_json, '$.invoice'), json_extract_string(raw_json, '$.second_invoice'), json_extract_string(raw_json, '$.third_invoice'), json_extract_string(raw_json, '$.anchor_key')]) AS x FROM parsed_documents) WHERE trim(x) <> ''")
def invoice_candidates(spark, sf_dir):
    return matching.invoice_candidates(view(spark, sf_dir, "parsed_documents")).select("id", "invoice_number")


@query("group_references", """WITH src AS (SELECT id, user_id, document_type, coalesce(nullif(anchor_key, ''), json_extract_string(raw_json, '$.invoice')) AS invoice_number FROM parsed_documents UNION ALL SELECT id, user_id, document_type, json_extract_string(raw_json, '$.second_invoice') FROM parsed_documents WHERE document_type = 'eft_receipt')""" + _PARSE + """
SELECT user_id, concat_ws('-', prefix, nullif(region, ''), year, period, number) AS group_key, count(DISTINCT id) AS documents, array_to_string(list_sort(list(DISTINCT document_type)), ',') AS types FROM src JOIN pi ON src.invoice_number = pi.inv GROUP BY 1, 2""")
def group_references(spark, sf_dir):
    return grouping.group_references(view(spark, sf_dir, "parsed_documents"))


def _groups_recycling(spark, sf_dir):
    return view(spark, sf_dir, "document_groups_flat"), view(spark, sf_dir, "recycling_docs")


@query("tonnage_summary", """WITH r AS (SELECT r.* FROM recycling_docs r SEMI JOIN (SELECT * FROM document_groups_flat WHERE is_complete) g ON r.user_id = g.user_id AND r.invoice_number = g.invoice_number)
SELECT g.user_id, count(*) AS groups, count(*) FILTER (g.is_complete) AS complete_groups, any_value(t.a) AS total_tons, any_value(t.b) AS verified_tons, any_value(t.c) AS unverified_tons FROM document_groups_flat g
LEFT JOIN (SELECT user_id, sum(tonnage_tons) AS a, coalesce(sum(tonnage_tons) FILTER (human_verified), 0) AS b, coalesce(sum(tonnage_tons) FILTER (NOT human_verified), 0) AS c FROM r GROUP BY 1) t ON g.user_id = t.user_id GROUP BY 1""")
def tonnage_summary(spark, sf_dir):
    return reports.tonnage_summary(*_groups_recycling(spark, sf_dir))


@query("tonnage_by_type", "SELECT coalesce(nullif(plastic_type, ''), 'Unknown') AS plastic_type, sum(tonnage_tons) AS tons FROM recycling_docs r SEMI JOIN (SELECT * FROM document_groups_flat WHERE is_complete) g ON r.user_id = g.user_id AND r.invoice_number = g.invoice_number GROUP BY 1")
def tonnage_by_type(spark, sf_dir):
    return reports.tonnage_by_type(*_groups_recycling(spark, sf_dir))


@query("groups_with_submission", "SELECT g.user_id, g.invoice_number, coalesce(nullif(recycler_company, ''), 'Unknown') AS company, status FROM document_groups_flat g LEFT JOIN recycling_docs r ON g.user_id = r.user_id AND g.invoice_number = r.invoice_number WHERE g.human_verified")
def groups_with_submission(spark, sf_dir):
    g, r = _groups_recycling(spark, sf_dir)
    return reports.groups_with_submission(g, r)


@query("prepare_submissions", """WITH k AS (SELECT *, coalesce(weight_kg, CASE WHEN tonnage_tons <> 0 THEN tonnage_tons * 1000 END) AS kg FROM recycling_docs WHERE status IN ('new', 'updated')), e AS (SELECT *,
 concat_ws(',', CASE WHEN trim(invoice_number) = '' THEN 'invoice_number' END, CASE WHEN coalesce(trim(recycler_company), '') = '' THEN 'recycler_company' END, CASE WHEN coalesce(trim(plastic_type), '') = '' THEN 'plastic_type' END, CASE WHEN coalesce(kg, 0) <= 0 THEN 'weight' END) AS errors FROM k)
SELECT invoice_number, kg, CASE upper(plastic_type) WHEN 'PET' THEN 'PET 1' WHEN 'PP' THEN 'PP 5' WHEN 'PVC' THEN 'PVC 3' WHEN 'LDPE' THEN 'LDPE 4' ELSE plastic_type END AS label, CAST(greatest(1, floor(kg / 1000 + 0.5)) AS BIGINT) AS copies, errors,
 concat_ws(',', CASE WHEN coalesce(trim(invoice_url), '') = '' THEN 'invoice_url' END, CASE WHEN coalesce(trim(country), '') || coalesce(trim(city), '') || coalesce(trim(origin), '') = '' THEN 'location' END, CASE WHEN coalesce(trim(network_operator_company), '') = '' THEN 'operator' END, CASE WHEN kg > 10000 THEN 'heavy' END) AS warnings, errors = '' AS is_valid FROM e""")
def prepare_submissions(spark, sf_dir):
    return reports.prepare_submissions(view(spark, sf_dir, "recycling_docs"))


@query("submission_stats", "SELECT user_id, count(*) FILTER (status = 'submitted') AS success, count(*) FILTER (status = 'failed') AS failure, CASE WHEN count(*) FILTER (status IN ('submitted', 'failed')) > 0 THEN count(*) FILTER (status = 'submitted') / count(*) FILTER (status IN ('submitted', 'failed')) ELSE 0 END AS success_rate FROM recycling_docs GROUP BY 1")
def submission_stats(spark, sf_dir):
    return reports.submission_stats(view(spark, sf_dir, "recycling_docs"))


@query("export_verified", "SELECT invoice_number, coalesce(recycler_company, '') AS recycler_company, coalesce(network_operator_company, '') AS network_operator_company, coalesce(plastic_type, '') AS plastic_type, coalesce(tonnage_tons, 0) AS tonnage_tons, coalesce(weight_kg, 0) AS weight_kg, coalesce(country, '') AS country, coalesce(city, '') AS city, coalesce(currency, '') AS currency, coalesce(strftime(verified_at, '%Y-%m-%d %H:%M:%S'), '') AS verified_at, coalesce(invoice_url, '') AS invoice_url, coalesce(eft_url, '') AS eft_url, coalesce(ewaybill_url, '') AS ewaybill_url FROM recycling_docs WHERE human_verified")
def export_verified(spark, sf_dir):
    return reports.export_verified(view(spark, sf_dir, "recycling_docs"))


@query("apply_verifications", """WITH l AS (SELECT user_id, invoice_number, max(last_processed_at) AS t0 FROM document_groups_flat WHERE country = 'BR' GROUP BY ALL)
SELECT g.user_id, g.invoice_number, coalesce(t0 < TIMESTAMP '1996-01-01', human_verified) AS human_verified, CASE WHEN t0 < TIMESTAMP '1996-01-01' THEN t0 END AS verified_at FROM document_groups_flat g LEFT JOIN l ON l.user_id = g.user_id AND l.invoice_number = g.invoice_number""")
def apply_verifications(spark, sf_dir):
    g = view(spark, sf_dir, "document_groups_flat")
    at = F.col("last_processed_at")
    decisions = g.where("country = 'BR'").select("user_id", "invoice_number", (at < F.lit("1996-01-01").cast("timestamp")).alias("verified"), at.alias("at"))
    return promotion.apply_verifications(g, decisions).select("user_id", "invoice_number", "human_verified", "verified_at")


@query("stage_weights", f"""WITH w AS (SELECT id, TRY_CAST({_truthy('weight')} AS DOUBLE) AS v, coalesce({_truthy('weight_unit_of_mesurement')}, 'kg') AS u FROM parsed_documents)
SELECT id, CASE WHEN lower(trim(u)) IN ('t', 'ton', 'tons', 'tonne', 'tonnes') THEN v * 1000 ELSE v END AS kg, CASE WHEN lower(trim(u)) = 'kg' THEN v / 1000 ELSE v END AS tonnes FROM w""")
def stage_weights(spark, sf_dir):
    doc = F.try_parse_json("raw_json")
    v, u = S.json_truthy(doc, "weight").try_cast("double"), F.coalesce(S.json_truthy(doc, "weight_unit_of_mesurement"), F.lit("kg"))
    return view(spark, sf_dir, "parsed_documents").select("id", S.to_kg(v, u).alias("kg"), S.to_tonnes(v, u).alias("tonnes"))


@query("document_status", """WITH p AS (SELECT temp_document_id AS id, user_id, count(*) AS n, count(*) FILTER (status = 'processed') AS d, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'skipped_duplicate') AS s,
  arg_min(total_pages, (page_number, id)) AS total, string_agg(page_number || '=' || status, ',' ORDER BY page_number, id) AS pages FROM single_documents GROUP BY ALL)
SELECT t.id, CASE WHEN t.status = 'processed' AND n > 0 THEN CASE WHEN d + s = n THEN 'completed' ELSE 'single' END ELSE 'temp' END AS current_stage,
  CASE WHEN t.status = 'processed' AND n > 0 THEN CASE WHEN d + s = n THEN 'completed' WHEN f > 0 THEN 'ai_processing_failed' ELSE 'ai_processing_pending' END WHEN t.status = 'failed' THEN 'preprocessing_failed' ELSE t.status END AS status,
  coalesce(total, 1) AS total_pages, coalesce(d, 0) AS processed_pages, coalesce(f, 0) AS failed_pages, coalesce(s, 0) AS skipped_pages, t.status = 'failed' OR coalesce(f, 0) > 0 AS can_retry, coalesce(d, 0) = 0 AS can_delete, coalesce(pages, '') AS pages
FROM temp_documents t LEFT JOIN p ON p.id = t.id AND p.user_id = t.user_id""")
def document_status(spark, sf_dir):
    s = lifecycle.document_status(view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents"))
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws("=", p["page_number"].cast("string"), p["status"])), ",")
    return s.select("id", "current_stage", "status", "total_pages", "processed_pages", "failed_pages", "skipped_pages", "can_retry", "can_delete", F.coalesce(pages, F.lit("")).alias("pages"))


@query("page_status", """SELECT id, original_filename, CASE WHEN status = 'processed' THEN 'completed' ELSE 'single' END AS current_stage, CASE status WHEN 'processed' THEN 'completed' WHEN 'failed' THEN 'ai_processing_failed' ELSE status END AS status, total_pages,
  status IN ('failed', 'uploaded') AS can_retry, status <> 'processed' AS can_delete, last_error, retry_count FROM single_documents""")
def page_status(spark, sf_dir):
    cols = ("id", "original_filename", "current_stage", "status", "total_pages", "can_retry", "can_delete", "last_error", "retry_count")
    return lifecycle.page_status(view(spark, sf_dir, "single_documents")).select(*cols)


@query("plan_deletions", """WITH o AS (SELECT temp_document_id, user_id, count(*) FILTER (status <> 'processed') AS open FROM single_documents GROUP BY ALL),
u AS (SELECT s.*, o.open - CASE WHEN s.status <> 'processed' THEN 1 ELSE 0 END = 0 AS is_last,
  NOT EXISTS (SELECT 1 FROM parsed_documents p WHERE p.user_id = s.user_id AND split_part(lower(p.file_url), '/', -1) = split_part(lower(s.pdf_path), '/', -1) AND ends_with(lower(p.file_url), lower(s.pdf_path))) AS free FROM single_documents s JOIN o USING (temp_document_id, user_id))
SELECT id AS document_id, t AS source_table, CASE WHEN free THEN 'allowed' ELSE 'processed' END AS verdict, CASE WHEN free AND is_last THEN temp_document_id END AS parent_upload FROM u, (VALUES ('single_documents'), ('unprocessed_documents')) v(t)
UNION ALL SELECT id, t, CASE WHEN status IN ('uploaded', 'failed') THEN 'allowed' ELSE 'processed' END, NULL FROM temp_documents, (VALUES ('temp_documents'), ('unprocessed_documents')) v(t)
UNION ALL SELECT id, 'single_documents', 'not_found', NULL FROM temp_documents
UNION ALL SELECT id, 'parsed_documents', 'protected', NULL FROM parsed_documents""")
def plan_deletions(spark, sf_dir):
    tables = [view(spark, sf_dir, n) for n in ("temp_documents", "single_documents", "parsed_documents")]
    each = [t.select(F.col("id").alias("document_id"), "user_id", F.lit(n).alias("source_table")) for t, n in zip(tables, ("temp_documents", "single_documents", "parsed_documents"), strict=True)]
    queue = each[0].unionByName(each[1]).withColumn("source_table", F.lit("unprocessed_documents"))
    wrong = each[0].withColumn("source_table", F.lit("single_documents"))
    tables[2] = tables[2].withColumn("file_url", F.when(F.length("id") % 3 == 0, F.upper("file_url")).otherwise(F.col("file_url")))
    return lifecycle.plan_deletions(each[0].unionByName(each[1]).unionByName(each[2]).unionByName(queue).unionByName(wrong), *tables).drop("user_id")


def _t(d: str, *keys: str) -> str:
    """The first truthy field of the JSON column ``d``, empty without one."""
    return "coalesce(" + ", ".join(_TRUTHY.format(d=d, k=k) for k in keys) + ", '')"


_PROMOTED = (
    """WITH cand AS (SELECT id, user_id, document_type, created_at, raw_json, file_url, trim(unnest([json_extract_string(raw_json, '$.' || k) FOR k IN ['anchor_key', 'invoice', 'second_invoice', 'third_invoice']])) AS invoice_number FROM parsed_documents),
wanted AS (SELECT DISTINCT user_id, invoice_number FROM document_groups_flat WHERE human_verified AND is_complete),
src AS (SELECT invoice_number FROM cand UNION SELECT invoice_number FROM wanted)"""
    + _PARSE
    + f""", hit AS (SELECT g.user_id, g.invoice_number, c.document_type, arg_max(c.raw_json, (c.created_at, c.id)) AS raw_json, arg_max(c.file_url, (c.created_at, c.id)) AS file_url
  FROM wanted g JOIN pi a ON g.invoice_number = a.inv JOIN pi b ON a.prefix = b.prefix AND a.year = b.year AND a.period = b.period AND a.number = b.number AND (a.region IS NULL OR b.region IS NULL OR a.region = b.region)
  JOIN cand c ON c.invoice_number = b.inv AND c.user_id = g.user_id GROUP BY ALL),
s AS (SELECT w.user_id, w.invoice_number, i.raw_json AS i, r.raw_json AS r, e.raw_json AS e, i.file_url AS iu, r.file_url AS ru, e.file_url AS eu FROM wanted w
  LEFT JOIN hit i ON (i.user_id, i.invoice_number, i.document_type) = (w.user_id, w.invoice_number, 'invoice') LEFT JOIN hit r ON (r.user_id, r.invoice_number, r.document_type) = (w.user_id, w.invoice_number, 'eft_receipt')
  LEFT JOIN hit e ON (e.user_id, e.invoice_number, e.document_type) = (w.user_id, w.invoice_number, 'e-way-bill')),
v AS (SELECT *, upper(trim({_t('e', 'ship_to_country_code')})) AS country, trim(coalesce(nullif({_t('i', 'bill_to_company_name')}, ''), {_t('e', 'ship_to_company_name')})) AS company,
  coalesce(TRY_CAST(coalesce(json_extract_string(i, '$.weight'), json_extract_string(e, '$.weight')) AS DOUBLE), 0) AS weight, coalesce(nullif({_t('i', 'weight_unit_of_mesurement')}, ''), nullif({_t('e', 'weight_unit_of_mesurement')}, ''), 'kg') AS unit FROM s),
p AS (SELECT *, country = 'IN' AND len([w FOR w IN {list(S.DOMESTIC)} IF contains(lower(company), w)]) > 0 AS is_domestic, CASE WHEN lower(trim(unit)) IN ('t', 'ton', 'tons', 'tonne', 'tonnes') THEN weight * 1000 ELSE weight END AS kg FROM v),
promoted AS (SELECT user_id, invoice_number, i IS NOT NULL AND e IS NOT NULL AND (is_domestic OR r IS NOT NULL) AS is_promoted, concat_ws(',', CASE WHEN i IS NULL THEN 'invoice' END, CASE WHEN r IS NULL THEN 'eft_receipt' END, CASE WHEN e IS NULL THEN 'e-way-bill' END) AS missing,
  is_domestic, coalesce(iu, '') AS invoice_url, coalesce(ru, '') AS eft_url, coalesce(eu, '') AS ewaybill_url, coalesce(nullif(company, ''), 'Unknown') AS recycler_company,
  coalesce(nullif(trim({_t('i', 'bill_from_company_name')}), ''), 'Unknown') AS network_operator_company, upper(coalesce(nullif({_t('i', 'plastic_type')}, ''), {_t('e', 'plastic_type')})) AS plastic_type, kg / 1000 AS tonnage_tons, kg AS weight_kg, country,
  trim(coalesce(nullif({_t('i', 'city')}, ''), {_t('e', 'city')})) AS city, 'INR' AS currency, 'updated' AS status FROM p)"""
)


def _promoted(spark, sf_dir):
    groups = promotion.promotable_groups(view(spark, sf_dir, "document_groups_flat"))
    return promotion.promote_groups(groups, view(spark, sf_dir, "parsed_documents"))


@query("promote_groups", _PROMOTED + " SELECT * FROM promoted")
def promote_groups(spark, sf_dir):
    return _promoted(spark, sf_dir).withColumn("missing", F.array_join("missing", ",")).drop("origin", "upload_date")


@query("upsert_promoted", _PROMOTED + """ SELECT coalesce(d.invoice_number, n.invoice_number) AS invoice_number, coalesce(d.user_id, n.user_id) AS user_id, coalesce(n.recycler_company, d.recycler_company) AS recycler_company,
  coalesce(n.weight_kg, d.weight_kg) AS weight_kg, coalesce(n.status, d.status) AS status, d.human_verified, coalesce(n.city, d.city) AS city, CASE WHEN d.invoice_number IS NULL THEN 'created' WHEN n.invoice_number IS NULL THEN 'kept' ELSE 'updated' END AS change
FROM recycling_docs d FULL JOIN (SELECT * FROM promoted WHERE is_promoted) n ON n.invoice_number = d.invoice_number""")
def upsert_promoted(spark, sf_dir):
    rows = _promoted(spark, sf_dir).where("is_promoted").select("invoice_number", "user_id", "recycler_company", "weight_kg", "status", "city")
    out = promotion.upsert(view(spark, sf_dir, "recycling_docs"), rows, ["invoice_number"], ("user_id",))
    return out.select("invoice_number", "user_id", "recycler_company", "weight_kg", "status", "human_verified", "city", "change")


_LOADED = r"""WITH resp AS (SELECT id, user_id, file_url, created_at, length(id) % 4 AS kind, raw_json, document_type AS dt FROM parsed_documents WHERE created_at >= TIMESTAMP '1996-01-01'),
good AS (SELECT * FROM resp WHERE kind <> 3), hist AS (SELECT DISTINCT """ + _FP + " AS fp FROM parsed_documents WHERE created_at < TIMESTAMP '1996-01-01'), f AS (SELECT *, dt AS document_type, " + _FP + """ AS fp FROM (SELECT id, user_id, file_url, created_at, raw_json, dt, json_extract_string(raw_json, '$.anchor_key') AS anchor_key FROM good)),
m AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY created_at, id) > 1 AND dt = 'invoice' AS again FROM f),
loaded AS (SELECT id, user_id, file_url, created_at, raw_json, dt AS document_type, 'dedup' AS route, json_extract_string(raw_json, '$.invoice') AS anchor_key, fp AS business_fingerprint, CASE WHEN again OR (dt = 'invoice' AND fp IN (SELECT fp FROM hist)) THEN 'skipped_duplicate' ELSE 'processed' END AS page_status FROM m
UNION ALL SELECT id, user_id, file_url, created_at, NULL, NULL, 'failed', NULL, NULL, 'failed' FROM resp WHERE kind = 3)"""


def _responses(spark, sf_dir):
    """Answers made of stored documents, fenced, plain or cut short, and the fingerprints of the older ones."""
    p, cut = view(spark, sf_dir, "parsed_documents"), F.lit("1996-01-01").cast("timestamp")
    kind, raw = F.length("id") % 4, F.col("raw_json")
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("```\n"), raw, F.lit("\n```\n"))).when(kind == 2, raw).otherwise(F.substring(raw, 1, 20))
    history = p.where(F.col("created_at") < cut).select("raw_json").transform(S.with_fingerprint).select("business_fingerprint")
    return p.where(F.col("created_at") >= cut).select("id", "user_id", "file_url", "created_at", text.alias("response_text")), history


@query("load_extractions", _LOADED + " SELECT id, document_type, route, anchor_key, business_fingerprint, page_status FROM loaded")
def load_extractions(spark, sf_dir):
    out = extraction.load_extractions(*_responses(spark, sf_dir))
    failed = F.col("route") == "failed"
    return out.select("id", "document_type", "route", "anchor_key", F.when(~failed, F.col("business_fingerprint")).alias("business_fingerprint"), "page_status")


@query("store_extractions", _LOADED + """ SELECT 'parsed_documents' AS stored_in, 'S' || substr(id, 2) AS id, user_id, 'processed' AS status, NULL AS last_error, document_type, anchor_key, business_fingerprint, file_url, created_at, json_extract_string(raw_json, '$.invoice') AS invoice FROM loaded WHERE page_status = 'processed'
UNION ALL SELECT 'single_documents', s.id, s.user_id, coalesce(l.page_status, s.status), CASE l.page_status WHEN 'failed' THEN 'JSON parsing failed!' WHEN 'processed' THEN NULL WHEN 'skipped_duplicate' THEN 'Duplicate of existing document: ' || l.anchor_key ELSE s.last_error END,
  NULL, NULL, NULL, NULL, NULL, NULL FROM single_documents s LEFT JOIN loaded l ON 'S' || substr(l.id, 2) = s.id""")
def store_extractions(spark, sf_dir):
    responses, history = _responses(spark, sf_dir)
    pages = responses.withColumn("id", F.concat(F.lit("S"), F.expr("substr(id, 2)")))
    parsed, single = extraction.store_extractions(pages, history, view(spark, sf_dir, "single_documents"), tables.new_folder(spark, "extractions"))
    parsed = parsed.select("*", F.try_variant_get(F.parse_json("raw_json"), "$.invoice", "string").alias("invoice")).drop("raw_json")
    rows = parsed.withColumns({"stored_in": F.lit("parsed_documents"), "status": F.lit("processed")})
    both = rows.unionByName(single.select("id", "user_id", "status", "last_error", F.lit("single_documents").alias("stored_in")), allowMissingColumns=True)
    return both.select("stored_in", "id", "user_id", "status", "last_error", "document_type", "anchor_key", "business_fingerprint", "file_url", "created_at", "invoice")


@query("dashboard_stats", f"""WITH k AS (SELECT id, user_id, created_at, coalesce(nullif(anchor_key, ''), json_extract_string(raw_json, '$.invoice')) AS invoice_number, coalesce(TRY_CAST({_truthy('weight', 'tonnage_tons', 'weight_kg')} AS DOUBLE), 0) AS kg FROM parsed_documents),
g AS (SELECT f.* FROM document_groups_flat f WHERE (user_id, invoice_number) IN (SELECT (user_id, invoice_number) FROM k) AND last_processed_at >= TIMESTAMP '1995-01-01' AND last_processed_at < TIMESTAMP '1997-01-01'),
x AS (SELECT user_id, sum(kg) AS kg FROM k WHERE (user_id, invoice_number) IN (SELECT (user_id, invoice_number) FROM g WHERE is_complete) GROUP BY 1),
d AS (SELECT user_id, count(*) AS n FROM k WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01' GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM g GROUP BY 1)
SELECT user_id, floor(coalesce(x.kg, 0) / 10 + 0.5) / 100 AS total_tons, coalesce(d.n, 0) AS processed_count, coalesce(c.n, 0) AS groups_count FROM x FULL JOIN d USING (user_id) FULL JOIN c USING (user_id)""")
def dashboard_stats(spark, sf_dir):
    parsed = view(spark, sf_dir, "parsed_documents")
    made = grouping.group_documents(parsed, grouping.business_rules(spark)).select("user_id", "invoice_number", "present_document_ids")
    flat = view(spark, sf_dir, "document_groups_flat").select("user_id", "invoice_number", "is_complete", "last_processed_at", F.col("last_processed_at").alias("created_at"))
    return reports.dashboard_stats(made.join(flat, ["user_id", "invoice_number"]), parsed, "1995-01-01", "1996-12-31")


def _streamed(spark, sf_dir, name):
    """A view over lineitem as a stream, the other tables as they are."""
    view(spark, sf_dir, name)
    path = f"{sf_dir}/lineitem.parquet"
    # A table may be one file, which a stream takes only as a pattern.
    spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]").createOrReplaceTempView("lineitem")
    return spark.sql(VIEWS[name])


@query("stream_throughput", """WITH w AS (SELECT time_bucket(INTERVAL 7 DAYS, upload_date, TIMESTAMP '1970-01-01') AS window_start, status FROM single_documents)
SELECT window_start, status, count(*) AS documents FROM w WHERE window_start + INTERVAL 7 DAYS <= (SELECT max(upload_date) FROM single_documents) GROUP BY ALL""")
def stream_throughput(spark, sf_dir):
    return jobs.run_available(jobs.stream_throughput(_streamed(spark, sf_dir, "single_documents"), "upload_date", "7 days"), "throughput")


@query("stream_deduplicate", _FPV + """, w AS (SELECT id, document_type, business_fingerprint, row_number() OVER (PARTITION BY business_fingerprint ORDER BY created_at, id) AS nth FROM fp)
SELECT id, document_type, business_fingerprint FROM w WHERE nth = 1 OR document_type <> 'invoice'""")
def stream_deduplicate(spark, sf_dir):
    p = S.with_fingerprint(_streamed(spark, sf_dir, "parsed_documents"))
    return jobs.stream_deduplicate(p).select("id", "document_type", "business_fingerprint")


_FEED = """WITH doc AS (SELECT id, user_id, document_type, CASE WHEN right(id, 1) NOT IN ('1', '2') THEN anchor_key END AS anchor, CASE WHEN right(id, 1) IN ('1', '2') THEN replace(replace(raw_json, 'MAT/', 'MOV/'), 'MAT-', 'MOV-') ELSE raw_json END AS j FROM parsed_documents WHERE right(id, 1) <> '0'),
src AS (SELECT id, user_id, document_type, coalesce(anchor, json_extract_string(j, '$.invoice')) AS invoice_number FROM doc UNION SELECT id, user_id, document_type, json_extract_string(j, '$.second_invoice') FROM doc WHERE document_type = 'eft_receipt')"""


def _feed(spark, sf_dir):
    """A change feed as a stream: every document is inserted; some are moved, some deleted, some deleted and inserted again."""
    p = _streamed(spark, sf_dir, "parsed_documents")
    last = F.expr("right(id, 1)")
    event = lambda n, op, when: F.when(when, F.struct(F.lit(n).cast("long").alias("event_id"), F.lit(op).alias("op")))
    ops = F.array_compact(F.array(event(1, "INSERT", F.lit(True)), event(2, "UPDATE", last.isin("1", "2", "3")), event(3, "DELETE", last.isin("0", "3")), event(4, "INSERT", last == "3")))
    moved = F.col("op") == "UPDATE"
    body = F.when(moved, F.replace(F.replace("raw_json", F.lit("MAT/"), F.lit("MOV/")), F.lit("MAT-"), F.lit("MOV-"))).otherwise(F.col("raw_json"))
    each = p.withColumn("e", F.explode(ops)).select("*", "e.*").withColumn("raw_json", body).withColumn("anchor_key", F.when(~moved, F.col("anchor_key")))
    return each.withColumnRenamed("created_at", "ts").drop("e")


@query("stream_group_changes", _FEED + _PARSE + """, k AS (SELECT DISTINCT id, user_id, document_type, concat_ws('-', prefix, year, period, number) AS group_key, coalesce(region, '') AS region FROM src JOIN pi ON src.invoice_number = pi.inv),
c AS (SELECT *, CASE WHEN region = '' THEN min(nullif(region, '')) OVER (PARTITION BY user_id, group_key) ELSE region END AS class FROM k)
SELECT user_id, group_key, class AS region, count(*) AS documents, count(*) FILTER (document_type = 'invoice') AS invoice, count(*) FILTER (document_type = 'eft_receipt') AS eft_receipt, count(*) FILTER (document_type = 'e-way-bill') AS e_way_bill, count(DISTINCT document_type) = 3 AS complete FROM c GROUP BY ALL""")
def stream_group_changes(spark, sf_dir):
    return jobs.stream_group_changes(_feed(spark, sf_dir), tables.new_folder(spark, "group-changes")).drop("closed")


@query("group_references_known", """WITH own AS (SELECT id, user_id, document_type, coalesce(nullif(anchor_key, ''), json_extract_string(raw_json, '$.invoice')) AS invoice_number FROM parsed_documents),
more AS (SELECT id, user_id, document_type, json_extract_string(raw_json, '$.second_invoice') AS invoice_number FROM parsed_documents WHERE document_type = 'eft_receipt'), src AS (FROM own UNION ALL FROM more)""" + _PARSE + """
, k AS (SELECT inv, concat_ws('-', prefix, nullif(region, ''), year, period, number) AS group_key FROM pi), o AS (SELECT own.*, group_key FROM own JOIN k ON own.invoice_number = inv), m AS (SELECT more.*, group_key FROM more JOIN k ON more.invoice_number = inv)
SELECT user_id, group_key, count(DISTINCT id) AS documents, array_to_string(list_sort(list(DISTINCT document_type)), ',') AS types
FROM (FROM o UNION ALL (FROM m WHERE EXISTS (SELECT 1 FROM o WHERE o.document_type = 'invoice' AND o.user_id = m.user_id AND o.group_key = m.group_key))) GROUP BY 1, 2""")
def group_references_known(spark, sf_dir):
    return grouping.group_references(view(spark, sf_dir, "parsed_documents"), known_only=True)


@query("groups_with_documents", """SELECT user_id, coalesce(nullif(anchor_key, ''), json_extract_string(raw_json, '$.invoice')) AS invoice_number, document_type, string_agg(id, ',' ORDER BY id) AS ids, string_agg(split_part(file_url, '/', -1), ',' ORDER BY id) AS files FROM parsed_documents GROUP BY ALL""")
def groups_with_documents(spark, sf_dir):
    parsed = view(spark, sf_dir, "parsed_documents")
    found = grouping.groups_with_documents(grouping.group_documents(parsed, grouping.business_rules(spark)), parsed)
    files = F.array_join(F.transform("documents", lambda d: F.substring_index(d["file_url"], "/", -1)), ",")
    return found.select("user_id", "invoice_number", "document_type", F.array_join("ids", ",").alias("ids"), files.alias("files"))


@query("apply_submission_results", """SELECT invoice_number, user_id, CASE WHEN status NOT IN ('new', 'updated') THEN status WHEN tonnage_tons > 5 THEN 'submitted' ELSE 'failed' END AS status,
  CASE WHEN status IN ('new', 'updated') AND NOT tonnage_tons > 5 THEN 'too light' END AS submission_error, CASE WHEN status IN ('new', 'updated') AND tonnage_tons > 5 THEN 'C-' || invoice_number END AS collection_id,
  CASE WHEN status IN ('new', 'updated') THEN TIMESTAMP '2025-01-02' ELSE updated_at END AS updated_at FROM recycling_docs""")
def apply_submission_results(spark, sf_dir):
    rows = view(spark, sf_dir, "recycling_docs")
    light, day = F.col("tonnage_tons") <= 5, lambda n: F.lit(f"2025-01-0{n}").cast("timestamp")
    last = rows.where(F.col("status").isin("new", "updated")).select("invoice_number", (~light).alias("ok"), F.when(light, "too light").alias("error"), F.concat(F.lit("C-"), "invoice_number").alias("collection_id"), day(2).alias("at"))
    first = last.withColumns({"ok": F.lit(False), "error": F.lit("timed out"), "at": day(1)})
    return promotion.apply_submission_results(rows, first.unionByName(last)).select("invoice_number", "user_id", "status", "submission_error", "collection_id", "updated_at")


@query("match_classes", r"""WITH src AS (SELECT DISTINCT user_id, invoice_number FROM document_groups_flat UNION SELECT DISTINCT user_id, invoice_number FROM recycling_docs)""" + _PARSE + r"""
, n AS (SELECT inv, normalized, coalesce(region, '') AS region, prefix || year || period || number AS rest FROM pi), l AS (SELECT user_id, normalized, region, rest, count(*) AS rows FROM document_groups_flat JOIN n ON inv = invoice_number GROUP BY ALL), r AS (SELECT user_id, normalized, region, rest, count(*) AS rows FROM recycling_docs JOIN n ON inv = invoice_number GROUP BY ALL)
SELECT l.user_id, l.normalized AS left_number, r.normalized AS right_number, l.rows AS left_rows, r.rows AS right_rows FROM l JOIN r ON l.user_id = r.user_id AND (l.normalized = r.normalized OR l.rest = r.rest AND (l.region = r.region OR l.region = '' OR r.region = ''))""")
def match_classes(spark, sf_dir):
    left, right, links = matching.match_classes(view(spark, sf_dir, "document_groups_flat"), view(spark, sf_dir, "recycling_docs"), "invoice_number", "invoice_number")
    number = lambda side: F.element_at(F.split(f"{side}_class", r"\|"), 1).alias(f"{side}_number")
    sizes = [d.groupBy("user_id", F.col("class").alias(f"{n}_class")).agg(F.count(F.lit(1)).alias(f"{n}_rows")) for d, n in ((left, "left"), (right, "right"))]
    return links.join(sizes[0], ["user_id", "left_class"]).join(sizes[1], ["user_id", "right_class"]).select("user_id", number("left"), number("right"), "left_rows", "right_rows")


@query("group_summary", _DOCS + """, t AS (SELECT user_id, invoice_number, string_agg(id, ',' ORDER BY nth) AS newest_ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id, invoice_number ORDER BY created_at DESC, id DESC) AS nth FROM d WHERE invoice_number IS NOT NULL) WHERE nth <= 2 GROUP BY ALL)
SELECT user_id, invoice_number, country, recycler_company, n AS documents, array_to_string(list_sort(types), ',') AS types, newest_ids, cnt >= least_n AS is_complete FROM grp JOIN t USING (user_id, invoice_number)""")
def group_summary(spark, sf_dir):
    g = grouping.group_summary(view(spark, sf_dir, "parsed_documents"), grouping.business_rules(spark), newest=2)
    return g.select("user_id", "invoice_number", "country", "recycler_company", "documents", F.array_join("present_document_types", ",").alias("types"), F.array_join("newest_ids", ",").alias("newest_ids"), "is_complete")


@query("group_chunks", _DOCS + """, r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, invoice_number ORDER BY created_at DESC, id DESC) - 1) // 2 AS chunk FROM d WHERE invoice_number IS NOT NULL)
SELECT user_id, invoice_number, chunk, string_agg(id, ',' ORDER BY created_at DESC, id DESC) AS ids, string_agg(document_type, ',' ORDER BY created_at DESC, id DESC) AS types FROM r GROUP BY ALL""")
def group_chunks(spark, sf_dir):
    c = grouping.group_chunks(view(spark, sf_dir, "parsed_documents"), size=2)
    return c.select("user_id", "invoice_number", "chunk", F.array_join("ids", ",").alias("ids"), F.array_join("types", ",").alias("types"))


@query("merge_into", """SELECT t.id, t.user_id, CASE WHEN t.status = 'failed' THEN 'uploaded' ELSE t.status END AS status, CASE WHEN t.status = 'failed' THEN NULL ELSE t.last_error END AS last_error, t.retry_count FROM temp_documents t""")
def merge_into(spark, sf_dir):
    rows = view(spark, sf_dir, "temp_documents").select("id", "user_id", "status", "last_error", "retry_count")
    path = tables.new_folder(spark, "merged")
    merged.merge_into(rows.where("status <> 'uploaded'"), path, rows.schema, ["id"])
    fixed = rows.where("status IN ('failed', 'uploaded')").select("id", "user_id", F.lit("uploaded").alias("status"), F.when(F.col("status") != "failed", F.col("last_error")).alias("last_error"), "retry_count")
    merged.merge_into(fixed, path, rows.schema, ["id"], ("retry_count",))
    return merged.read_merged(spark, path, rows.schema)


@query("read_table", "SELECT id, user_id, status, retry_count, page_count FROM temp_documents")
def read_table(spark, sf_dir):
    path = tables.new_folder(spark, "temp_documents")
    tables.write_table(view(spark, sf_dir, "temp_documents"), path, ("user_id",))
    return tables.read_table(spark, path, "temp_documents").select("id", "user_id", "status", "retry_count", "page_count")


@query("unprocessed_page", _QUEUE + " SELECT id, user_id, status, source_table FROM q ORDER BY upload_date DESC, id LIMIT 50 OFFSET 100")
def unprocessed_page(spark, sf_dir):
    return lifecycle.unprocessed_page(_queue(spark, sf_dir), 50, 100).select("id", "user_id", "status", "source_table")


@query("unprocessed_unchecked", """SELECT id, user_id, original_filename, temp_document_id, 'single_documents' AS source_table, page_number, 1 AS total_pages FROM single_documents WHERE status IN ('uploaded', 'failed')
UNION ALL SELECT id, user_id, pdf_path, NULL, 'temp_documents', NULL, 1 FROM temp_documents WHERE status IN ('uploaded', 'failed')""")
def unprocessed_unchecked(spark, sf_dir):
    queue = lifecycle.unprocessed_documents(*[view(spark, sf_dir, n) for n in ("single_documents", "parsed_documents", "temp_documents")], check_parsed=False)
    return queue.select("id", "user_id", "original_filename", "temp_document_id", "source_table", "page_number", "total_pages")


@query("pending_preprocess", "SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY upload_date, id) AS nth FROM temp_documents) WHERE nth <= 12")
def pending_preprocess(spark, sf_dir):
    return lifecycle.pending_preprocess(view(spark, sf_dir, "temp_documents")).select("id", "user_id")


@query("new_pages_only", """WITH e AS (SELECT status, user_id, CASE WHEN page_count = 1 THEN replace(pdf_path, 'temp/', 'single/') ELSE replace(replace(pdf_path, 'temp/', 'single/'), '.pdf', '_page' || n || '.pdf') END AS pdf_path, CAST(n AS INTEGER) AS page_number
  FROM (SELECT *, unnest(generate_series(1, page_count)) AS n FROM temp_documents)) SELECT user_id, pdf_path, page_number FROM e WHERE status <> 'processed'""")
def new_pages_only(spark, sf_dir):
    temp = view(spark, sf_dir, "temp_documents")
    known = lifecycle.expand_pages(temp.where("status = 'processed'"))
    return lifecycle.new_pages_only(lifecycle.expand_pages(temp), known).select("user_id", "pdf_path", "page_number")


@query("recent_groups", "SELECT user_id, invoice_number, last_processed_at, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_processed_at DESC, invoice_number) AS nth FROM (SELECT DISTINCT * FROM document_groups_flat)) WHERE nth <= 100 AND last_processed_at IS NOT NULL")
def recent_groups(spark, sf_dir):
    return lifecycle.recent(view(spark, sf_dir, "document_groups_flat").distinct(), "last_processed_at", "invoice_number").select("user_id", "invoice_number", "last_processed_at", "nth")


@query("recent_parsed", "SELECT user_id, id, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS nth FROM parsed_documents) WHERE nth <= 100")
def recent_parsed(spark, sf_dir):
    return lifecycle.recent(view(spark, sf_dir, "parsed_documents"), "created_at", "id").select("user_id", "id", "nth")


@query("sorted_groups", "SELECT user_id, invoice_number, is_complete FROM document_groups_flat ORDER BY is_complete DESC, invoice_number, user_id")
def sorted_groups(spark, sf_dir):
    return reports.sorted_groups(view(spark, sf_dir, "document_groups_flat")).select("user_id", "invoice_number", "is_complete")


@query("batch_summary", """WITH o AS (SELECT count(*) AS uploads, CAST(sum(CASE WHEN status = 'processed' THEN page_count ELSE 0 END) AS BIGINT) AS processed, count(*) FILTER (status <> 'processed') AS errors FROM temp_documents),
s AS (SELECT count(*) FILTER (status = 'processed') AS pages_before, count(*) AS pages_after FROM single_documents) SELECT *, pages_after - pages_before AS net_increase FROM o, s""")
def batch_summary(spark, sf_dir):
    temp, single = view(spark, sf_dir, "temp_documents"), view(spark, sf_dir, "single_documents")
    outcomes = temp.select("id", (F.col("status") == "processed").alias("ok"), F.col("page_count").alias("pages"))
    return lifecycle.batch_summary(single.where("status = 'processed'"), single, outcomes)


@query("tonnage_rollup", "SELECT user_id, plastic_type, sum(tonnage_tons) AS tons FROM (SELECT r.user_id, coalesce(nullif(plastic_type, ''), 'Unknown') AS plastic_type, tonnage_tons FROM recycling_docs r SEMI JOIN (SELECT * FROM document_groups_flat WHERE is_complete) g ON r.user_id = g.user_id AND r.invoice_number = g.invoice_number) GROUP BY ROLLUP (user_id, plastic_type)")
def tonnage_rollup(spark, sf_dir):
    return reports.tonnage_rollup(*_groups_recycling(spark, sf_dir))


@query("submission_payloads", """WITH k AS (SELECT *, coalesce(weight_kg, CASE WHEN tonnage_tons <> 0 THEN tonnage_tons * 1000 END) AS kg FROM recycling_docs WHERE status IN ('new', 'updated'))
SELECT invoice_number, recycler_company || ' - ' || invoice_number AS name, 'Recycling collection for invoice ' || invoice_number || ' from ' || recycler_company AS description,
 CASE upper(plastic_type) WHEN 'PET' THEN 'PET 1' WHEN 'PP' THEN 'PP 5' WHEN 'PVC' THEN 'PVC 3' WHEN 'LDPE' THEN 'LDPE 4' ELSE plastic_type END AS plastik_type, 1000000000 AS instant_sale_price, CAST(greatest(1, floor(kg / 1000 + 0.5)) AS BIGINT) AS no_of_copies, kg AS weight, true AS use_autogen_image, recycler_company,
 coalesce(invoice_url, '') AS invoice_url, coalesce(eft_url, '') AS eft_url, coalesce(ewaybill_url, '') AS ewaybill_url, coalesce(origin, '') AS origin, coalesce(currency, '') AS currency, coalesce(country, '') AS country, coalesce(city, '') AS city, coalesce(network_operator_company, '') AS network_operator_company
FROM k WHERE trim(invoice_number) <> '' AND trim(recycler_company) <> '' AND trim(plastic_type) <> '' AND kg > 0""")
def submission_payloads(spark, sf_dir):
    return reports.submission_payloads(view(spark, sf_dir, "recycling_docs")).select("payload.*")


_INGEST = ("invoice_number", "invoice_url", "eft_url", "ewaybill_url", "recycler_company", "network_operator_company", "plastic_type", "tonnage_value", "country", "city", "currency")


@query("ingest_business_rows", """WITH r AS (SELECT *, coalesce(weight_kg, tonnage_tons) AS tonnage_value, CASE WHEN weight_kg IS NULL THEN 't' ELSE 'kg' END AS tonnage_unit FROM recycling_docs)
SELECT trim(invoice_number) AS invoice_number, trim(invoice_url) AS invoice_url, trim(recycler_company) AS recycler_company, upper(coalesce(plastic_type, '')) AS plastic_type, CASE WHEN tonnage_unit = 'kg' THEN tonnage_value / 1000 ELSE tonnage_value END AS tonnage_tons,
 CASE WHEN tonnage_unit = 'kg' THEN tonnage_value / 1000 ELSE tonnage_value END * 1000 AS weight_kg, trim(coalesce(nullif(country, ''), origin, '')) AS origin, coalesce(currency, '') AS currency, 'new' AS status,
 concat_ws(',', """ + ", ".join(f"CASE WHEN coalesce(trim(CAST({c} AS VARCHAR)), '') = '' THEN '{c}' END" for c in _INGEST) + ") AS missing FROM r")
def ingest_business_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "recycling_docs")
    unit = F.when(F.col("weight_kg").isNull(), "t").otherwise("kg")
    out = reports.ingest_business_rows(rows.withColumn("tonnage_unit", unit).withColumn("tonnage_value", F.coalesce("weight_kg", "tonnage_tons")))
    return out.select("invoice_number", "invoice_url", "recycler_company", "plastic_type", "tonnage_tons", "weight_kg", "origin", "currency", "status", F.array_join("missing", ",").alias("missing"))


@query("export_processed", "SELECT user_id || '/' || invoice_number AS id, invoice_number, recycler_company, network_operator_company, plastic_type, tonnage_tons, country, status, human_verified, verified_at, updated_at - INTERVAL 1 DAY AS created_at, updated_at FROM recycling_docs")
def export_processed(spark, sf_dir):
    rows = view(spark, sf_dir, "recycling_docs")
    return reports.export_processed(rows.withColumn("id", F.concat_ws("/", "user_id", "invoice_number")).withColumn("created_at", F.col("updated_at") - F.expr("INTERVAL 1 DAY")))


@query("document_views", f"""WITH d AS (SELECT user_id, coalesce(nullif(anchor_key, ''), nullif(json_extract_string(raw_json, '$.invoice'), '')) AS invoice_number, document_type, raw_json, created_at, id FROM parsed_documents WHERE document_type IN ('invoice', 'e-way-bill')),
s AS (SELECT user_id, invoice_number, arg_max(raw_json, (created_at, id)) FILTER (document_type = 'invoice') AS i, arg_max(raw_json, (created_at, id)) FILTER (document_type = 'e-way-bill') AS e FROM d WHERE invoice_number IS NOT NULL GROUP BY 1, 2)
SELECT user_id, invoice_number, coalesce(nullif({_t('i', 'invoice_number', 'invoice')}, ''), 'N/A') AS invoice, coalesce(nullif({_t('i', 'bill_to_company_name')}, ''), nullif({_t('e', 'ship_to_company_name')}, ''), 'N/A') AS company, coalesce(nullif({_t('i', 'bill_from_company_name')}, ''), 'N/A') AS operator,
 coalesce(nullif({_t('i', 'plastic_type')}, ''), 'N/A') AS plastic, coalesce(nullif({_t('i', 'weight')}, '') || ' kg', 'N/A') AS weight, coalesce(nullif({_t('e', 'city')}, ''), 'N/A') AS city, coalesce(nullif({_t('e', 'ship_to_country_code', 'country')}, ''), 'N/A') AS country FROM s""")
def document_views(spark, sf_dir):
    return reports.document_views(view(spark, sf_dir, "parsed_documents"))


@query("safe_storage_path", r"""SELECT DISTINCT user_id, file_name, 'temp/' || user_id || '/1700000000000_7_' || left(sha256(user_id || '|' || file_name || '|1700000000000|7'), 6) || '_' || regexp_replace(file_name, '[^a-zA-Z0-9.-]', '_', 'g') AS pdf_path FROM files""")
def safe_storage_path(spark, sf_dir):
    path = S.safe_storage_path(F.col("user_id"), F.col("file_name"), F.lit(1700000000000), F.lit(7))
    return view(spark, sf_dir, "files").select("user_id", "file_name", path.alias("pdf_path")).distinct()


@query("stream_upsert", _DOCS + " SELECT user_id, invoice_number, ids, CAST(cnt AS INTEGER) AS completion_count, cnt >= least_n AS is_complete FROM grp")
def stream_upsert(spark, sf_dir):
    path = tables.new_folder(spark, "stream-upsert")
    groups = jobs.stream_upsert(_streamed(spark, sf_dir, "parsed_documents"), path, grouping.business_rules(spark))
    return groups.select("user_id", "invoice_number", F.array_join("present_document_ids", ",").alias("ids"), "completion_count", "is_complete")
