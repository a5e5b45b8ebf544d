"""Input views of the queries, derived from the star-schema tables. One SQL text serves Spark and the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("orders", "lineitem")

VIEWS = {
    "temp_documents": r"""
SELECT 'T' || CAST(o_orderkey AS STRING) AS id,
       'U' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) % 20 AS STRING) AS user_id,
       'temp/U' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) % 20 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '_scan.pdf' AS pdf_path,
       CAST(o_orderdate AS TIMESTAMP) AS upload_date,
       CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'processing' ELSE 'processed' END AS status,
       CASE WHEN o_orderkey % 10 = 0 THEN 'split error' END AS last_error,
       CAST(o_orderkey % 4 AS INT) AS retry_count,
       CAST(1 + o_orderkey % 7 AS INT) AS page_count
FROM orders
""",
    "single_documents": r"""
SELECT 'S' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS id,
       'U' || CAST(CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) % 20 AS STRING) AS user_id,
       'single/U' || CAST(CAST(FLOOR(l_orderkey / 3.0) AS BIGINT) % 20 AS STRING) || '/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) || '.pdf' AS pdf_path,
       CAST(l_orderkey AS STRING) || '_scan_page' || CAST(l_linenumber AS STRING) || '.pdf' AS original_filename,
       CAST(l_shipdate AS TIMESTAMP) AS upload_date,
       CASE l_partkey % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'processing' WHEN 3 THEN 'skipped_duplicate' ELSE 'processed' END AS status,
       CASE WHEN l_partkey % 8 = 0 THEN 'model error' WHEN l_partkey % 8 = 3 THEN 'duplicate' END AS last_error,
       CAST(l_partkey % 4 AS INT) AS retry_count,
       'T' || CAST(l_orderkey AS STRING) AS temp_document_id,
       CAST(l_linenumber AS INT) AS page_number,
       7 AS total_pages
FROM lineitem
""",
    "parsed_documents": r"""
WITH b AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS n, l.l_partkey AS p, l.l_suppkey AS s, CAST(l.l_quantity AS INT) AS qty, l.l_shipdate AS ship, o.o_orderdate AS od,
         CAST(FLOOR(l.l_orderkey / 3.0) AS BIGINT) AS j,
         CASE l.l_orderkey % 3 WHEN 0 THEN 'UP/' WHEN 1 THEN 'MH/' ELSE '' END AS reg,
         CASE l.l_linenumber % 3 WHEN 1 THEN 'invoice' WHEN 2 THEN 'eft_receipt' ELSE 'e-way-bill' END AS dt
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_partkey % 8 >= 3 OR (l.l_partkey % 8 = 1 AND l.l_partkey % 3 = 0)
), c AS (
  SELECT b.*, 'MAT/' || reg || '24-25/' || CAST(j AS STRING) AS inv,
         'MAT/' || reg || '24-25/' || CAST(j + 20 AS STRING) AS inv2,
         'Supplier ' || CAST(k % 100 AS STRING) || CASE k % 4 WHEN 0 THEN ' PRIVATE LIMITED' WHEN 1 THEN ' GMBH' WHEN 2 THEN '  Industries, Inc.' ELSE ' SARL' END AS co,
         LPAD(CAST(EXTRACT(DAY FROM od) AS STRING), 2, '0') || '-' || LPAD(CAST(EXTRACT(MONTH FROM od) AS STRING), 2, '0') || '-' || CAST(EXTRACT(YEAR FROM od) AS STRING) AS dmy
  FROM b
)
SELECT 'P' || CAST(k AS STRING) || '-' || CAST(n AS STRING) || '-' || CAST(p AS STRING) || '-' || CAST(s AS STRING) || '-' || CAST(qty AS STRING) AS id,
       'U' || CAST(j % 20 AS STRING) AS user_id,
       dt AS document_type,
       CASE WHEN p % 5 = 0 THEN NULL ELSE inv END AS anchor_key,
       '{"document_type":"' || dt || '","invoice":"' || CASE WHEN p % 7 = 0 THEN REPLACE(inv, '/', '-') ELSE inv END || '"' ||
       CASE dt
         WHEN 'invoice' THEN CASE WHEN p % 9 = 0 THEN ',"document_date":"' ELSE ',"invoice_date":"' END || dmy || '","bill_to_company_name":"' || co || '","bill_from_company_name":"Operator ' || CAST(k % 7 AS STRING) || '","weight":' ||
              CASE WHEN p % 2 = 0 THEN CAST((k % 50) * 100 AS STRING) ELSE '"' || CAST((k % 50) * 100 AS STRING) || '"' END ||
              ',"weight_unit_of_mesurement":"' || CASE k % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'kgs' ELSE 'Tons' END || '","plastic_type":"' || CASE k % 5 WHEN 0 THEN 'PET' WHEN 1 THEN 'pp' WHEN 2 THEN 'LDPE' WHEN 3 THEN 'HDPE' ELSE '' END || '"'
         WHEN 'eft_receipt' THEN ',"bank_name":"Bank ' || CAST(k % 3 AS STRING) || '"' || CASE WHEN p % 3 = 0 THEN ',"second_invoice":"' || inv2 || '"' ELSE '' END
         ELSE ',"eway_bill_no":"' || CAST(k AS STRING) || '","weight":' || CAST((k % 50) * 100 AS STRING) || ',"ship_to_company_name":"' || co || '","city":"City ' || CAST(k % 9 AS STRING) || '"' ||
              CASE k % 4 WHEN 0 THEN ',"ship_to_country_code":"in"' WHEN 1 THEN ',"ship_to_country_code":"BR"' WHEN 2 THEN ',"ship_to_address":"Plot 4, Rangpar, India"' ELSE ',"country":"us"' END
       END || '}' AS raw_json,
       'https://store.example/object/public/documents/single/U' || CAST(j % 20 AS STRING) || '/' || CAST(k AS STRING) || '-' || CAST(n AS STRING) || '-' || CAST(p AS STRING) || '-' || CAST(s AS STRING) || '-' || CAST(qty AS STRING) || '.pdf' AS file_url,
       CAST(ship AS TIMESTAMP) AS created_at
FROM c
""",
    "document_groups_flat": r"""
SELECT 'U' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) % 20 AS STRING) AS user_id,
       'MAT/' || CASE o_orderkey % 3 WHEN 0 THEN 'UP/' WHEN 1 THEN 'MH/' ELSE '' END || '24-25/' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) AS STRING) AS invoice_number,
       CASE o_orderkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'BR' WHEN 2 THEN NULL ELSE 'US' END AS country,
       o_orderkey % 4 <> 3 AS is_complete,
       o_orderkey % 6 = 0 AS human_verified,
       CAST(o_orderdate AS TIMESTAMP) AS last_processed_at
FROM orders
""",
    "recycling_docs": r"""
SELECT 'MAT/' || CASE o_orderkey % 3 WHEN 0 THEN 'UP/' WHEN 1 THEN 'MH/' ELSE '' END || '24-25/' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) AS STRING) AS invoice_number,
       'U' || CAST(CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) % 20 AS STRING) AS user_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Supplier ' || CAST(o_orderkey % 100 AS STRING) END AS recycler_company,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Operator ' || CAST(o_orderkey % 7 AS STRING) END AS network_operator_company,
       CASE o_orderkey % 6 WHEN 0 THEN 'PET' WHEN 1 THEN 'pp' WHEN 2 THEN 'LDPE' WHEN 3 THEN 'HDPE' WHEN 4 THEN '' ELSE NULL END AS plastic_type,
       CAST(o_orderkey % 300 AS DOUBLE) / 8 AS tonnage_tons,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS DOUBLE) * 125 END AS weight_kg,
       CASE o_orderkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'BR' WHEN 2 THEN '' ELSE 'US' END AS country,
       CASE o_orderkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'updated' WHEN 2 THEN 'submitted' ELSE 'failed' END AS status,
       o_orderkey % 6 = 0 AS human_verified,
       CASE WHEN o_orderkey % 8 = 2 THEN 'City ' || CAST(o_orderkey % 9 AS STRING) END AS city,
       CASE WHEN o_orderkey % 16 = 6 THEN 'BR' END AS origin,
       CASE WHEN o_orderkey % 3 = 0 THEN 'INR' END AS currency,
       CASE WHEN o_orderkey % 12 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS verified_at,
       CASE WHEN o_orderkey % 5 = 1 THEN ' ' ELSE 'https://store.example/i/' || CAST(o_orderkey AS STRING) || '.pdf' END AS invoice_url,
       CASE WHEN o_orderkey % 5 = 2 THEN 'https://store.example/r/' || CAST(o_orderkey AS STRING) || '.pdf' END AS eft_url,
       CASE WHEN o_orderkey % 5 = 3 THEN 'https://store.example/e/' || CAST(o_orderkey AS STRING) || '.pdf' END AS ewaybill_url,
       CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM orders
WHERE o_orderkey % 10 <> 7
""",
    "files": r"""
SELECT 'U' || CAST(o_custkey % 20 AS STRING) AS user_id,
       CASE o_orderkey % 6
         WHEN 0 THEN CAST(o_orderkey % 90 AS STRING) || '.INVOICE NO.' || CAST(o_custkey AS STRING) || '.pdf'
         WHEN 1 THEN CAST(o_orderkey % 90 AS STRING) || '.EWAY BILL.' || CAST(o_custkey AS STRING) || '.pdf'
         WHEN 2 THEN CAST(o_orderkey % 90 AS STRING) || '. gj' || LPAD(CAST(o_custkey AS STRING), 10, '0') || '.pdf'
         WHEN 3 THEN 'EFT-' || CAST(o_custkey AS STRING) || '.pdf'
         WHEN 4 THEN 'Payment Receipt (' || CAST(o_custkey AS STRING) || ').pdf'
         ELSE 'Scan copy #' || CAST(o_custkey AS STRING) || ' .pdf' END AS file_name
FROM orders
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the jobs, as a DataFrame over the tables in ``sf_dir``."""
    for table in BASE:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """``sql`` with the views that it names in front, for an engine that has the base tables."""
    used = [n for n in VIEWS if n in sql]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + sql.replace("WITH ", ", ", 1) if sql.lstrip().startswith("WITH ") else "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + "\n" + sql
