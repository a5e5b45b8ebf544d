"""Stored tables of the jobs: fixed schemas, reading, writing, and new folders in the shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPLOAD = "id string, user_id string, pdf_path string, upload_date timestamp, status string, last_error string, retry_count int"

#: The schema of each table. A stored table may lack a column (its values are null) or have more (they are not read).
SCHEMAS = {
    "temp_documents": f"{_UPLOAD}, page_count int",
    "single_documents": f"{_UPLOAD}, original_filename string, temp_document_id string, page_number int, total_pages int",
    "parsed_documents": "id string, user_id string, document_type string, anchor_key string, raw_json string, file_url string, created_at timestamp",
    "document_groups": "user_id string, invoice_number string, country string, is_complete boolean, human_verified boolean, verified_at timestamp, last_processed_at timestamp",
    "recycling_docs": "invoice_number string, user_id string, recycler_company string, network_operator_company string, plastic_type string, tonnage_tons double, weight_kg double, "
    "country string, status string, human_verified boolean, city string, origin string, currency string, verified_at timestamp, invoice_url string, eft_url string, ewaybill_url string, updated_at timestamp",
}


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; on a local master a temporary folder is set where that is unset, elsewhere it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "docweave-scratch")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, name: str, users: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name`` stored at ``path`` with its fixed schema, of all users or of the given ones.

    A table that is partitioned by user_id is read only in the folders of those users.
    """
    df = spark.read.schema(SCHEMAS[name]).parquet(path)
    return df.where(F.col("user_id").isin(*users)) if users else df


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Stores ``df`` as Parquet.

    A partitioned table is shuffled by its folders first, a folder over several tasks where it is large (the optimizer's rebalancing
    splits it), so that neither one file a task and folder nor one task a folder comes out.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_json_lines(df: DataFrame, column: str, path: str) -> None:
    """One line of JSON for each struct of ``column``; null fields are written."""
    df.select(f"{column}.*").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """``df`` as CSV with a header in each part, texts quoted where needed and quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
