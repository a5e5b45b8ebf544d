"""Every query against its SQL, and the joins against brute force."""

import decimal
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docweave.functions import scalars as S
from docweave.operators import matching
from docweave.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_match_join_equals_all_pairs(spark):
    names = ["MAT/UP/24-25/032", "MAT/MH/24-25/032", "MAT/24-25/32", "INV 7", "inv-7", "///", "", None, "MAT/UP/24-25/33"]
    df = spark.createDataFrame([("u", n, str(i)) for i, n in enumerate(names)], "user_id string, invoice_number string, id string")
    joined = {(r["left_id"], r["right_id"]) for r in matching.match_invoices(df, df, "id", "id").collect()}
    a, b = df.toDF("u", "a", "i"), df.toDF("u2", "b", "j")
    pairs = {(r["i"], r["j"]) for r in a.crossJoin(b).where(S.is_same_invoice(F.col("a"), F.col("b"))).collect()}
    assert joined == pairs


def test_one_document_of_each_fingerprint_is_first(spark):
    marked = plans.QUERIES["mark_duplicates"](spark, DATA)
    assert marked.where("is_duplicate AND document_type <> 'invoice'").count() == 0
    assert marked.where("is_duplicate AND first_id IS NULL").count() == 0
