"""Golden values, worked out by hand from the rules."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from docweave.functions import scalars as S
from docweave.operators.grouping import apply_business_rule


def values(spark, column, rows, schema="a string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_invoice_numbers(spark):
    rows = ["MAT/UP/24-25/032", "mat-up-24-25-32", "MAT/UP/2425/1032", "MAT/24-25/032", "INV 7", "ABC123", "///", "", None]
    p = S.parse_invoice_number(F.col("a"))
    assert values(spark, p["normalized"], rows) == ["MAT-UP-24-25-032", "MAT-UP-24-25-032", "MAT-UP-24-25-1032", "MAT-24-25-032", "INV-7", "ABC123", "", None, None]
    assert values(spark, S.invoice_group_key(F.col("a")), rows)[:7] == ["MAT-UP-24-25-032", "MAT-UP-24-25-032", "MAT-UP-24-25-1032", "MAT-24-25-032", "INV-7-00-00-007", "ABC123-00-00-ABC123", "INV-00-00-000"]


def test_same_invoice_is_symmetric_and_not_transitive(spark):
    pairs = [("MAT/UP/24-25/032", "MAT/24-25/032"), ("MAT/24-25/032", "MAT/MH/24-25/032"), ("MAT/UP/24-25/032", "MAT/MH/24-25/032"), ("MAT UP 24 25 032", "MAT/UP/24-25/032"), ("", ""), (None, "x")]
    same = S.is_same_invoice(F.col("a"), F.col("b"))
    there = values(spark, same, pairs, "a string, b string")
    assert there == [True, True, False, True, False, False]
    assert values(spark, same, [(b, a) for a, b in pairs], "a string, b string") == there


def test_file_names(spark):
    rows = ["25.INVOICE NO.343.pdf", "37. INVOICE NO. 47.pdf", "60. INVOICE NO. 1675.pdf", "47.EWAY BILL.259.pdf", "31.EWAY BILL.257.pdf", "29. GJ0270009843.pdf", "116. RJ0670000891.pdf", "101. MP0510007928.pdf", "EFT-123.pdf"]
    assert values(spark, S.filename_doc_type(F.col("a")), rows) == ["invoice"] * 3 + ["eway"] * 2 + ["state_doc"] * 3 + ["eft"]
    assert values(spark, S.filename_business_number(F.col("a")), rows) == ["343", "47", "1675", "259", "257", "GJ0270009843", "RJ0670000891", "MP0510007928", "123"]


def test_fingerprints(spark):
    rows = [
        '{"invoice":"MAT/UP/24-25/032","weight":18050,"bill_from_company_name":"Acme  Pvt. Ltd.","bill_to_company_name":"B & C","invoice_date":"2025-09-07"}',
        '{"invoice":"MAT-UP-24-25-032","weight":"18050 kg","bill_from_company_name":"ACME PVT LTD","bill_to_company_name":"b c","invoice_date":"2025-09-07"}',
        "{}", '{"weight":0,"weight_kg":5}', '{"weight":"0","weight_kg":5}', '{"invoice_date":"05-08-2025"}', '{"invoice_date":"15-08-2025"}',
    ]
    got = values(spark, S.business_fingerprint(F.try_parse_json("a")), rows)
    assert got[0] == got[1] == "inv:matup2425032|wgt:18050.00|from:acme pvt ltd|to:b c|date:2025-09-07|amt:0"
    assert got[2] == "inv:|wgt:0|from:|to:|date:|amt:0"
    assert "|wgt:5.00|" in got[3] and "|wgt:0.00|" in got[4] and "|date:2025-05-08|" in got[5] and "|date:|" in got[6]
    df = spark.createDataFrame([(r,) for r in [*rows, "no json", None, '{"document_date":"2025-01-02"}']], "raw_json string")
    plan = S.with_fingerprint(df)
    found = [r["business_fingerprint"] for r in plan.collect()]
    assert found == [*got, got[2], got[2], "inv:|wgt:0|from:|to:|date:2025-01-02|amt:0"]
    assert plan._jdf.queryExecution().executedPlan().toString().count("parseJson") <= 2
    assert values(spark, S.normalize_date(F.col("a"), "dmy"), ["15-08-2025"]) == ["2025-08-15"]


def test_units_labels_and_keywords(spark):
    assert values(spark, S.to_kg(F.col("a"), F.col("b")), [(2.0, " Tons "), (2.0, "KGS"), (2.0, None), (None, "kg")], "a double, b string") == [2000.0, 2.0, 2.0, None]
    assert values(spark, S.plastic_label(F.col("a")), ["PET", "pp", "Hdpe", None]) == ["PET 1", "PP 5", "Hdpe", None]
    assert values(spark, S.is_domestic_recycler(F.col("a")), ["Acme PRIVATE LIMITED", "Acme GmbH", None]) == [True, False, False]


def test_two_decimals_of_the_binary_value(spark):
    rng = random.Random(1)
    numbers = [1.005, 0.125, -0.125, 2.675, -1.005, 0.0, 99.995, 9999999999999.99] + [rng.randrange(10**12) / 1000 for _ in range(500)] + [rng.randrange(10**9) / 8 for _ in range(500)]
    for x, text in values(spark, F.struct("a", S.two_decimals(F.col("a"))), [(x,) for x in numbers], "a double"):
        exact = abs(Decimal(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert text == ("-" if x < 0 else "") + str(exact)
    assert values(spark, S.normalize_number(F.col("a")), [("1.005",), ("7",), (None,), ("",), ("x",)]) == ["1.00", "7.00", "0", "0", "0"]


def test_repeated_rules_never_multiply_groups(spark):
    names = "country string, rule_name string, required_documents array<string>, optional_documents array<string>, minimum_required int"
    groups = spark.createDataFrame([("IN",), ("FR",), (None,)], "country string")
    rules = [("IN", "a", ["invoice"], [], 1), ("IN", "b", ["invoice"], [], 1), (None, "c", [], [], 0), (None, "d", [], [], 0)]
    got = {r["country"]: (r["rule_name"], r["rule_error"]) for r in apply_business_rule(groups, spark.createDataFrame(rules, names)).collect()}
    assert got == {"IN": ("b", False), "FR": ("d", False), None: ("d", False)}
    none = apply_business_rule(groups, spark.createDataFrame(rules[:1], names)).collect()
    assert len(none) == 3 and {r["country"]: r["rule_error"] for r in none} == {"IN": False, "FR": True, None: True}
