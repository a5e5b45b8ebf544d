"""Tonnage, dashboards and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import document_view, first_truthy, json_truthy, plastic_label
from .matching import latest_per_type

# The price of a copy, and the fields that an incoming business row must have.
PRICE = 1000000000
INGEST_FIELDS = ("invoice_number", "invoice_url", "eft_url", "ewaybill_url", "recycler_company", "network_operator_company", "plastic_type", "tonnage_value", "country", "city", "currency")


def _complete_rows(groups: DataFrame, recycling: DataFrame) -> DataFrame:
    return recycling.join(groups.where("is_complete").select("user_id", "invoice_number"), ["user_id", "invoice_number"], "left_semi")


def tonnage_summary(groups: DataFrame, recycling: DataFrame) -> DataFrame:
    """Tonnes of complete groups per user: total, verified, unverified; and how many groups."""
    t = F.coalesce(F.col("tonnage_tons").cast("double"), F.lit(0.0))
    ok = F.coalesce("human_verified", F.lit(False))
    sums = _complete_rows(groups, recycling).groupBy("user_id").agg(F.sum(t).alias("total_tons"), F.sum(F.when(ok, t).otherwise(0.0)).alias("verified_tons"), F.sum(F.when(~ok, t).otherwise(0.0)).alias("unverified_tons"))
    counts = groups.groupBy("user_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if("is_complete").alias("complete_groups"))
    return counts.join(sums, "user_id", "left").fillna(0.0, ["total_tons", "verified_tons", "unverified_tons"])


def tonnage_by_type(groups: DataFrame, recycling: DataFrame) -> DataFrame:
    """Tonnes of complete groups by plastic type; null and '' are Unknown."""
    kind = first_truthy(F.col("plastic_type"), F.lit("Unknown"))
    return _complete_rows(groups, recycling).groupBy(kind.alias("plastic_type")).agg(F.sum(F.coalesce(F.col("tonnage_tons").cast("double"), F.lit(0.0))).alias("tons"))


def tonnage_rollup(groups: DataFrame, recycling: DataFrame) -> DataFrame:
    """The same by user and type, with the totals of each user (plastic_type null) and of all (both null)."""
    rows = _complete_rows(groups, recycling).withColumn("plastic_type", first_truthy(F.col("plastic_type"), F.lit("Unknown")))
    return rows.rollup("user_id", "plastic_type").agg(F.sum(F.coalesce(F.col("tonnage_tons").cast("double"), F.lit(0.0))).alias("tons"))


def sorted_groups(groups: DataFrame) -> DataFrame:
    """Complete groups first, then by invoice number in byte order."""
    return groups.orderBy(F.desc_nulls_last("is_complete"), F.asc_nulls_last("invoice_number"), "user_id")


def group_stats(groups: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per user: groups by state, and documents in none."""
    done = F.col("is_complete") | F.coalesce("human_verified", F.lit(False))
    g = groups.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("complete"), F.count_if(~done).alias("incomplete"))
    ids = groups.select("user_id", F.explode("present_document_ids").alias("id")).distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("grouped"))
    p = parsed.groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"))
    return p.join(g, "user_id", "left").join(ids, "user_id", "left").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "complete", "incomplete")], (F.col("documents") - F.coalesce("grouped", F.lit(0))).alias("ungrouped"))


def rules_applied_summary(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Groups by rule: complete ones, those new to or known in ``existing(user_id, invoice_number)``, and those that no rule fits (rule none)."""
    known = existing.select("user_id", "invoice_number").distinct().withColumn("known", F.lit(True))
    rows = groups.join(known, ["user_id", "invoice_number"], "left")
    rule, old, bad = F.coalesce("rule_name", F.lit("none")), F.coalesce("known", F.lit(False)), F.col("rule_error")
    return rows.groupBy(rule.alias("rule_name")).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if("is_complete").alias("complete"), F.count_if(~bad & ~old).alias("created"), F.count_if(~bad & old).alias("updated"), F.count_if(bad).alias("errors"),
    )


def filename_duplicate_report(files: DataFrame) -> DataFrame:
    """Per user: files, fingerprints, fingerprints of several files."""
    f = files.groupBy("user_id", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return f.groupBy("user_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_fingerprints"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), (F.count_if(F.col("n") > 1) > 0).alias("has_duplicates"))


def weight_kg(row_weight: Column, tons: Column) -> Column:
    """The row's kilograms, else its tonnes times 1000; null where tonnes are null or 0."""
    return F.coalesce(row_weight, F.when(tons != 0, tons * 1000))


def validate_submission(df: DataFrame) -> DataFrame:
    """``df`` with ``errors``, ``warnings`` and ``is_valid``."""
    empty = lambda c: F.coalesce(F.btrim(F.col(c)), F.lit("")) == ""
    kg = weight_kg(F.col("weight_kg"), F.col("tonnage_tons").cast("double"))
    errors = F.array_compact(F.array(F.when(empty("invoice_number"), "invoice_number"), F.when(empty("recycler_company"), "recycler_company"), F.when(empty("plastic_type"), "plastic_type"), F.when(F.coalesce(kg, F.lit(0.0)) <= 0, "weight")))
    warnings = F.array_compact(F.array(F.when(empty("invoice_url"), "invoice_url"), F.when(empty("city") & empty("country") & empty("origin"), "location"), F.when(empty("network_operator_company"), "operator"), F.when(kg > 10000, "heavy")))
    return df.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


def pending_submission(recycling: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that wait for submission, all or the first ``limit`` by invoice number."""
    rows = recycling.where(F.col("status").isin("new", "updated"))
    return rows if limit is None else rows.orderBy("invoice_number", "user_id").limit(limit)


def copies_of(kg: Column) -> Column:
    """One copy a tonne, rounded half up, at least one."""
    return F.greatest(F.lit(1), F.floor(kg / 1000 + 0.5)).cast("long")


def submission_payloads(recycling: DataFrame) -> DataFrame:
    """user_id, invoice_number and the body (a struct) of every valid row that waits for submission; missing texts are ''."""
    rows = validate_submission(pending_submission(recycling)).where("is_valid")
    kg = weight_kg(F.col("weight_kg"), F.col("tonnage_tons").cast("double"))
    text = lambda c: F.coalesce(c, F.lit(""))
    company, number = F.col("recycler_company"), F.col("invoice_number")
    body = F.struct(
        F.concat(company, F.lit(" - "), number).alias("name"), F.concat(F.lit("Recycling collection for invoice "), number, F.lit(" from "), company).alias("description"), plastic_label(F.col("plastic_type")).alias("plastik_type"),
        F.lit(PRICE).alias("instant_sale_price"), copies_of(kg).alias("no_of_copies"), kg.alias("weight"), F.lit(True).alias("use_autogen_image"), "recycler_company", "invoice_number",
        *[text(c).alias(c) for c in ("invoice_url", "eft_url", "ewaybill_url", "origin", "currency", "country", "city", "network_operator_company")],
    )
    return rows.select("user_id", "invoice_number", body.alias("payload"))


def groups_with_submission(groups: DataFrame, recycling: DataFrame) -> DataFrame:
    """Verified groups, newest first, with the company and status of their business row; a group without one has company Unknown."""
    rows = recycling.select("user_id", "invoice_number", "recycler_company", "status")
    out = groups.where("human_verified").select("user_id", "invoice_number", "last_processed_at").join(rows, ["user_id", "invoice_number"], "left")
    return out.orderBy(F.desc_nulls_last("last_processed_at"), "invoice_number").select("user_id", "invoice_number", first_truthy(F.col("recycler_company"), F.lit("Unknown")).alias("company"), "status")


def ingest_business_rows(rows: DataFrame) -> DataFrame:
    """Business rows of incoming ``rows``, each with the list of required fields that are missing (empty where the row is good).

    Texts are trimmed, kg become tonnes, plastic types upper case (unknown ones stay), status is new. A field that is null, blank or not a column is
    missing; a tonnage that is no number is present and null. The caller decides whether one bad row rejects a batch.
    """
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.btrim(have(c)), F.lit("")) == "", F.lit(c)) for c in INGEST_FIELDS]))
    value = have("tonnage_value").try_cast("double")
    tons = F.when(have("tonnage_unit") == "kg", value / 1000).otherwise(value)
    country = F.btrim(F.coalesce(first_truthy(have("country"), have("origin")), F.lit("")))
    texts = [F.btrim(have(c)).alias(c) for c in INGEST_FIELDS[:6]]
    return rows.select(
        *texts, F.upper(F.coalesce(have("plastic_type"), F.lit(""))).alias("plastic_type"), tons.alias("tonnage_tons"), (tons * 1000).alias("weight_kg"), country.alias("origin"), country.alias("country"),
        F.btrim(F.coalesce(have("city"), F.lit(""))).alias("city"), F.coalesce(have("currency"), F.lit("")).alias("currency"), have("upload_date").alias("upload_date"), have("uploaded_by").alias("uploaded_by"),
        F.lit("new").alias("status"), missing.alias("missing"),
    )


def export_processed(recycling: DataFrame) -> DataFrame:
    """The 12 columns of the plain export, last updated first."""
    names = ("id", "invoice_number", "recycler_company", "network_operator_company", "plastic_type", "tonnage_tons", "country", "status", "human_verified", "verified_at", "created_at", "updated_at")
    return recycling.orderBy(F.desc_nulls_last("updated_at"), "id").select(*names)


def document_views(parsed: DataFrame) -> DataFrame:
    """What a reviewer sees of each (user, invoice): fields of the newest invoice and transport bill, N/A where neither has one.

    Ids alone are grouped; the JSON of the chosen documents joins afterwards.
    """
    typed = parsed.where(F.col("document_type").isin("invoice", "e-way-bill"))
    number = first_truthy(F.col("anchor_key"), json_truthy(F.try_parse_json("raw_json"), "invoice"))
    named = typed.select("id", "user_id", "document_type", "created_at", number.alias("invoice_number")).where(F.col("invoice_number").isNotNull())
    bodies = latest_per_type(named).select("user_id", "invoice_number", "document_type", "id").join(typed.select("id", "raw_json"), "id")
    one = lambda t: F.try_parse_json(F.first(F.when(F.col("document_type") == t, F.col("raw_json")), ignorenulls=True))
    sides = bodies.groupBy("user_id", "invoice_number").agg(one("invoice").alias("i"), one("e-way-bill").alias("e"))
    return sides.select("user_id", "invoice_number", document_view(F.col("i"), F.col("e")).alias("v")).select("user_id", "invoice_number", "v.*")


def prepare_submissions(recycling: DataFrame) -> DataFrame:
    """Rows to submit with weight, label, copies and validity."""
    kg = weight_kg(F.col("weight_kg"), F.col("tonnage_tons").cast("double"))
    v = validate_submission(pending_submission(recycling))
    return v.select("invoice_number", kg.alias("kg"), plastic_label(F.col("plastic_type")).alias("label"), copies_of(kg).alias("copies"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "is_valid")


def export_verified(recycling: DataFrame) -> DataFrame:
    """Verified rows in the export's 13 columns, newest verified first, '' and 0 for what is missing."""
    numbers = [F.col(c).cast("double").alias(c) for c in ("tonnage_tons", "weight_kg")]
    verified = F.date_format("verified_at", "yyyy-MM-dd HH:mm:ss").alias("verified_at")
    rows = recycling.where("human_verified").orderBy(F.col("verified_at").desc_nulls_last(), "invoice_number")
    texts = ("invoice_number", "recycler_company", "network_operator_company", "plastic_type")
    urls = ("invoice_url", "eft_url", "ewaybill_url")
    return rows.select(*texts, *numbers, "country", "city", "currency", verified, *urls).fillna("").fillna(0.0)


def submission_stats(results: DataFrame) -> DataFrame:
    """Per user: submitted and failed rows, and the share of submitted ones (0 without either)."""
    ok = F.count_if(F.col("status") == "submitted")
    tried = F.count_if(F.col("status").isin("submitted", "failed"))
    return results.groupBy("user_id").agg(ok.alias("success"), (tried - ok).alias("failure"), F.when(tried > 0, ok / tried).otherwise(0.0).alias("success_rate"))


def dashboard_stats(groups: DataFrame, parsed: DataFrame, first: str, last: str) -> DataFrame:
    """Per user: tonnes of the documents of complete groups in the range (each document once), documents and groups of the range.

    Weights are taken as kilograms whatever the field; a weight that is no number counts as 0.
    """
    within = lambda c: (F.col(c) >= F.lit(first).cast("timestamp")) & (F.col(c) < F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    ids = groups.where(F.col("is_complete") & within("last_processed_at")).select("user_id", F.explode("present_document_ids").alias("id")).distinct()
    weight = F.coalesce(json_truthy(F.try_parse_json("raw_json"), "weight", "tonnage_tons", "weight_kg").try_cast("double"), F.lit(0.0))
    tons = parsed.select("user_id", "id", weight.alias("kg")).join(ids, ["user_id", "id"], "left_semi").select("user_id", "kg", F.lit(0).alias("d"), F.lit(0).alias("g"))
    docs = parsed.where(within("created_at")).select("user_id", F.lit(0.0).alias("kg"), F.lit(1).alias("d"), F.lit(0).alias("g"))
    made = groups.where(within("created_at")).select("user_id", F.lit(0.0).alias("kg"), F.lit(0).alias("d"), F.lit(1).alias("g"))
    sums = tons.unionByName(docs).unionByName(made).groupBy("user_id").agg(F.sum("kg").alias("kg"), F.sum("d").alias("processed_count"), F.sum("g").alias("groups_count"))
    return sums.select("user_id", (F.floor(F.col("kg") / 10 + 0.5) / 100).alias("total_tons"), "processed_count", "groups_count")
