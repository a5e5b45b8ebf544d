"""Promotion of verified groups into business rows, and the merge of such rows into a table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_domestic_recycler, json_text, json_truthy, to_kg
from .matching import invoice_candidates, latest_per_type, match_invoices

REQUIRED = ("invoice", "eft_receipt", "e-way-bill")


def promotable_groups(groups: DataFrame) -> DataFrame:
    """Groups that a person has verified and that are complete."""
    return groups.where(F.col("human_verified") & F.col("is_complete"))


def apply_verifications(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """``groups`` after ``decisions(user_id, invoice_number, verified, at)``: the latest decision of a group holds, and verified_at is its time, null if refused."""
    last = decisions.groupBy("user_id", "invoice_number").agg(F.max_by(F.struct("verified", "at"), F.struct("at", "verified")).alias("d"))
    out = groups.join(last, ["user_id", "invoice_number"], "left")
    old = F.col("verified_at") if "verified_at" in groups.columns else F.lit(None).cast("timestamp")
    kept = [c for c in groups.columns if c not in ("human_verified", "verified_at")]
    decided = F.col("d").isNotNull()
    return out.select(*kept, F.coalesce("d.verified", "human_verified").alias("human_verified"), F.when(decided, F.when(F.col("d.verified"), F.col("d.at"))).otherwise(old).alias("verified_at"))


def promote_groups(groups: DataFrame, parsed: DataFrame, today: Column | None = None) -> DataFrame:
    """One business row for each distinct (user_id, invoice_number) of ``groups``; ``is_promoted`` is false and ``missing`` says why where documents lack.

    Ids alone pass through the matching and the choice of the newest per type; the JSON joins once, for the chosen documents.
    """
    wanted = groups.select("user_id", "invoice_number").distinct()
    typed = parsed.where(F.col("document_type").isin(*REQUIRED))
    pairs = match_invoices(wanted, invoice_candidates(typed), "invoice_number", "id")
    named = pairs.select("user_id", F.col("left_id").alias("invoice_number"), F.col("right_id").alias("id"))
    chosen = latest_per_type(named.join(typed.select("id", "document_type", "created_at"), "id")).select("user_id", "invoice_number", "document_type", "id")
    bodies = chosen.join(typed.select("id", "raw_json", "file_url"), "id")
    one = lambda t: F.first(F.when(F.col("document_type") == t, F.struct("raw_json", "file_url")), ignorenulls=True)
    sides = bodies.groupBy("user_id", "invoice_number").agg(one(REQUIRED[0]).alias("i"), one(REQUIRED[1]).alias("r"), one(REQUIRED[2]).alias("w"))
    g = wanted.join(sides, ["user_id", "invoice_number"], "left")
    g = g.select("user_id", "invoice_number", "i", "r", "w", *[F.try_parse_json(F.col(c)["raw_json"]).alias(f"{c}d") for c in "irw"])
    i, r, w = F.col("id"), F.col("rd"), F.col("wd")
    text = lambda *options: F.btrim(F.coalesce(*options, F.lit("")))
    or_else = lambda c, other: F.when(c == "", other).otherwise(c)
    country = F.upper(text(json_truthy(w, "ship_to_country_code")))
    company = text(json_truthy(i, "bill_to_company_name"), json_truthy(w, "ship_to_company_name"))
    weight = F.btrim(F.coalesce(json_text(i, "weight"), json_text(w, "weight")))
    kg = to_kg(F.when(weight == "", F.lit(0.0)).otherwise(weight.try_cast("double")), F.coalesce(json_truthy(i, "weight_unit_of_mesurement"), json_truthy(w, "weight_unit_of_mesurement")))
    g = g.withColumns({"country": country, "company": company, "kg": F.coalesce(kg, F.lit(0.0))})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), t) for c, t in zip("irw", REQUIRED, strict=True)]))
    domestic = (F.col("country") == "IN") & is_domestic_recycler(F.col("company"))
    complete = F.col("i").isNotNull() & F.col("w").isNotNull() & (domestic | F.col("r").isNotNull())
    url = lambda c: F.coalesce(F.col(c)["file_url"], F.lit(""))
    return g.select(
        "user_id", "invoice_number", complete.alias("is_promoted"), missing.alias("missing"), domestic.alias("is_domestic"), url("i").alias("invoice_url"), url("r").alias("eft_url"), url("w").alias("ewaybill_url"),
        or_else(or_else(F.col("company"), text(json_truthy(i, "recipient.name"), json_truthy(w, "address_details.to.name"))), F.lit("Unknown")).alias("recycler_company"),
        or_else(text(json_truthy(i, "bill_from_company_name"), json_truthy(i, "recipient.name"), json_truthy(w, "ship_from_company_name")), F.lit("Unknown")).alias("network_operator_company"),
        F.upper(F.coalesce(json_truthy(i, "plastic_type"), json_truthy(w, "plastic_type"), F.lit(""))).alias("plastic_type"), (F.col("kg") / 1000).alias("tonnage_tons"), F.col("kg").alias("weight_kg"),
        F.col("country").alias("origin"), "country", text(json_truthy(i, "city"), json_truthy(w, "city")).alias("city"), or_else(text(json_truthy(r, "transaction_details.currency")), F.lit("INR")).alias("currency"),
        (F.current_date() if today is None else today).alias("upload_date"), F.lit("updated").alias("status"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """The table after insert-or-update by ``keys``, with ``change``: created, updated or kept.

    Columns that ``incoming`` lacks, and those of ``preserve`` in rows that exist, keep their values. Two incoming rows with one key are an
    error when the result is read. Rows with a null key match nothing. Both sides are shuffled by the keys once.
    """
    rest = [c for c in incoming.columns if c not in keys]
    keyed = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    body = F.struct(*rest)
    new = incoming.where(keyed).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(body).alias("first"))
    new = new.select(*keys, F.when(F.col("n") > 1, F.raise_error(F.lit("two incoming rows have one key"))).otherwise(F.col("first")).alias("__new"))
    out = existing.withColumn("__old", F.lit(True)).join(new, keys, "full")
    out = out.unionByName(incoming.where(~keyed).select(*keys, body.alias("__new")), allowMissingColumns=True)
    old, fresh = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    cols = []
    for c in dict.fromkeys([*existing.columns, *rest]):
        if c in keys or c not in rest:
            cols.append(F.col(c))
        elif c not in existing.columns:
            cols.append(F.col("__new")[c].alias(c))
        else:
            cols.append(F.when(fresh & ~(old & F.lit(c in preserve)), F.col("__new")[c]).otherwise(F.col(c)).alias(c))
    return out.select(*cols, F.when(old & fresh, "updated").when(fresh, "created").otherwise("kept").alias("change"))


SUBMISSION = ("collection_id", "collection_address", "metadata_hash", "tx_hash", "submitted_at")


def apply_submission_results(recycling: DataFrame, results: DataFrame, at: Column | None = None) -> DataFrame:
    """``recycling`` after ``results(invoice_number, ok, error)``, which may have ``at`` and the fields of ``SUBMISSION``.

    A submitted row takes the fields and loses its error, a failed one takes the error's text and keeps the fields of an earlier submission; ``updated_at`` is
    the result's time (``at``, else now). Of an invoice's repeated results the last by ``at`` holds, success before failure, so rows are never multiplied.
    """
    kinds = dict(recycling.dtypes)
    given = [c for c in SUBMISSION if c in results.columns]
    time = F.col("at").cast("timestamp") if "at" in results.columns else F.lit(None).cast("timestamp")
    r = results.select("invoice_number", F.struct(time.alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("error").cast("string").alias("error"), *given).alias("__r"))
    last = r.groupBy("invoice_number").agg(F.max("__r").alias("__r"))
    out, known, ok = recycling.join(last, "invoice_number", "left"), F.col("__r").isNotNull(), F.col("__r.ok")
    old = lambda c, kind: F.col(c) if c in kinds else F.lit(None).cast(kind)
    new = {"status": F.when(ok, "submitted").when(known, "failed").otherwise(F.col("status")), "submission_error": F.when(known & ~ok, F.coalesce("__r.error", F.lit("Unknown error"))).when(~known, old("submission_error", "string"))}
    for c in given:
        new[c] = F.when(ok, F.col("__r")[c]).otherwise(old(c, results.schema[c].dataType))
    now = F.coalesce(F.col("__r.at"), F.current_timestamp() if at is None else at)
    new["updated_at"] = F.when(known, now).otherwise(old("updated_at", "timestamp"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in recycling.columns], *[v.alias(c) for c, v in new.items() if c not in recycling.columns])
