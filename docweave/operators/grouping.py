"""Invoice groups: documents of one user and invoice, the country's rule and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DOMESTIC_SHOWN, first_truthy, invoice_group_key, is_domestic_recycler, json_text, json_truthy, once
from .ranking import rank_by_ranges

#: Rules when none are given: country (null: every other), name, required, optional, least number.
DEFAULT_RULES = [("IN", "india", ["invoice", "e-way-bill"], ["eft_receipt"], 2), (None, "global", ["invoice", "eft_receipt", "e-way-bill"], [], 3)]


def business_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "country string, rule_name string, required_documents array<string>, optional_documents array<string>, minimum_required int")


def apply_business_rule(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of a group's country, else the global one; ``rule_error`` where neither exists.

    Of a country's repeated rules the greatest row holds, so groups never multiply. The plan broadcasts the rules only where they are
    small; of the global rule there is one row at most.
    """
    fields = ("rule_name", "required_documents", "optional_documents", "minimum_required")
    own = rules.where(F.col("country").isNotNull()).groupBy("country").agg(F.max(F.struct(*fields)).alias("own"))
    rest = rules.where(F.col("country").isNull()).agg(F.max(F.struct(*fields)).alias("rest"))
    out = groups.join(own, "country", "left").join(F.broadcast(rest), F.lit(True), "left")
    rule = F.coalesce("own", "rest")
    return out.select(*groups.columns, *[rule[f].alias(f) for f in fields], rule.isNull().alias("rule_error"))


def grouping_fields(parsed: DataFrame) -> DataFrame:
    """(user_id, invoice_number, document_type, id, at, c1, c2, c3, company, plastic): all that grouping takes from a document; each is parsed once."""
    doc = F.col("doc")
    p = once(parsed, "doc", F.try_parse_json("raw_json"))
    address = F.coalesce(json_truthy(doc, "ship_to_address"), json_truthy(doc, "bill_to_address"))
    ship = F.when(F.col("document_type") == "e-way-bill", json_truthy(doc, "ship_to_country_code"))
    return p.select(
        "user_id", first_truthy(F.col("anchor_key"), json_text(doc, "invoice")).alias("invoice_number"), "document_type", "id", F.struct("created_at", "id").alias("at"), F.upper(F.btrim(ship)).alias("c1"),
        F.upper(F.btrim(json_truthy(doc, "country"))).alias("c2"), F.when(F.lower(address).contains("india"), "IN").alias("c3"), json_truthy(doc, "bill_to_company_name", "ship_to_company_name", "recycler_company").alias("company"),
        json_truthy(doc, "plastic_type").alias("plastic"),
    )


def _grouping_fields(parsed: DataFrame) -> DataFrame:
    """``grouping_fields`` of documents that name an invoice."""
    return grouping_fields(parsed).where(F.col("invoice_number").isNotNull())


def _newest_fields() -> list[Column]:
    """Aggregates of a group's country, company and plastic, each from the newest document that has one."""
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))
    return [F.coalesce(newest("c1"), newest("c2"), newest("c3")).alias("country"), newest("company").alias("recycler_company"), newest("plastic").alias("plastic_type")]


def group_documents(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups by (user, invoice number): one shuffle, newest document first in every list. Where a placeholder number holds very many documents, ``group_summary`` and ``group_chunks`` bound every row."""
    return group_fields(_grouping_fields(parsed), rules)


def group_fields(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """``group_documents`` of the fields of documents that name an invoice."""
    lists = F.sort_array(F.collect_list(F.struct("at", "document_type", "id")), asc=False)
    g = fields.groupBy("user_id", "invoice_number").agg(lists.alias("docs"), *_newest_fields())
    g = g.select("user_id", "invoice_number", "country", "recycler_company", "plastic_type", F.col("docs.document_type").alias("present_document_types"), F.col("docs.id").alias("present_document_ids"))
    return completeness(apply_business_rule(g, rules))


def group_summary(parsed: DataFrame, rules: DataFrame, newest: int = 20) -> DataFrame:
    """``group_documents`` in rows of bounded size: documents, the distinct present types, and the ``newest`` newest ids, newest first.

    Counts and fields come from partial aggregation; a task keeps its ``newest`` newest of a group before they are shuffled.
    """
    fields = _grouping_fields(parsed)
    g = fields.groupBy("user_id", "invoice_number").agg(F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_set("document_type")).alias("present_document_types"), *_newest_fields())
    nth = F.row_number().over(Window.partitionBy("user_id", "invoice_number").orderBy(F.desc("at")))
    top = fields.select("user_id", "invoice_number", "at").withColumn("nth", nth).where(F.col("nth") <= newest)
    ids = top.groupBy("user_id", "invoice_number").agg(F.sort_array(F.collect_list("at"), asc=False)["id"].alias("newest_ids"))
    same = F.col("g.user_id").eqNullSafe(F.col("i.user_id")) & (F.col("g.invoice_number") == F.col("i.invoice_number"))
    return completeness(apply_business_rule(g.alias("g").join(ids.alias("i"), same, "left").select("g.*", "i.newest_ids"), rules))


def group_chunks(parsed: DataFrame, size: int = 1000) -> DataFrame:
    """The whole membership of all groups, newest first, in rows of at most ``size`` documents: user_id, invoice_number, chunk (from 0), ids and types.

    Documents are numbered in ranges of (group, age), so no task and no row holds a group of very many documents.
    """
    fields = _grouping_fields(parsed).select("user_id", "invoice_number", "document_type", "id", "at")
    ranked = rank_by_ranges(fields, ["user_id", "invoice_number"], [F.desc("at")])
    chunk = F.floor((F.col("nth") - 1) / size)
    lists = F.sort_array(F.collect_list(F.struct("nth", "id", "document_type")))
    return ranked.groupBy("user_id", "invoice_number", chunk.alias("chunk")).agg(lists.alias("l")).select("user_id", "invoice_number", "chunk", F.col("l.id").alias("ids"), F.col("l.document_type").alias("types"))


def completeness(groups: DataFrame) -> DataFrame:
    """Missing types, counts and flags of groups with a rule."""
    present = F.col("present_document_types")
    missing = F.filter("required_documents", lambda x: ~F.array_contains(present, x))
    count = F.size("required_documents") - F.size(missing)
    out = groups.withColumn("missing_document_types", missing).withColumn("completion_count", count).withColumn("is_complete", count >= F.col("minimum_required"))
    percent = F.when(F.col("minimum_required") > 0, F.floor(100.0 * F.col("completion_count") / F.col("minimum_required") + 0.5)).otherwise(0)
    return out.withColumn("can_verify", F.col("is_complete")).withColumn("completion_percentage", percent.cast("int"))


def document_names(document_type: Column, anchor_key: Column, doc: Column) -> Column:
    """The invoice numbers that a document belongs to: its own and, for a receipt, the second and third that it names."""
    further = [F.when(document_type == "eft_receipt", json_truthy(doc, k)) for k in ("second_invoice", "third_invoice")]
    names = F.array(first_truthy(anchor_key, json_text(doc, "invoice")), *further)
    return F.filter(F.array_distinct(F.transform(F.array_compact(names), lambda n: F.btrim(n))), lambda n: n != "")


def group_references(parsed: DataFrame, known_only: bool = False) -> DataFrame:
    """Groups by the canonical key, receipts also under the further invoices they name; ``known_only``: under those that an invoice document of the user has.

    Documents are read once: a group is summed up with and without the documents that name it as a further one, and whether an invoice has it as its own
    number decides which sums hold. A document's own number always holds.
    """
    names = document_names(F.col("document_type"), F.col("anchor_key"), F.col("doc"))
    first = invoice_group_key(first_truthy(F.col("anchor_key"), json_text(F.col("doc"), "invoice")))
    each = once(once(parsed, "doc", F.try_parse_json("raw_json")), "own_key", first)
    each = each.select("id", "user_id", "document_type", "own_key", F.explode(F.array_distinct(F.transform(names, lambda x: invoice_group_key(x)))).alias("group_key"))
    key = ["user_id", "group_key"]
    sums = lambda id, kind: [F.countDistinct(id), F.array_join(F.sort_array(F.collect_set(kind)), ",")]  # noqa: A002, E731
    if not known_only:
        documents, types = sums(F.col("id"), F.col("document_type"))
        return each.groupBy(*key).agg(documents.alias("documents"), types.alias("types"))
    each = each.withColumn("own", F.col("group_key").eqNullSafe(F.col("own_key")))
    flag = F.bool_or(F.col("own") & (F.col("document_type") == "invoice")) & F.col("user_id").isNotNull()
    mine = lambda c: F.when(F.col("own"), F.col(c))
    both = [*sums(F.col("id"), F.col("document_type")), *sums(mine("id"), mine("document_type"))]
    g = each.groupBy(*key).agg(F.coalesce(flag, F.lit(False)).alias("known"), F.bool_or("own").alias("any"), *[c.alias(n) for c, n in zip(both, ("documents", "types", "own_documents", "own_types"), strict=True)])
    held = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col(f"own_{c}")).alias(c)
    return g.where("known OR any").select(*key, held("documents"), held("types"))


def group_display_status(groups: DataFrame) -> DataFrame:
    """count, total and complete, as a domestic or another recycler's group is shown."""
    present, n = F.col("present_document_types"), F.size("present_document_types")
    has = lambda t: F.array_contains(present, t)
    domestic = is_domestic_recycler(F.col("recycler_company"), DOMESTIC_SHOWN)
    two = has("invoice") & has("e-way-bill")
    total = F.when(domestic & two & (n == 2), 2).otherwise(3)
    complete = F.when(domestic, two).otherwise((n >= 3) & two & has("eft_receipt"))
    return groups.select("user_id", "invoice_number", n.alias("count"), total.alias("total"), complete.alias("complete"))


def groups_with_documents(groups: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row per group and document type with its documents' ids and, in the same order, their rows (file_url, created_at, raw_json); ids that no document has are left out."""
    each = groups.select("user_id", "invoice_number", F.explode(F.array_distinct("present_document_ids")).alias("id"))
    found = each.join(parsed.select("id", "document_type", "file_url", "created_at", "raw_json"), "id")
    rows = F.sort_array(F.collect_list(F.struct("id", "file_url", "created_at", "raw_json")))
    return found.groupBy("user_id", "invoice_number", "document_type").agg(rows.alias("documents")).select("user_id", "invoice_number", "document_type", F.col("documents.id").alias("ids"), "documents")
