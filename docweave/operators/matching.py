"""Joins and windows that find equal and duplicate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank_to_null, parse_invoice_number, same_parts


def invoice_classes(df: DataFrame, id: str, invoice: str, user: str | None) -> DataFrame:  # noqa: A002
    """(user, id, class, p): each row with the class of its invoice number, the numbers that parse to the same parts. Rows without a number are left out."""
    p = F.col("p")
    parsed = df.select(F.col(id).alias("id"), *([user] if user else []), parse_invoice_number(F.col(invoice)).alias("p")).where(p.isNotNull())
    name = F.concat_ws("|", p["normalized"], p["prefix"], F.coalesce(p["region"], F.lit("")), p["year"], p["period"], p["number"])
    return parsed.withColumn("class", name)


def match_classes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, invoice: str = "invoice_number", user: str | None = "user_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matching of two tables in parts that grow with their rows: members(user, id, class) of each side and links(user, left_class, right_class).

    Documents that share a number, a placeholder of a third of all rows among them, are one class; classes meet by an equi-join on (user, key) with
    the region as a residual, a missing region standing for any. No pair of documents is made.
    """
    cols = [user] if user else []
    sides = [invoice_classes(d, i, invoice, user) for d, i in ((left, left_id), (right, right_id))]
    p = F.col("p")
    keys = F.array(F.concat(F.lit("N:"), p["normalized"]), F.concat_ws("|", F.lit("P:"), p["prefix"], p["year"], p["period"], p["number"]))
    # Numbers of one class differ in their original text only, which the choice of any one leaves out.
    each = [s.groupBy(*cols, "class").agg(F.first("p").alias("p")).withColumn("match_key", F.explode(keys)) for s in sides]
    a, b = (d.withColumnRenamed("class", f"{n}_class").withColumnRenamed("p", f"{n}_p") for d, n in zip(each, ("left", "right"), strict=True))
    links = a.join(b, [*cols, "match_key"]).where(same_parts(F.col("left_p"), F.col("right_p"))).select(*cols, "left_class", "right_class").distinct()
    return sides[0].drop("p"), sides[1].drop("p"), links


def match_invoices(left: DataFrame, right: DataFrame, left_id: str, right_id: str, invoice: str = "invoice_number", user: str | None = "user_id") -> DataFrame:
    """All pairs (left_id, right_id) of the same invoice: the members of ``match_classes`` along its links. For tables with placeholder numbers take the parts."""
    cols = [user] if user else []
    a, b, links = match_classes(left, right, left_id, right_id, invoice, user)
    a, b = a.withColumnsRenamed({"id": "left_id", "class": "left_class"}), b.withColumnsRenamed({"id": "right_id", "class": "right_class"})
    return a.join(links, [*cols, "left_class"]).join(b, [*cols, "right_class"]).select(*cols, "left_id", "right_id").distinct()


def mark_duplicates(parsed: DataFrame, shown: int = 5) -> DataFrame:
    """Within a batch the first document of a fingerprint is kept; later invoices are skipped, other types are kept.

    The first of each fingerprint comes from a partial aggregation that is joined back, so a fingerprint that many near-empty
    documents share is never sorted in one task.
    """
    first = parsed.groupBy("business_fingerprint").agg(F.min(F.struct("created_at", "id", "user_id")).alias("first"), F.count(F.lit(1)).alias("copies"))
    out = parsed.join(first, "business_fingerprint")
    later = (F.col("id") != F.col("first.id")) & (F.col("document_type") == "invoice")
    return out.select("id", "document_type", "business_fingerprint", later.alias("is_duplicate"), F.when(later, F.col("first.id")).alias("first_id"), F.when(later, F.col("user_id") == F.col("first.user_id")).alias("same_user"), F.least("copies", F.lit(shown)).alias("hits"))


#: Distinct keys of a batch, of 8 bytes each, up to which a filter of them is broadcast.
FILTER_KEYS = 1_000_000


def duplicates_against_history(batch: DataFrame, history: DataFrame, shown: int = 5) -> DataFrame:
    """Invoices of ``batch`` whose fingerprint history has, of any user, with up to ``shown`` earliest hits.

    History is filtered by the hashes of the batch's fingerprints before anything is shuffled; they are counted, and broadcast up to
    ``FILTER_KEYS``. Of what passes, a task keeps the ``shown`` earliest of each fingerprint, and those meet in the shuffle.
    """
    b = batch.where(F.col("document_type") == "invoice").select("id", "user_id", "business_fingerprint")
    keys = b.where(F.col("business_fingerprint").isNotNull()).select(F.xxhash64("business_fingerprint").alias("key")).distinct()
    few = keys.limit(FILTER_KEYS + 1).count() <= FILTER_KEYS
    h = history.select("business_fingerprint", F.col("id").alias("hit_id"), F.col("user_id").alias("hit_user"), "created_at", F.xxhash64("business_fingerprint").alias("key"))
    h = h.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    order = Window.partitionBy("business_fingerprint").orderBy("created_at", "hit_id")
    h = h.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= shown)
    return b.join(h, "business_fingerprint").select("id", "hit_id", "nth", (F.col("user_id") == F.col("hit_user")).alias("same_user"))


def latest_per_type(matches: DataFrame) -> DataFrame:
    """The newest row of each (user, invoice, type)."""
    newest = F.max_by(F.col("id"), F.struct("created_at", "id"))
    return matches.groupBy("user_id", "invoice_number", "document_type").agg(newest.alias("id"), F.max("created_at").alias("created_at"))


def unparsed_pages(single: DataFrame, parsed: DataFrame, statuses: tuple[str, ...] = ("uploaded", "failed")) -> DataFrame:
    """Pages of these statuses (none given: of all) whose path, from a folder's start on, ends no parsed file url of the same user.

    See ``ending_files``.
    """
    some = single.where(F.col("status").isin(*statuses)) if statuses else single
    pages, files, same = ending_files(some, parsed)
    return pages.join(files, same, "left_anti").drop("__path")


def ending_files(single: DataFrame, parsed: DataFrame, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Pages with the hash of their path, (__user, __tail) of parsed file urls, each once, and the condition that a url ends in a page's path, from a folder's start on.

    A url stands under the hashes of its tails that begin behind a slash, and of itself, as far as any page's path has as many folders; a page is looked up by the
    hash of its whole path. So pages that share a file name, even all of a user's, share no key, and a url is mostly one row. ``table`` is what ``single`` is made of, where
    that is cheaper to read for the paths' depths.
    """
    path = F.ltrim("pdf_path", F.lit("/"))
    pages = single.withColumn("__path", F.xxhash64(path))
    depths = (single if table is None else table).where(F.col("pdf_path").isNotNull()).agg(F.collect_set(F.size(F.split(path, "/"))).alias("__depths"))
    steps = F.split(F.col("file_url"), "/")
    urls = parsed.where(F.col("file_url").isNotNull()).select(F.col("user_id").alias("__user"), steps.alias("__steps")).join(F.broadcast(depths), F.lit(True))
    n = F.size("__steps")
    tails = F.transform(F.filter("__depths", lambda d: d <= n), lambda d: F.xxhash64(F.array_join(F.slice("__steps", n - d + 1, d), "/")))
    files = urls.select("__user", F.explode(tails).alias("__tail")).distinct()
    return pages, files, (pages["user_id"] == files["__user"]) & (pages["__path"] == files["__tail"])


def existing_filename_warnings(files: DataFrame, temp: DataFrame, single: DataFrame) -> DataFrame:
    """Each new file with the table that knows its name already (uploads before pages), null if none does."""
    t = temp.select("user_id", F.col("pdf_path").alias("file_name")).distinct().withColumn("t", F.lit(True))
    s = single.select("user_id", F.col("original_filename").alias("file_name")).distinct().withColumn("s", F.lit(True))
    return files.join(t, ["user_id", "file_name"], "left").join(s, ["user_id", "file_name"], "left").select("user_id", "file_name", F.when(F.col("t"), "temp_documents").when(F.col("s"), "single_documents").alias("known_in"))


def invoice_candidates(parsed: DataFrame) -> DataFrame:
    """(id, user_id, document_type, created_at, invoice_number): every invoice number that a document names."""
    doc = F.try_parse_json("raw_json")
    names = [blank_to_null(F.btrim(F.try_variant_get(doc, f"$.{k}", "string"))) for k in ("anchor_key", "invoice", "second_invoice", "third_invoice")]
    return parsed.select("id", "user_id", "document_type", "created_at", F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("invoice_number"))
