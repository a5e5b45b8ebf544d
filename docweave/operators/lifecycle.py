"""Uploads and pages: roll-ups, the unprocessed queue, paging, page expansion, retries and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import ending_files, unparsed_pages
from .ranking import rank_by_ranges


def lifecycle_groups(temp: DataFrame, single: DataFrame) -> DataFrame:
    """One row per upload; pages are counted before the join, so it moves one row per upload."""
    n = lambda s: F.count_if(F.col("status") == s)
    pages = single.groupBy(F.col("temp_document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("pages"), n("uploaded").alias("pages_uploaded"), n("processed").alias("pages_processed"), n("failed").alias("pages_failed"), n("skipped_duplicate").alias("pages_skipped"), n("processing").alias("pages_processing"), F.max("total_pages").alias("total_pages"),
    )
    counts = ("pages", "pages_uploaded", "pages_processed", "pages_failed", "pages_skipped", "pages_processing")
    j = temp.join(pages, "id", "left").fillna(0, list(counts)).fillna(1, ["total_pages"])
    s, c = F.col("status"), F.col
    status = (
        F.when(s == "failed", "preprocessing_failed").when(s == "uploaded", "preprocessing_pending").when(s == "processing", "preprocessing").when(c("pages") == 0, "preprocessing_complete_no_pages")
        .when(c("pages_uploaded") > 0, "ai_processing_pending").when(c("pages_processing") > 0, "ai_processing").when(c("pages_failed") > 0, "ai_processing_failed")
        .when(c("pages_processed") + c("pages_skipped") == c("pages"), "complete").otherwise("partial")
    )
    retry = (s == "failed") | (c("pages_failed") > 0) | (c("pages_uploaded") > 0)
    return j.select("id", "user_id", "total_pages", *counts[1:5], F.coalesce(retry, F.lit(False)).alias("can_retry"), status.alias("overall_status"))


def unprocessed_documents(single: DataFrame, parsed: DataFrame, temp: DataFrame, check_parsed: bool = True) -> DataFrame:
    """Unparsed pages and waiting or failed uploads in one shape.

    Without ``check_parsed`` pages count whether parsed or not, and total_pages is 1 everywhere; with it, an upload's is null.
    """
    pages = unparsed_pages(single, parsed) if check_parsed else single.where(F.col("status").isin("uploaded", "failed"))
    cols = ["id", "user_id", "pdf_path", "upload_date", "status", "last_error", "retry_count"]
    a = pages.select(*cols, F.lit("single_documents").alias("source_table"), "original_filename", "temp_document_id", "page_number", (F.col("total_pages") if check_parsed else F.lit(1)).alias("total_pages"))
    b = temp.where(F.col("status").isin("uploaded", "failed")).select(*cols, F.lit("temp_documents").alias("source_table"), F.col("pdf_path").alias("original_filename"), F.lit(None).cast("string").alias("temp_document_id"), F.lit(None).cast("int").alias("page_number"), F.lit(None if check_parsed else 1).cast("int").alias("total_pages"))
    return a.unionByName(b)


def unprocessed_page(queue: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the whole queue, newest first, ties by id: a top-k, not a sort of all rows, while ``offset + limit`` is small."""
    return queue.orderBy(F.desc("upload_date"), F.asc("id")).offset(offset).limit(limit)


def pending_preprocess(temp: DataFrame, paths: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Each user's ``limit`` oldest uploads, of any status; with ``paths(pdf_path)``, all uploads of those paths instead. Ties go by id."""
    if paths is not None:
        return temp.join(paths.select("pdf_path"), "pdf_path", "left_semi")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("upload_date"), F.asc("id")))
    return temp.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def ready_for_extraction(single: DataFrame) -> DataFrame:
    """Pages that wait for extraction, oldest first."""
    return single.where(F.col("status") == "uploaded").orderBy("upload_date", "id")


def recent(df: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    """Each user's newest ``n`` rows by ``time``, nulls last, ties by ``key``. The optimizer cuts each task's rows to n a user before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last(time), F.asc(key)))
    return df.withColumn("nth", nth).where(F.col("nth") <= n)


def page_offset(df: DataFrame, order: list[Column], page: int, limit: int, key: str = "user_id") -> DataFrame:
    """One page of each user's rows with nth, total, total_pages, has_next and has_prev.

    Rows are numbered in ranges of their order, so a user of most rows is spread over tasks, and only ranges that reach into the page are numbered.
    """
    kept = rank_by_ranges(df, [key], order, ((page - 1) * limit + 1, page * limit)).withColumn("nth", F.col("nth").cast("int"))
    pages = F.ceil(F.col("total") / limit)
    return kept.withColumn("total_pages", pages).withColumn("has_next", F.lit(page) < pages).withColumn("has_prev", F.lit(page > 1))


def _open() -> Column:
    return (F.coalesce("status", F.lit("")) != "processed").cast("int")


def last_unprocessed_page(single: DataFrame) -> DataFrame:
    """Whether no other page of the same upload and user is unprocessed."""
    counts = single.groupBy("temp_document_id", "user_id").agg(F.sum(_open()).alias("open"))
    return single.join(counts, ["temp_document_id", "user_id"]).select("id", (F.col("open") - _open() == 0).alias("is_last"))


def expand_pages(temp: DataFrame) -> DataFrame:
    """One row per page of an upload; a single page keeps the upload's name."""
    n = F.greatest("page_count", F.lit(1))
    each = temp.select(F.col("id").alias("temp_document_id"), "user_id", "pdf_path", n.alias("total_pages"), F.explode(F.sequence(F.lit(1), n)).alias("page_number"))
    # Only the first hit of each is replaced.
    base = F.regexp_replace("pdf_path", r"(?s)^(.*?)temp/", "$1single/")
    named = F.regexp_replace(base, F.lit(r"(?s)^(.*?)\.pdf"), F.concat(F.lit("$1_page"), F.col("page_number").cast("string"), F.lit(".pdf")))
    return each.select("temp_document_id", "user_id", F.when(F.col("total_pages") == 1, base).otherwise(named).alias("pdf_path"), "page_number", "total_pages")


def new_pages_only(expanded: DataFrame, single: DataFrame) -> DataFrame:
    """Pages of an expansion whose path is no page yet, so that a repeated split adds nothing."""
    return expanded.join(single.select("pdf_path"), "pdf_path", "left_anti")


def failed_documents(temp: DataFrame, single: DataFrame) -> DataFrame:
    """Failed uploads and pages with their error and the stage that failed."""
    pick = lambda df, name: df.where(F.col("status") == "failed").select("id", "user_id", "last_error", "upload_date", F.lit(name).alias("stage"))
    return pick(temp, "preprocessing").unionByName(pick(single, "ai_processing"))


def queue_counts(temp: DataFrame, single: DataFrame) -> DataFrame:
    """Per user with either: uploads to split and pages to extract."""
    a = temp.where(F.col("status") == "uploaded").select("user_id", F.lit(1).alias("u"), F.lit(0).alias("p"))
    b = single.where(F.col("status") == "uploaded").select("user_id", F.lit(0).alias("u"), F.lit(1).alias("p"))
    return a.unionByName(b).groupBy("user_id").agg(F.sum("u").alias("uploads_waiting"), F.sum("p").alias("pages_ready"))


def check_status_domain(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Rows with a status outside ``allowed``; null passes."""
    return df.where(~F.col("status").isin(*allowed))


def plan_retries(requests: DataFrame, temp: DataFrame, single: DataFrame) -> DataFrame:
    """``requests(document_id, user_id, forced)`` with the action for each; a page is looked up before an upload."""
    s = single.select(F.col("id").alias("document_id"), "user_id", F.coalesce("status", F.lit("uploaded")).alias("ss"))
    t = temp.select(F.col("id").alias("document_id"), "user_id", F.coalesce("status", F.lit("uploaded")).alias("ts"))
    j = requests.join(s, ["document_id", "user_id"], "left").join(t, ["document_id", "user_id"], "left")
    ss, ts, forced = F.col("ss"), F.col("ts"), F.col("forced")
    action = (
        F.when(ss.isNull() & ts.isNull(), "not_found").when(forced == "force_preprocessing", "retry_preprocessing").when(forced == "force_ai", "retry_ai_processing").when(forced == "skip_duplicate", "skip_duplicate")
        .when(ss.isin("failed", "uploaded"), "retry_ai_processing").when(ss == "skipped_duplicate", "already_skipped").when(ss == "processed", "already_processed").when(ss.isNotNull(), "no_action_needed")
        .when(ts.isin("failed", "uploaded"), "retry_preprocessing").when(ts == "processed", "check_children").otherwise("no_action_needed")
    )
    return j.select("document_id", "user_id", action.alias("action"))


def apply_retries(plan: DataFrame, temp: DataFrame, single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads and pages after ``plan(document_id, user_id, action)``.

    A retried row is uploaded again, without its error and with one more try, however often it is asked for. ``check_children`` retries
    the upload's failed and waiting pages. ``skip_duplicate`` marks pages alone, never uploads, and wins over a retry of the same page.
    The plan is reduced to one row a document before it meets the tables.
    """
    asked = lambda name: F.bool_or(F.col("action") == name)
    flags = plan.groupBy("document_id", "user_id").agg(asked("retry_preprocessing").alias("split"), asked("retry_ai_processing").alias("extract"), asked("skip_duplicate").alias("skip"), asked("check_children").alias("children"))
    own = flags.select(F.col("document_id").alias("id"), "user_id", "split", "extract", "skip")
    parents = flags.where("children").select(F.col("document_id").alias("temp_document_id"), "user_id", "children")

    def changed(df: DataFrame, again: Column, skip: Column, columns: list[str]) -> DataFrame:
        again, skip = F.coalesce(again, F.lit(False)), F.coalesce(skip, F.lit(False))
        new = {
            "status": F.when(skip, "skipped_duplicate").when(again, "uploaded").otherwise(F.col("status")),
            "last_error": F.when(skip, "Manually marked as duplicate").when(~again, F.col("last_error")),
            "retry_count": F.when(again & ~skip, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")),
        }
        return df.select(*[new[c].alias(c) if c in new else c for c in columns])

    uploads = changed(temp.join(own, ["id", "user_id"], "left"), F.col("split"), F.lit(False), temp.columns)
    pages = single.join(own, ["id", "user_id"], "left").join(parents, ["temp_document_id", "user_id"], "left")
    child = F.coalesce("children", F.lit(False)) & F.col("status").isin("failed", "uploaded")
    return uploads, changed(pages, F.coalesce("extract", F.lit(False)) | child, F.col("skip"), single.columns)


def batch_summary(before: DataFrame, after: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row about a run: uploads tried, pages made, errors, and the pages before and after. ``outcomes`` has id, ok and pages; a null ok is an error."""
    ok = F.coalesce("ok", F.lit(False))
    zero, one = F.lit(0), F.lit(1)
    tried = outcomes.select(one.alias("uploads"), F.when(ok, F.coalesce("pages", zero)).otherwise(0).alias("processed"), F.when(ok, 0).otherwise(1).alias("errors"), zero.alias("pages_before"), zero.alias("pages_after"))
    count = lambda df, a, b: df.select(zero.alias("uploads"), zero.alias("processed"), zero.alias("errors"), a.alias("pages_before"), b.alias("pages_after"))
    rows = tried.unionByName(count(before, one, zero)).unionByName(count(after, zero, one))
    names = ("uploads", "processed", "errors", "pages_before", "pages_after")
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return sums.withColumn("net_increase", F.col("pages_after") - F.col("pages_before"))


def document_status(temp: DataFrame, single: DataFrame) -> DataFrame:
    """Stage, status, counts and the pages in order of every upload; an upload's pages are few, so their list is small."""
    n = lambda s: F.count_if(F.col("status") == s)
    pages = single.groupBy(F.col("temp_document_id").alias("id"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), n("processed").alias("processed_pages"), n("failed").alias("failed_pages"), n("skipped_duplicate").alias("skipped_pages"),
        F.min_by("total_pages", F.struct("page_number", "id")).alias("total_pages"), F.sort_array(F.collect_list(F.struct("page_number", "id", "status", "last_error"))).alias("pages"),
    )
    counts = ["n", "processed_pages", "failed_pages", "skipped_pages"]
    j = temp.join(pages, ["id", "user_id"], "left").fillna(0, counts).withColumn("total_pages", F.when(F.col("n") == 0, 1).otherwise(F.col("total_pages")))
    s, c = F.col("status"), F.col
    split = F.coalesce((s == "processed") & (c("n") > 0), F.lit(False))
    done = c("processed_pages") + c("skipped_pages") == c("n")
    status = F.when(split & done, "completed").when(split & (c("failed_pages") > 0), "ai_processing_failed").when(split, "ai_processing_pending").when(s == "failed", "preprocessing_failed").otherwise(F.coalesce(F.when(s != "", s), F.lit("uploaded")))
    return j.select(
        "id", "user_id", c("pdf_path").alias("original_filename"), "upload_date", F.when(split & done, "completed").when(split, "single").otherwise("temp").alias("current_stage"), status.alias("status"), "total_pages", *counts[1:],
        (F.coalesce(s == "failed", F.lit(False)) | (c("failed_pages") > 0)).alias("can_retry"), (c("processed_pages") == 0).alias("can_delete"), "last_error", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "pages",
    )


def page_status(single: DataFrame) -> DataFrame:
    """The same record of every page."""
    s = F.col("status")
    at = lambda *names: F.coalesce(s.isin(*names), F.lit(False))
    status = F.when(at("processed"), "completed").when(at("failed"), "ai_processing_failed").otherwise(F.coalesce(F.when(s != "", s), F.lit("uploaded")))
    or_one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    return single.select(
        "id", "user_id", F.coalesce(F.when(F.col("original_filename") != "", F.col("original_filename")), "pdf_path").alias("original_filename"), "upload_date", F.when(at("processed"), "completed").otherwise("single").alias("current_stage"), status.alias("status"),
        or_one("total_pages").alias("total_pages"), *[at(x).cast("long").alias(y) for x, y in (("processed", "processed_pages"), ("failed", "failed_pages"), ("skipped_duplicate", "skipped_pages"))],
        at("failed", "uploaded").alias("can_retry"), (~at("processed")).alias("can_delete"), "last_error", F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.array(F.struct(or_one("page_number").alias("page_number"), "id", "status", "last_error")).alias("pages"),
    )


def plan_deletions(requests: DataFrame, temp: DataFrame, single: DataFrame, parsed: DataFrame) -> DataFrame:
    """``requests(document_id, user_id, source_table)`` with the verdict, and the upload that goes with its last unprocessed page.

    Parsed pages (whose path ends a file url of the user in any case) and uploads past waiting or failed are denied as processed, rows of other
    tables, which meet no table, as protected. A request of ``unprocessed_documents`` means the page of that id, or else the upload. Ids are unique in a table.
    """
    key = ["document_id", "user_id"]
    counts = single.groupBy("temp_document_id", "user_id").agg(F.sum(_open()).alias("open"))
    each = single.join(counts, ["temp_document_id", "user_id"]).select("id", "user_id", "temp_document_id", F.lower("pdf_path").alias("pdf_path"), (F.col("open") - _open() == 0).alias("is_last"))
    paths, files, same = ending_files(each, parsed.withColumn("file_url", F.lower("file_url")), single)
    free = F.col("__user").isNull()
    verdict = F.when(free, "allowed").otherwise("processed")
    parent = F.when(free & F.col("is_last"), F.col("temp_document_id"))
    pages = paths.join(files, same, "left").select(F.col("id").alias("document_id"), "user_id", verdict.alias("page"), parent.alias("parent"))
    waiting = F.coalesce(F.col("status").isin("uploaded", "failed", ""), F.lit(True))
    uploads = temp.select(F.col("id").alias("document_id"), "user_id", F.when(waiting, "allowed").otherwise("processed").alias("upload"))
    table, none = F.col("source_table"), F.lit("not_found")
    looked_up = F.coalesce(table.isin("single_documents", "temp_documents", "unprocessed_documents"), F.lit(False))
    out = requests.where(looked_up).join(pages, key, "left").join(uploads, key, "left")
    rest = requests.where(~looked_up).select(*key, "source_table", F.lit("protected").alias("verdict"), F.lit(None).cast(single.schema["temp_document_id"].dataType).alias("parent_upload"))
    found = (
        F.when(table == "single_documents", F.coalesce("page", none)).when(table == "temp_documents", F.coalesce("upload", none))
        .when(table == "unprocessed_documents", F.coalesce("page", "upload", none)).otherwise("protected")
    )
    return out.select(*key, "source_table", found.alias("verdict"), F.when(table.isin("single_documents", "unprocessed_documents"), F.col("parent")).alias("parent_upload")).unionByName(rest)


def reset_stuck(single: DataFrame) -> DataFrame:
    """``single`` with every page in processing put back to uploaded."""
    return single.withColumn("status", F.when(F.col("status") == "processing", "uploaded").otherwise(F.col("status")))


def expire_uploads(temp: DataFrame, now: str, days: int) -> DataFrame:
    """Uploads of the last ``days`` days before ``now``; those without a date go."""
    return temp.where(F.col("upload_date") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
