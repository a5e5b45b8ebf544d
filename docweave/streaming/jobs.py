"""Structured Streaming forms of the duplicate check, of the throughput figures and of grouping."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import blank_to_null, bound, once, parse_invoice_number
from ..operators.grouping import document_names, group_documents, group_fields, grouping_fields
from ..sources.tables import new_folder
from .state import BETWEEN, CLASSES, PAGES, TYPES, DocumentVersions, FirstOfFingerprint, GroupCounts, candidates, use_store

#: The time of rows without one, in microseconds.
NEVER = -(2**63)


def stream_throughput(events: DataFrame, time: str, width: str, delay: str = "0 seconds") -> DataFrame:
    """Documents of each status in tumbling windows of ``width``; a window closes once the watermark passes it, later rows are dropped."""
    at = F.window(time, width)
    return events.withWatermark(time, delay).groupBy(at.alias("w"), "status").agg(F.count(F.lit(1)).alias("documents")).select(F.col("w.start").alias("window_start"), "status", "documents")


def _stored(stream: DataFrame, schema: StructType, path: str) -> DataFrame:
    """The rows under ``path``, none where no batch has written yet."""
    try:
        return stream.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return stream.sparkSession.createDataFrame([], schema)


def run_available(stream: DataFrame, label: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Everything available now, written to ``path`` (a new shared folder without one); a stream without rows gives none.

    The sink's log makes a restarted batch count once, and a later call with the same path takes only what is new.
    """
    path = path or new_folder(stream.sparkSession, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return _stored(stream, stream.schema, f"{path}/rows")


def stream_deduplicate(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Documents that are kept as they arrive: repeated invoices are dropped within a batch and against all earlier batches.

    The first document of a fingerprint in a batch is that with the least (created_at, id). What has been seen is keyed state by pages of fingerprints: a batch
    looks up the pages of its own and reads nothing else of earlier batches. A task sends only its first row of a fingerprint to the
    state and drops its later invoices itself, so a fingerprint of very many documents meets no single task. A restart with the
    same ``path`` changes nothing and goes on behind the last batch. ``stream`` has id, user_id, document_type, created_at and
    business_fingerprint. A stream without rows gives none.
    """
    use_store(stream.sparkSession)
    kind = stream.schema["created_at"].dataType
    rows = stream.select("id", "user_id", "document_type", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(NEVER)).alias("at"), "business_fingerprint")
    kept = candidates(rows, PAGES).groupBy("page").transformWithStateInPandas(FirstOfFingerprint(), rows.schema, "append", "None")
    kept = kept.select("id", "user_id", "document_type", F.timestamp_micros(F.nullif("at", F.lit(NEVER))).cast(kind).alias("created_at"), "business_fingerprint")
    return run_available(kept, "stream-deduplicate", path=path)


def stream_group_changes(events: DataFrame, path: str, close_after: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Groups of a change feed: (user_id, group_key, region, documents, invoice, eft_receipt, e_way_bill, complete, closed).

    ``events`` has event_id, ts, op (INSERT, UPDATE or DELETE) and the columns of parsed_documents. Of a document its event with the greatest event_id
    holds, in whatever order they come; an update takes it out of groups it no longer names. A document is in the group of each invoice number that
    ``grouping.document_names`` finds; a group is the numbers of one user that agree but for their region, and has a class for each region.
    Keyed state by pages of documents makes changes of groups, which are summed up before they are written to a log, so that a group of very many documents is a
    few rows a batch; the groups are the sums of the log. With ``close_after`` a second query reads the log and holds the counts in keyed state by group: a group whose
    classes are all complete is closed when the feed's time, less ``delay``, is that much past its last change. Its counts leave the state, and later
    changes of it are ignored, also by later calls without ``close_after``. A restart with the same ``path`` goes on behind the last batch.
    """
    spark = events.sparkSession
    use_store(spark)
    log = "user_id string, group_key string, region string, document_type string, change long, ts timestamp"
    gone = F.coalesce(F.col("op") == "DELETE", F.lit(False))
    place = lambda n: bound(parse_invoice_number(n), lambda p: F.concat(F.concat_ws("-", p["prefix"], p["year"], p["period"], p["number"]), F.lit("\x01"), F.coalesce(p["region"], F.lit(""))))
    places = F.array_join(F.transform(document_names(F.col("document_type"), F.col("anchor_key"), F.col("doc")), place), BETWEEN)
    named = once(events, "doc", F.when(~gone, F.try_parse_json("raw_json"))).select(
        F.pmod(F.xxhash64("user_id", "id"), F.lit(PAGES)).alias("page"), "user_id", "id", F.col("event_id").cast("long").alias("event_id"), gone.alias("gone"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at"), "document_type", F.when(~gone, places).alias("places"),
    )
    changes = named.groupBy("page").transformWithStateInPandas(DocumentVersions(), "user_id string, place string, change long, at long", "update", "None")

    def add(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("user_id", "place").agg(F.sum("change").alias("change"), F.nullif(F.max("at"), F.lit(NEVER)).alias("at")).where("change <> 0")
        parts = F.split("place", "\x01", 3)
        rows = summed.select("user_id", *[parts[i].alias(n) for i, n in enumerate(("group_key", "region", "document_type"))], "change", F.timestamp_micros("at").alias("ts"))
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    changes.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", f"{path}/checkpoint-changes").trigger(availableNow=True).start().awaitTermination()
    found = f"user_id string, group_key string, classes {CLASSES}, closed boolean"
    numbered = spark.createDataFrame([], f"{found}, batch long").schema
    made = _stored(events, spark.createDataFrame([], f"{log}, batch long").schema, f"{path}/changes")
    if close_after is None and _stored(events, numbered, f"{path}/groups").isEmpty():
        return summed_groups(made)
    if not made.isEmpty():
        feed = spark.readStream.schema(f"{log}, batch long").parquet(f"{path}/changes").withWatermark("ts", delay)
        after = None if close_after is None else int(spark.range(1).select(F.expr(f"CAST(INTERVAL {close_after} AS INTERVAL DAY TO SECOND)").alias("i")).first()["i"].total_seconds() * 1000)
        groups = feed.groupBy("user_id", "group_key").transformWithState(GroupCounts(after), found, "update", "EventTime")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/groups/batch={number}")

        groups.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/checkpoint-groups").trigger(availableNow=True).start().awaitTermination()
    rows = _stored(events, numbered, f"{path}/groups")
    last = rows.groupBy("user_id", "group_key").agg(F.max_by(F.struct("classes", "closed"), "batch").alias("g"))
    return last.select("user_id", "group_key", "g.closed", F.explode("g.classes").alias("c")).select("user_id", "group_key", "c.*", "closed")


def summed_groups(log: DataFrame) -> DataFrame:
    """The groups of a log of changes: documents without a region count in the least region that their group has, as in ``state.region_classes``."""
    key = ["user_id", "group_key"]
    counts = log.repartition(*key).groupBy(*key, "region", "document_type").agg(F.sum("change").alias("n")).where("n <> 0")
    least = F.min(blank_to_null(F.col("region"))).over(Window.partitionBy(*key))
    of = {t.replace("-", "_"): F.coalesce(F.sum(F.when(F.col("document_type") == t, F.col("n"))), F.lit(0)).alias(t.replace("-", "_")) for t in TYPES}
    classes = counts.withColumn("region", F.coalesce(blank_to_null(F.col("region")), least)).groupBy(*key, "region").agg(F.sum("n").alias("documents"), *of.values())
    complete = F.lit(True)
    for name in of:
        complete &= F.col(name) > 0
    return classes.select(*key, "region", "documents", *of, complete.alias("complete"), F.lit(False).alias("closed"))


def stream_upsert(stream: DataFrame, path: str, rules: DataFrame, buckets: int = 256) -> DataFrame:
    """The groups of all documents that have arrived: each batch groups anew only the (user, invoice number) that it touches.

    What grouping takes from a document, not its text, is stored by bucket of its group, and an index by bucket of its id says where each one is. A batch reads the index
    buckets of its ids and the document buckets of its groups, the old ones of documents that move included; a document that moves
    leaves a mark in its old group. A batch whose buckets are new is grouped as it is. Of a document the last batch's version holds, within a batch the greatest (created_at, raw_json). Folders of a
    batch are overwritten when it is run again, and a batch reads folders up to its own, so a restart with the same ``path`` changes nothing. Of a group the
    last batch's row holds; one that all documents have left is gone. ``stream`` has the columns of parsed_documents; documents
    without an invoice number are indexed and in no group, as are those without an id, each of which is a document of its own.
    """
    spark = stream.sparkSession
    key = ["user_id", "invoice_number"]
    columns = stream.columns
    more = spark.createDataFrame([], "gone boolean, batch long, bucket int").schema
    fields = grouping_fields(spark.createDataFrame([], stream.schema)).schema
    documents = StructType([*fields, *more])
    index = spark.createDataFrame([], "id string, user_id string, invoice_number string, batch long, slot int").schema
    groups = group_documents(spark.createDataFrame([], stream.schema), rules).schema.add("batch", "long")
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")

    def touched(df: DataFrame, name: str) -> list[int]:
        return [r[0] for r in df.select(name).distinct().collect()]

    def add(batch: DataFrame, number: int) -> None:
        own = F.struct("created_at", "raw_json", *[c for c in columns if c not in ("created_at", "raw_json")])
        alone = batch.withColumn("__alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
        newest = grouping_fields(alone.groupBy("id", "__alone").agg(F.max(own).alias("d")).select("d.*"))
        arrived = newest.select(*fields.names, F.lit(False).alias("gone"), F.when(F.col("invoice_number").isNotNull(), slot(*key)).otherwise(-1).alias("bucket"))
        arrived.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/documents/batch={number}")
        mine = _stored(batch, documents, f"{path}/documents").where(F.col("batch") == number)
        ids = mine.where("id IS NOT NULL").withColumn("slot", slot("id"))
        places = _stored(batch, index, f"{path}/index").where(F.col("batch") < number)
        places = places.where(F.col("slot").isin(touched(ids, "slot"))) if number else places
        known = places.groupBy("id").agg(F.max_by(F.struct(*key), "batch").alias("old"))
        moved = ids.join(known, "id").where(~(F.col("old.user_id").eqNullSafe(F.col("user_id")) & F.col("old.invoice_number").eqNullSafe(F.col("invoice_number"))))
        marks = moved.select("id", "old.*").where("invoice_number IS NOT NULL").select("id", *key, F.lit(True).alias("gone"), slot(*key).alias("bucket"))
        marks.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/marks/batch={number}")
        ids.select("id", *key, "slot").hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/index/batch={number}")
        now = _stored(batch, documents, f"{path}/documents").unionByName(_stored(batch, documents, f"{path}/marks")).where((F.col("batch") <= number) & (F.col("bucket") >= 0))
        mine = now.where(F.col("batch") == number)
        near = now.where(F.col("bucket").isin(touched(mine, "bucket")))
        keys = mine.select(F.col("user_id").alias("u"), F.col("invoice_number").alias("i")).distinct()
        current = mine
        if not near.where(F.col("batch") < number).isEmpty():
            members = near.join(keys, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("invoice_number") == F.col("i")), "left_semi")
            last = members.where("id IS NOT NULL").groupBy(*key, "id").agg(F.max_by(F.struct("gone", *[c for c in fields.names if c not in (*key, "id")]), F.struct("batch", ~F.col("gone"))).alias("v"))
            current = last.where("NOT v.gone").select(*key, "id", "v.*").select(*fields.names).unionByName(members.where("id IS NULL AND NOT gone").select(*fields.names))
        made = group_fields(current.select(*fields.names), rules)
        left = keys.join(made.select(F.col("user_id").alias("u2"), F.col("invoice_number").alias("i2")), F.col("u").eqNullSafe(F.col("u2")) & (F.col("i") == F.col("i2")), "left_anti")
        emptied = left.select(F.col("u").alias("user_id"), F.col("i").alias("invoice_number"))
        made.unionByName(emptied, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}/groups/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = _stored(stream, groups, f"{path}/groups")
    whole = F.struct(*[c for c in rows.columns if c not in key])
    last = rows.groupBy(*key).agg(F.max_by(whole, "batch").alias("g"))
    return last.select(*key, "g.*").drop("batch").where("present_document_ids IS NOT NULL")
