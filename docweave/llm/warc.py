"""Content-addressed web archive.

The archive is two tables: ``records`` holds each record's exact header block with the digest of its payload, ``payloads`` the bytes
of each distinct payload once, under its SHA-256. Both tables say how many records have the payload. Records with equal payloads of at
least ``least_bytes`` are revisits of the one with the smallest id; their headers refer to it. Reading back joins each header with its
payload, rebuilds the record, and takes digest and length from the rebuilt bytes. A record whose payload is missing or altered stays in the result as not ``intact``.

A null payload is empty. A null url gives an empty target; control characters in one are percent-encoded. Rows with a null id come
last in order of ids, so one of them is the response only where all ids of its payload are null. Repeated rows (same id, same
payload) have the same type. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, sha256_hex

CRLF = "\r\n"
#: Fixed value of the WARC/1.1 standard: the profile of a revisit whose payload equals an earlier one.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one payload that one copy of it serves when originals are rebuilt.
RECORDS_A_COPY = 2000
SALTS = 32


def _salts() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def record_id(page_id: Column) -> Column:
    """A name-based uuid of the page's id."""
    h = sha256_hex(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(F.lit("a"), h.substr(18, 3)), h.substr(21, 12)), F.lit(">"))


def header_block(page_id: Column, url: Column, digest: Column, size: Column, kind: Column, refers_to: Column, date: str) -> Column:
    """The header lines of a record, with the blank line that ends them."""
    safe = F.coalesce(url, F.lit(""))
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        safe = F.when(safe.rlike("[\r\n]"), F.replace(safe, F.lit(char), F.lit(code))).otherwise(safe) if char == "%" else F.replace(safe, F.lit(char), F.lit(code))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id(page_id)), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest), F.concat(F.lit("WARC-Page-ID: "), F.coalesce(page_id.cast("string"), F.lit("-"))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}")), F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to))), F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To-Page: "), refers_to.cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the ``records`` and ``payloads`` tables of ``pages`` below ``path``.

    Which record is the response is settled on (digest, id) alone. Payload bytes are shuffled once, by (id, digest): rows that repeat
    both are dropped before that shuffle, and the join that keeps one id of each digest has the same partitioning.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    # A null id has the name "-", so that ids are compared without a null-safe join.
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumn("name", name)
    keyed = keyed.withColumn("digest", sha256_hex(F.col("body"))).withColumn("size", F.octet_length("body").cast("long"))
    heads = keyed.select("page_id", "url", "digest", "size").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    firsts = heads.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("records"))
    # A hot payload's records are spread over the salts; the other side has one row per digest.
    salted = firsts.select("digest", "first_id", "records", F.explode(_salts()).alias("salt"))
    typed = heads.join(salted, ["digest", "salt"])
    revisit = (F.col("size") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    block = header_block(F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), kind, F.col("first_id"), date)
    typed.select("digest", "records", block.alias("header")).write.parquet(f"{path}/records")
    chosen = firsts.select(F.coalesce(F.col("first_id").cast("string"), F.lit("-")).alias("name"), "digest", "records")
    held = keyed.select("name", "digest", "size", "body").dropDuplicates(["name", "digest"]).join(chosen, ["name", "digest"])
    held.select("digest", "records", "size", "body").write.parquet(f"{path}/payloads")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: digest, header, record, payload.

    ``record`` is the record as an archive file holds it: header block, content block, two line ends; a revisit's content block is empty,
    as its Content-Length says. ``payload`` is the whole payload of any record. Both are null where the payload is missing. A payload is
    copied once for each RECORDS_A_COPY of its records, so none gathers in one task.
    """
    copies = F.ceil(F.col("records") / RECORDS_A_COPY)
    records = spark.read.parquet(f"{path}/records").withColumn("copy", F.pmod(F.xxhash64("header"), copies)).drop("records")
    payloads = spark.read.parquet(f"{path}/payloads")
    bodies = payloads.select("digest", F.col("body").alias("payload"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    whole = F.when(F.col("payload").isNotNull(), F.concat(F.col("header").cast("binary"), block, F.lit(CRLF * 2).cast("binary")))
    return records.join(bodies, ["digest", "copy"], "left").select("digest", "header", whole.alias("record"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The rebuilt records: page_id (text, null for none), url, payload_bytes, payload_digest, record_type, refers_to, intact.

    Bytes and digest are those of the rebuilt payload (null where it is missing); ``intact`` says whether both are what the header promises.
    """
    rebuilt = original_records(spark, path).select("header", F.octet_length("payload").cast("long").alias("payload_bytes"), sha256_hex(F.col("payload")).alias("payload_digest"))
    h = F.col("header")
    page, refers = field(h, "WARC-Page-ID"), field(h, "WARC-Refers-To-Page")
    promised = (field(h, "WARC-Payload-Digest").substr(8, 64) == F.col("payload_digest")) & (field(h, "X-Payload-Length") == F.col("payload_bytes").cast("string"))
    return rebuilt.select(
        F.when(page != "-", page).alias("page_id"), field(h, "WARC-Target-URI").alias("url"), "payload_bytes", "payload_digest",
        field(h, "WARC-Type").alias("record_type"), F.when(refers != "", refers).alias("refers_to"), F.coalesce(promised, F.lit(False)).alias("intact"),
    )


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Archive of all pages, written and read back."""
    import uuid

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_records(spark, path).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "intact")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, TRUE AS intact
FROM f
"""
