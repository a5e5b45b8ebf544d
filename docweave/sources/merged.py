"""Stored tables that are merged in place: rows in buckets by key, of which a merge writes only those it changes.

A table is a folder: ``rows/version=N/bucket=B`` holds the rows of a bucket as merge N left them, and ``commits/commit=N``, which is written last and in
one file, says which buckets merge N has replaced. A bucket's rows are those of the last commit that names it. A merge that fails before
its commit leaves the table as it was, and the next one overwrites what it left behind.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.promotion import upsert


def _commits(spark: SparkSession, path: str) -> dict[int, int]:
    """The version of each bucket; one number a bucket reaches the driver."""
    try:
        rows = spark.read.schema("bucket int, commit long").parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["bucket"]: r["commit"] for r in rows.groupBy("bucket").agg(F.max("commit").alias("commit")).collect()}


def _rows(spark: SparkSession, path: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    folders = [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_merged(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``; columns that older buckets lack are null."""
    return _rows(spark, path, schema, _commits(spark, path))


def merge_into(incoming: DataFrame, path: str, schema: StructType, keys: list[str], preserve: tuple[str, ...] = (), buckets: int = 64) -> int:
    """Inserts or updates ``incoming`` in the table at ``path`` by ``keys``, as ``upsert`` does; gives the number of buckets replaced.

    Only buckets that incoming keys fall into are read, and only those in which a row is new or different are replaced; others keep
    their files. So the same merge again changes nothing. Two incoming rows with one key fail the merge and leave the table; so does a null key,
    which no later merge could find again. ``buckets`` must stay the same for a table.
    """
    spark = incoming.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    bucket = F.when(known, bucket).otherwise(F.raise_error(F.lit("an incoming row has a null key")).cast("int"))
    versions = _commits(spark, path)
    touched = [r[0] for r in incoming.select(bucket.alias("bucket")).distinct().collect()]
    version = max(versions.values(), default=0) + 1
    old = _rows(spark, path, schema, {b: versions[b] for b in touched if b in versions})
    mine = old.select(F.struct(*schema.names).alias("__was"), *[F.col(k).alias(f"__{k}") for k in keys])
    merged = upsert(old, incoming, keys, preserve)
    merged = merged.select(*[F.col(c) if c in merged.columns else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    out = merged.join(mine, same, "left").withColumn("changed", ~F.struct(*schema.names).eqNullSafe(F.col("__was"))).drop("__was", *[f"__{k}" for k in keys])
    out = out.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version}")
    if not touched:
        return 0
    written = spark.read.schema("changed boolean, bucket int").parquet(f"{path}/rows/version={version}")
    replaced = sorted(r[0] for r in written.where("changed").select("bucket").distinct().collect())
    if replaced:
        spark.createDataFrame([(b,) for b in replaced], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={version}")
    return len(replaced)
