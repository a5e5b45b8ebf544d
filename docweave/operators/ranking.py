"""Row numbers without gathering a group in one task: rows are dealt out by ranges of their order and numbered by offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder


def rank_by_ranges(df: DataFrame, by: list[str], order: list[Column], within: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with ``nth``, a row's number from 1 in its group, and ``total``, the group's rows, both long; ``within`` keeps numbers of that range only.

    Rows are sorted in ranges of (``by``, ``order``) and written once with their place. A range that holds a part of a group gets the
    rows before it as its offset, so a group of most rows is spread over as many tasks as its share; what is joined is one row for each
    group and range, and with ``within`` only for the ranges that reach into it. Groups may be null. Rows that the order does not tell
    apart are numbered as they come.
    """
    spark = df.sparkSession
    path = new_folder(spark, "ranked")
    keys = [*[F.col(c) for c in by], *order]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else df
    numbered = dealt.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    numbered.write.parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    runs = stored.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(Window.partitionBy(*by)))
    if within:
        runs = runs.where((F.col("__before") < within[1]) & (F.col("__before") + F.col("__n") >= within[0]))
    right = runs.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__run"), "__first", "__before", "total")
    same = F.col("__part") == F.col("__run")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = stored.join(right, same).withColumn("nth", F.col("__before") + F.col("__at") - F.col("__first") + 1)
    out = out.where(F.col("nth").between(*within)) if within else out
    return out.select(*df.columns, "nth", "total")
