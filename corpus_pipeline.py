"""Five stages that make a training corpus of ``documents``: quality, near duplicates, contamination, personal data, subword ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next one. All but the last
return the columns of ``docs``, extra ones too, whatever their names: rows travel as one struct beside what a stage computes.

Null and empty texts: the classifier scores them like any text, and they are no near duplicates, not contaminated and without personal data;
a null text has null ids. Rows with a null id are kept by the near-duplicate stage; rows that repeat an id stay or go together, but for
contamination, which is judged by id and text. Empty tables give empty results; without labels nothing is rejected that the
prior alone accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, jaccard, pieces, pii, quality
from docweave.llm.common import held_out, stage


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct, so that no column of ``docs`` meets one of a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), *more)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts (score 0.7 or more)."""
    learned = ~held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs.select("doc_id", "text").where(learned), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learned))
    scored = quality.with_statistics(_packed(docs), "row.text")
    return scored.where(model.column() >= 0.7).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles, the document with the smallest id."""
    linked = jaccard.linked(docs, jaccard.Likeness(5, 80, 100))
    extra = stage(linked.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("extra_id")).distinct(), "extra")
    own = _packed(docs)
    return own.join(extra, F.col("row.doc_id") == F.col("extra_id"), "left_anti").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_key=True)
    bad = stage(found.where("contaminated").select(F.col("key").alias("bad_key"), F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    own = _packed(docs, F.xxhash64("doc_id", "text").alias("own_key"))
    same = (F.col("own_key") == F.col("bad_key")) & F.col("row.doc_id").eqNullSafe(F.col("bad_id"))
    return own.join(bad, same, "left_anti").select("row.*")


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[kind]`` in place of personal data and secrets; n_chars follows the text."""
    model = pii.fit(docs.select("text"))
    found = pii.find(_packed(docs, F.coalesce("text", F.lit("")).alias("text")), model)
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, pii.redact(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(new["text"]).cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_ids of every document under merge-dropout."""
    return pieces.encode(docs, keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns), seed=7)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal),
    ("pieces", encode_pieces),
]

#: The classifier, the encoder and the redaction's model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
