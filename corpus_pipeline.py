"""Documents to a training mix: quality, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. A stage's result is written as Parquet in the folder that all
executors share, and read back as the next one's docs; a stage's folder goes when the next is written.

Documents of null id, null, empty and long texts take part in every stage. Of repeated rows one stays, and
of equal copies the first by id, then by the other columns. Columns of documents that are named like an
operator's own keep their values. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm import decontam, jaccard_join, mixing, pii, quality
from quillmesh.llm.util import delete, shared_dir, table

#: SQL can't express the fitted stages; tests hold the stages against brute force.
ORACLE_SQL = None


def apart(docs: DataFrame, stage, *needed: str) -> DataFrame:
    """stage(docs) with docs' columns; those it does not need stand aside under names that no operator has."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = stage(docs.withColumnsRenamed(names))
    return out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = table(spark, sf_dir, "labels")
    return apart(docs, lambda d: quality.classify(d, labels).filter("keep"), "doc_id", "text", "lang", "source")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group that near-duplicate links hold together."""
    return apart(docs, _one_of_each, "doc_id", "text")


def _one_of_each(docs: DataFrame) -> DataFrame:
    # a key for each id and text, so that only links hold rows together; null ids go by their text
    ident = F.coalesce(F.col("doc_id"), -F.abs(F.xxhash64("text") / 2).cast("long") - 1)
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    groups = jaccard_join.near_groups(keyed, ident="_key").select(F.col("doc_id").alias("_key"), "component_id")
    groups = groups.groupBy("_key").agg(F.min("component_id").alias("component_id"), F.count("*").alias("_rows"))
    ids = keyed.groupBy("_key").agg(F.min(ident).alias("_id"))
    least = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("_id", "_key", "_rows")).alias("s"))
    kept = keyed.join(least.select("s._key", "s._rows"), "_key")
    once = kept.filter("_rows = 1").select(*docs.columns)
    # repeated rows: the first stays
    w = Window.partitionBy("_key").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    again = kept.filter("_rows > 1").withColumn("_row", F.row_number().over(w)).filter("_row = 1").select(*docs.columns)
    return once.unionByName(again)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    items = table(spark, sf_dir, "benchmark")
    return apart(docs, lambda d: decontam.decontaminate(d, items).filter(F.size("hits") == 0), "text")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    masked = apart(docs, pii.mask, "text")
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: an entry a row, in order of virtual finish time."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
