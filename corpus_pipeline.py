"""Corpus pipeline: quality, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. ``run`` writes every stage as Parquet into the shared folder and
reads it back as the next stage's input.

Defined results: a null or empty text is scored like any other, is no near copy of another text than an empty one, and holds no leak and no
secret. Rows go by their text, never by id, so null and repeated ids and repeated rows change nothing; of equal or near-equal texts
one row stays, the one of the smallest id, and of rows equal in that one of them. Whole texts of any length are read. An empty table passes every
stage empty. Extra columns stay until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cragline.llm import chosen_path, common, contamination, packing, quality_rules, secret_scan

REJECT_BELOW = 0.5  #: quality score under which a document goes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble scores under REJECT_BELOW."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), REJECT_BELOW)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near copies the document with the smallest id."""
    return chosen_path.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that are not widely copied examples, and counts the characters anew."""
    clean = secret_scan.redact(docs, repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training bins."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("packed", packed)]

ORACLE_SQL = None  # scores, trees of links and packing are not SQL; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
