"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.

In every stage null and empty texts are texts like others: they score as low as the worst text of the classifier's
sample, are one group of copies, have no passage and no token.  Long texts are worked on whole, an empty table gives an
empty one, columns beyond those of documents pass through whatever their names (but for the last stage's, which are its
own), and rows with a null doc_id are no one's copies.  Of rows that repeat a doc_id the one whose text is least in
order stays from near-dedup on.  Mixing repeats a document for each epoch that takes it; encoding codes it once and
tells its rows apart by epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairway.llm import bpe, common, mixing, neardup, quality, substring


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without a label too, by their score."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by five-word shingles at a similarity of 0.8 the document of smallest id stays."""
    return neardup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat one of a document of smaller id are cut out; what is nothing else goes."""
    return substring.cut_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are chosen so that domains, languages and sources meet their weights."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their digests; rows that mixing repeats are coded once and numbered by epoch."""
    once = docs.groupBy("doc_id", "lang", "source", "text").agg(F.count("*").cast("int").alias("epochs"))
    coded = bpe.encode(once).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    return coded.select("doc_id", "lang", "source", "epoch", F.size("token_ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("token_ids")).alias("ids_sha256"), "token_ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("BPE encoding", encoding_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    path = common.fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
