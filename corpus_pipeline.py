"""From raw documents to packed batches: STAGES, each a function (spark, docs, sf_dir) -> DataFrame.

Each stage works on all that the one before kept. All but the last return the columns of documents; the last returns the
place of each piece of text in a batch. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwork.llm import quality
from meshwork.llm.jaccard_join import keep_first
from meshwork.llm.mixing import mix_sources
from meshwork.llm.packing import pack
from meshwork.llm.queries import fitted, table
from meshwork.llm.rlz_dedup import rlz_dedup
from meshwork.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier doesn't reject; it is fitted on a bounded sample of the labelled ones."""
    return quality.classify(docs, fitted(spark, docs, sf_dir)).where("keep").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return keep_first(docs).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in documents of smaller id; texts that lose nothing stay as they are, texts
    that lose all go."""
    out = rlz_dedup(docs.select(*docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    out = mix_sources(docs).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeated_passages),
    ("mixing sources", mixed),
    ("packing", packed),
]
#: SQL can't express the fitted model, the sampling hash and the packing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.split()[0])
    return docs
