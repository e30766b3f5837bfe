"""The registered queries of this subpackage: each reads its whole table, applies its operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwork.llm import oracles, quality
from meshwork.llm.ann import ann
from meshwork.llm.exact_topk import exact_topk
from meshwork.llm.fit_packing import fit_pack
from meshwork.llm.jaccard_join import jaccard_join
from meshwork.llm.license_scan import license_scan
from meshwork.llm.mixing import mix_sources
from meshwork.llm.packing import pack
from meshwork.llm.rlz_dedup import rlz_dedup
from meshwork.llm.spelling import spelling_variants
from meshwork.llm.suffix_dedup import suffix_dedup
from meshwork.llm.url_filter import url_filter
from meshwork.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Ordinal | None:
    ratings = table(spark, sf_dir, "labels")
    return quality.fit(docs, ratings.withColumn("grade", quality.grade_of(F.col("quality"), F.col("toxic"))))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, fitted(spark, docs, sf_dir))
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), "keep")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann(vectors, vectors.where("vec_id % 20 = 0"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_pack(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_license_scan,
        op3_quality,
        op4_suffix_dedup,
        op5_url_filter,
        op6_jaccard_join,
        op7_rlz_dedup,
        op8_mix_sources,
        op9_exact_topk,
        op10_ann,
        op11_whitening,
        op12_fit_packing,
        op13_spelling,
    )
}
#: op4 is left out: DuckDB needs minutes for all 200-byte windows of the small tables. It is tested against a plain version, as are op11 (eigenvectors) and
#: op12 (a tokenizer).
ORACLE: dict[str, str] = {"op5_url_filter": oracles.OP5, "op6_jaccard_join": oracles.OP6, "op7_rlz_dedup": oracles.OP7, "op9_exact_topk": oracles.OP9, "op13_spelling": oracles.OP13}
