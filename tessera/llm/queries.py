"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, licences, minhash, packing, quality, resampling, spotsigs, substring, toxicity, urls
from tessera.llm.common import documents
from tessera.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op7_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 3, 0.85)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


def spotsigs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of op10 compared: partitions by length, pruned Jaccard."""
    return spotsigs.near_classes(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_substring, op4_urls, op5_bpe, op6_quality, op7_resampling, op8_licences, op9_minhash, op10_fingerprints, spotsigs_near)}
