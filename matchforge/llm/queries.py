"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, exact_dedup, language_id, line_quality, lm_scoring, minhash, mixing, oracle, packing, quality_classifier, quotes, sharding, url_templates
from .common import documents
from .tokenizers import path as tokenizer


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bloom_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_rules(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.label(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="max")


#: What the query allows and blocks.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=100, top=2000)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minmax_near_dedup, op2_quotation_linking, op3_kd_sharding, op4_bloom_lm_scoring, op5_source_mixing, op6_line_frequency_rules, op7_best_fit_packing, op8_language_id, op9_quality_classifier, op10_exact_dedup, op11_url_templates, op12_phrase_collocations, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": oracle.OP5_SQL, "op10_exact_dedup": oracle.OP10_SQL, "op11_url_templates": oracle.op11_sql(URL_RULES), "op12_phrase_collocations": oracle.OP12_SQL}
