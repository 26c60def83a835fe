"""The queries opN_<name>: each operator over its whole table with production parameters, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellwise.llm import oracles
from cellwise.llm.common import table
from cellwise.llm.decontamination import overlap_report
from cellwise.llm.html_text import extract_pages
from cellwise.llm.licenses import scan_licenses, scan_sql
from cellwise.llm.media import media_features, text_media
from cellwise.llm.packing import pack
from cellwise.llm.pii import replace_pii
from cellwise.llm.quality import score
from cellwise.llm.sharding import assign_shards
from cellwise.llm.simhash import near_duplicates
from cellwise.llm.substring_dedup import remove_repeats


#: For tests; surrogates are as secret as their key.
PII_KEY = "surrogates-of-the-queries"


def pii_key(spark: SparkSession) -> str:
    """The session's spark.cellwise.pii.key, which a production run sets."""
    return spark.conf.get("spark.cellwise.pii.key", PII_KEY)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_media(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents", "doc_id", "text"), pii_key(spark), count="n_replaced").select("doc_id", "n_replaced", "text")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_sharding": op3_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_license_scans": op5_license_scans,
    "op6_media_columns": op6_media_columns,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pii": op8_pii,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": oracles.DECONTAMINATION,
    "op3_sharding": oracles.SHARDING,
    "op5_license_scans": scan_sql(),
}
