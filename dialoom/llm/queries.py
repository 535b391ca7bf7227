"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import chat, decontaminate, html_text, language_model, licenses, media, neardup, packing, quality, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's tree; those whose first line names a licence are licence files."""
    files = table(spark, sf_dir, "documents").select("doc_id", licenses.document_path().alias("path"), "text")
    gives = F.contains(F.lower(F.substring_index("text", "\n", 1)), F.lit("licens"))
    return licenses.scan_licenses(files, keep=("doc_id",), licence_file=gives)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_to_media(table(spark, sf_dir, "documents"))
    read = media.decode_media(stored, keep=("doc_id", "n_bytes", "payload_bytes"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "pixels", "method", "error")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = spark.createDataFrame(chat.FORGED, said.schema)
    return chat.digest(chat.format_turns(said.union(forged)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_media_columns": op2_media_columns,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_minhash_near_duplicates": op8_minhash_near_duplicates,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_html_extraction": op10_html_extraction,
}

ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
}
