"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.chat import perspectives

    return perspectives(_table(spark, sf_dir, "conversations"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.audio import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import private_spans, span_digests

    return span_digests(private_spans(_table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontaminate import decontamination

    return decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_legacy_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.langid import languages

    return languages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_minhash_near_dedup,
        op2_source_mixing,
        op3_chat_perspectives,
        op4_substring_dedup,
        op5_telephony_audio,
        op6_personal_data,
        op7_quality_classifier,
        op8_benchmark_decontamination,
        op9_legacy_archive,
        op10_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in queries() if (sql := getattr(oracle, name.upper(), None))}
