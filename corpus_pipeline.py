"""A corpus pipeline of operators of the llm subpackage: each stage's rows are written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, minhash, mixing, pii, quality
from tessella.llm.shared import delete, materialize, watched


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and wordless texts go. Rows are judged by their texts alone, so that ties and repeats are treated alike."""
    return quality.good_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates, null ids last; of rows that repeat it, one."""
    return minhash.distinct_documents(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table benchmark; each row is judged by its own text, and null texts hold none."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, and repeated rows stay repeated."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, numbered by `copy`; a null source is a source, and each row counts by itself."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_dedup", distinct),
    ("decontamination", uncontaminated),
    ("personal_data", redacted),
    ("mixing", mixed),
]

#: SQL has no expectation-maximisation, so the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents of sf_dir; a stage's tables are deleted when its result is written. An empty table gives an empty result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with watched() as paths:
            docs = materialize(stage(spark, docs, sf_dir), name)
        for path in [*paths[:-1], *([before] if before else [])]:
            delete(spark, path)
        before = paths[-1]
    return docs
