"""The corpus pipeline: documents in, packed training sequences out. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm.common import documents, remove_folder, table, written
from strataspark.llm.exact_dedup import drop_exact_copies
from strataspark.llm.packing import pack
from strataspark.llm.pii import sanitise
from strataspark.llm.quality_rules import keep_good
from strataspark.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder as Parquet and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs


#: Quality rules, near copies and packing are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
