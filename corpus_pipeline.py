"""The corpus pipeline: documents in, a clean mix of them out.

Each stage applies one operator of newsloom.llm to all that the stage before has kept; its
result is written to the shared folder as Parquet and read again by the next. Stages 1 to
4 return the columns of ``documents``, the last one too, with rows as often as the mix
takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, mixing, near_dedup, quality_rules, secret_scan
from newsloom.llm.common import scratch, shared_path, table


def whole(docs: DataFrame, *columns: str):
    """The columns that an operator reads, beside the whole row, so that names it computes can't clash with the caller's."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    trusted = quality_rules.trusted_of(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(whole(docs, "doc_id", "text"), trusted).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources get their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("mixing", mixture),
]
#: SQL has no consistent weighted sampling nor banded alignment; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):  # what the stage writes for itself is gone when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
