"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.shared import scratch, shared_path, stored  # noqa: F401  (the operators take them from here)

#: Words of the contracts: maximal runs of anything but space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unused(name: str, columns: list[str]) -> str:
    """A name for a column of one's own: name, with as many underscores before it as no column of the caller's has; case doesn't count."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column, start: Column) -> Column:
    return F.aggregate(numbers, start, lambda acc, x: acc + x)
