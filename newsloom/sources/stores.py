"""Stores: partitioned tables that are replaced by partition, small keyed tables, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import migrated_favorites
from newsloom.operators.articles import next_store, read_marks
from newsloom.shared import stored


def write_teams(merged: DataFrame, path: str) -> None:
    """The next store of each team in the merged rows; other teams' partitions stay."""
    next_store(merged).drop("rn").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("team").parquet(path)


def clear(spark: SparkSession, path: str) -> int:
    """Empties a store; returns how many rows it had."""
    rows = spark.read.parquet(path)
    n, schema = rows.count(), rows.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def upserted(table: DataFrame, changes: DataFrame, key: str, at: str = "at") -> DataFrame:
    """A keyed table with changes: the latest row of each key, of equal times the change, of several any one, but the same each time."""
    both = table.select(*changes.columns, F.lit(0).alias("_new")).unionByName(changes.withColumn("_new", F.lit(1)))
    latest = F.max_by(F.struct(*changes.columns), F.struct(F.col(at).isNotNull(), at, "_new", F.xxhash64(*changes.columns))).alias("r")
    return both.groupBy(key).agg(latest).select("r.*")


def unexpired(cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return cache.where(F.unix_seconds(now) - F.unix_seconds("at") < days * 86400)


def status_report(status: DataFrame) -> DataFrame:
    """Lines of a feed-status report, the failing ones first, then the totals."""
    line = F.format_string("%-6s %-8s %5d items %6d ms  %s", "status", F.coalesce("format", F.lit("-")), "items", F.col("ms").cast("int"), "url")
    rows = status.select(F.when(F.col("status") == "OK", 1).otherwise(0).alias("ord"), line.alias("line"))
    totals = status.agg(
        F.lit(2).alias("ord"),
        F.format_string(
            "%d passing, %d failing, %d slow", F.count_if(F.col("status") == "OK"), F.count_if(F.col("status") != "OK"), F.count_if("slow")
        ).alias("line")
    )
    return rows.unionByName(totals)


def write_report(rows: DataFrame, path: str, lines: str | None = None) -> None:
    """A report as JSON, or as text: the lines of a column in the order of ord, in one file, as reports are short."""
    if lines is None:
        rows.write.mode("overwrite").json(path)
    else:
        rows.orderBy("ord", lines).select(lines).coalesce(1).write.mode("overwrite").text(path)


def write_logs(shaped: DataFrame, raw: DataFrame, path: str, since: Column, until: Column) -> None:
    """A window of logs, shaped rows with their raw form, as JSON; both have at, raw has event."""
    within = lambda rows: rows.where((F.col("at") >= since) & (F.col("at") < until))
    row = lambda rows, kind, value: within(rows).select("at", F.lit(kind).alias("kind"), value.alias("row"))
    both = row(shaped, "shaped", F.to_json(F.struct(*shaped.columns))).unionByName(row(raw, "raw", F.col("event")))
    both.write.mode("overwrite").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """Rows, which may come from what the path holds, in its place."""
    stored(rows, "replace").write.mode("overwrite").parquet(path)


def write_keyed(changes: DataFrame, path: str, key: str, at: str = "at") -> None:
    """Changes merged by key into the table at the path, which must exist."""
    replace(upserted(changes.sparkSession.read.parquet(path), changes, key, at), path)


def write_marks(marks: DataFrame, path: str, now: Column) -> None:
    """Read marks merged by link into those at the path: the latest of each, of the last week, the newest of them."""
    known = marks.sparkSession.read.parquet(path)
    replace(read_marks(known.unionByName(marks.select(*known.columns)), now), path)


def hydrated_favorites(store: DataFrame, fallback_league: str) -> DataFrame:
    """A store of favourites (owner, entries) with entries migrated to keys, and whether the owner has been through onboarding, which a first favourite tells."""
    keys = migrated_favorites(F.col("entries"), fallback_league)
    return store.withColumn("entries", keys).withColumn("onboarded", F.size("entries") > 0)
