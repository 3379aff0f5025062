"""Streams that keep tables: the rolling store of articles as a sink that a replayed batch leaves as it is, and counters whose state goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.articles import KEEP, TEAMS, least_recent, merged_with_stored, next_store
from newsloom.sources import versions


def merge_into(path: str, keep: int = KEEP, uses: DataFrame | None = None, teams: int = TEAMS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges arrivals (team, link, published, seen_at, description and more) into the versions of a rolling store at the path.

    A batch makes the version of its own id, whole or not at all: one that is replayed after its commit changes nothing, one that died before it is
    made again from the version before. The batch's latest seen_at is its now, so that a replay comes to the same rows. Of several arrivals of a link in a batch the
    last counts; those without a team, link or seen_at don't. uses (team, used_at): all but the ``teams`` teams used last leave the store. A version has at
    most ``keep`` rows a team, so what is written grows with the teams, not with the arrivals. Without arrivals there is no version.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions.committed(spark, path)
        if known and batch_id <= known[-1]:
            return
        told = batch.where("team IS NOT NULL AND link IS NOT NULL AND seen_at IS NOT NULL")
        now = told.agg(F.max("seen_at")).first()[0]
        if now is None:
            return
        last = F.max_by(F.struct(*told.columns), F.struct("seen_at", F.xxhash64(*told.columns))).alias("r")
        fresh = told.groupBy("team", "link").agg(last).select("r.*").drop("seen_at")
        held = versions.read(spark, path)
        if held is None:
            held = fresh.withColumn("first_seen", F.lit(now)).limit(0)
        rows = next_store(merged_with_stored(fresh, held, F.lit(now), keep), keep).drop("rn")
        if uses is not None:
            rows = rows.join(least_recent(uses, keep=teams).where("evicted").select("team"), "team", "left_anti")
        versions.publish(rows, path, batch_id)
        versions.pruned(spark, path)

    return merge


def daily_calls(calls: DataFrame, late: str = "2 days") -> DataFrame:
    """day, prefix, calls: how many calls (at, prefix, n) there were on each UTC day; a day's state goes when it is ``late`` behind. Calls without a time don't count, without n as one."""
    day = F.window("at", "1 day")
    counted = calls.withWatermark("at", late).groupBy(day, "prefix").agg(F.sum(F.coalesce("n", F.lit(1))).alias("calls"))
    return counted.select(F.to_date("window.start").alias("day"), "prefix", "calls")


def within_cap(requests: DataFrame, counts: DataFrame, caps: DataFrame) -> DataFrame:
    """requests (prefix, at) with allowed: whether their day's count is below the cap of their prefix. A request without a count or a cap is allowed.

    counts: day, prefix, calls, of which the largest of a day counts, as a stream in update mode leaves several. caps: prefix, cap.
    """
    top = counts.groupBy(F.col("day").alias("_day"), F.col("prefix").alias("_prefix")).agg(F.max("calls").alias("_calls"))
    most = caps.groupBy(F.col("prefix").alias("_p")).agg(F.max("cap").alias("_cap"))
    rows = requests.join(top, (F.to_date("at") == F.col("_day")) & (F.col("prefix") == F.col("_prefix")), "left").join(most, F.col("prefix") == F.col("_p"), "left")
    return rows.withColumn("allowed", F.coalesce(F.col("_calls") < F.col("_cap"), F.lit(True))).drop("_day", "_prefix", "_calls", "_p", "_cap")


def new_titles(arrivals: DataFrame, days: int = 90) -> DataFrame:
    """key, title, at: titles (at) that none of the ``days`` before has had, as a verdict lasts so long: each is asked about once, then again.

    State of a title goes when arrivals are ``days`` past it, and takes effect a trigger later; arrivals more than half of that behind the newest are left out.
    """
    rows = arrivals.where("title IS NOT NULL").select(T.cache_key(F.col("title")).alias("key"), F.substring("title", 1, 500).alias("title"), "at")
    return rows.withWatermark("at", f"{days * 12} hours").dropDuplicatesWithinWatermark(["key"])  # kept for the delay, counted from a watermark that is the delay behind
