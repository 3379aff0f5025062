"""The driver's tables in the shapes of the domain; the SQL twins build the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-08 08:00:00"

#: CTEs for the SQL twins. Pages of text are articles, users are games, their events are plays.
SQL_ARTICLES = """a AS (
  SELECT 'doc:' || doc_id AS link, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description,
         source, (doc_id % 4)::INT AS tier, CASE WHEN doc_id % 3 = 0 THEN 'team' ELSE 'broad' END AS scope, 'team' || (doc_id % 10) AS team,
         CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS published, doc_id AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
)"""
#: Pages as articles of no date, to have rows that another list lacks.
SQL_PAGES = "pg AS (SELECT 'page:' || page_id AS link, 'team' || (page_id % 10) AS team, page_id AS pos FROM pages WHERE page_id IS NOT NULL)"
SQL_PLAYS = """p AS (
  SELECT user_id AS game_id, event_id AS play_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS type,
         CASE WHEN event_id % 5 <> 0 THEN least(greatest(value / 200, 0), 1) END AS home_win_pct, floor(value / 10)::INT AS points
  FROM events
)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, with nothing cut: the title is the first line, the description all the rest."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return d.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("link"),
        title.alias("title"),
        F.substring("text", F.length(title) + 2, F.length("text")).alias("description"),
        "source",
        (F.col("doc_id") % 4).cast("int").alias("tier"),
        F.when(F.col("doc_id") % 3 == 0, "team").otherwise("broad").alias("scope"),
        F.concat(F.lit("team"), (F.col("doc_id") % 10).cast("string")).alias("team"),
        F.when(F.col("doc_id") % 17 != 0, at).alias("published"),
        F.col("doc_id").alias("pos"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles of no date: link, team, pos, published."""
    p = load(spark, sf_dir, "pages").where("page_id IS NOT NULL")
    link = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    return p.select(
        link.alias("link"),
        F.concat(F.lit("team"), (F.col("page_id") % 10).cast("string")).alias("team"), F.col("page_id").alias("pos"),
        F.lit(None).cast("timestamp_ntz").alias("published")
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("game_id"), F.col("event_id").alias("play_id"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("type"),
        F.when(F.col("event_id") % 5 != 0, F.least(F.greatest(F.col("value") / 200, F.lit(0.0)), F.lit(1.0))).alias("home_win_pct"), F.floor(F.col("value") / 10).cast("int").alias("points"),
    )
