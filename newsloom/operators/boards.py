"""Leader boards and rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 3


def surname(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), " "), -1))


def with_surname_safety(roster: DataFrame) -> DataFrame:
    """roster with matches_surname: one player of the team bears the surname (last_name, or the last word of full_name)."""
    name = F.lower("last_name") if "last_name" in roster.columns else surname(F.col("full_name"))
    bearers = F.count("*").over(Window.partitionBy("team_id", name))
    return roster.withColumn("matches_surname", bearers == 1)


def leader_boards(leaders: DataFrame, roster: DataFrame, categories: list[str] | None = None, top: int = TOP) -> DataFrame:
    """Leaders on the roster, the first ``top`` of each category after the join; board is the category's place in the order given,
    else in the order of its best rank and then of the list (column pos). leaders: team_id, category, title, athlete_id, rank, pos."""
    players = with_surname_safety(roster).select("team_id", F.col("id").alias("athlete_id"), "full_name", "matches_surname")
    if categories is not None:
        named = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
        rows = leaders.where(F.col("category").isin(categories)).withColumn("board", named)
    else:
        first = leaders.groupBy("team_id", "category").agg(F.min(F.struct("rank", "pos")).alias("_first"))
        order = Window.partitionBy("team_id").orderBy("_first", "category")
        rows = leaders.join(first.withColumn("board", F.row_number().over(order).cast("long")).drop("_first"), ["team_id", "category"])
    place = F.row_number().over(Window.partitionBy("team_id", "category").orderBy("rank", "pos", "athlete_id"))
    rows = rows.join(players, ["team_id", "athlete_id"]).withColumn("place", place).where(F.col("place") <= top)
    return rows.withColumn("title", F.regexp_replace("title", " Leader$", ""))


def stat_rows(categories: DataFrame) -> DataFrame:
    """Labels zipped with values, a dash where a value is missing; categories without a signal dropped."""
    kept = categories.where(F.exists("values", lambda v: F.trim(v).rlike("[^0.,:\\s-]")))
    pairs = kept.select("*", F.posexplode(F.arrays_zip("labels", "values")).alias("pos", "_p"))
    return pairs.withColumns({"label": F.col("_p.labels"), "value": F.coalesce(F.nullif("_p.values", F.lit("")), F.lit("-"))}).drop("_p")
