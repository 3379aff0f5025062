"""Filters, order and merging of article lists.

Lists keep an order of their own: ``list_ord`` tells the lists apart, ``pos`` the rows in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

from .order import numbered

WEEK = 7 * 86400
# A fixed value: what counts as a price or a share off.
PRICE_OFF = rf"(?i)(?:\$[0-9][0-9,.]*|(?<![A-Za-z0-9_])[0-9]{{1,3}}%){T.BLANK}*(?:off|or less)(?![A-Za-z0-9_])"
KEEP, TEAMS, MARKS = 60, 50, 500


def title_and_description() -> Column:
    return F.concat_ws(" ", "title", "description")


def naming(articles: DataFrame, names: list[str]) -> DataFrame:
    """Articles that name one of the names as whole words."""
    return articles.where(T.contains_any(title_and_description(), names))


def naming_any(articles: DataFrame, names: DataFrame, by: str = "name") -> DataFrame:
    """The same for a table of names of any size: a name's longest word meets the words of texts by equi-join, then the names that were met are looked for.

    Each row stays as it is, whatever its link. Names without a letter or digit of ASCII match nothing.
    """
    wanted = T.keyed_names(names.select(F.col(by).alias("_name")), "_name").select("_name", "_word", "_pattern").distinct()
    key = T.text_key(title_and_description())
    rows = articles.withColumn("_key", key)
    named = rows.select("_key", F.explode(T.ascii_words(title_and_description())).alias("_word")).join(wanted, "_word").groupBy("_key").agg(F.collect_set("_pattern").alias("_patterns"))
    found = F.exists("_patterns", lambda p: F.rlike(title_and_description(), p))
    return rows.join(named, "_key").where(found).drop("_key", "_patterns")


def off_topic_reason(commerce=(), institutional=(), athletic=()) -> Column:
    """Why an article is off topic: commerce (a term, or a price or share off) in title or description, or institutional in an unathletic title; else null."""
    sells = lambda c: T.contains_any(c, list(commerce)) | F.coalesce(c, F.lit("")).rlike(PRICE_OFF)
    title, description = F.col("title"), F.col("description")
    return F.when(sells(title) | sells(description), F.lit("commerce")).when(
        T.contains_any(title, list(institutional)) & ~T.contains_any(title, list(athletic)), F.lit("institutional")
    )


def other_sport(own: str, sports: dict) -> Column:
    """The first other sport an article is about, if its title and link don't have a term of its own; else null."""
    if own not in sports:
        return F.lit(None).cast("string")
    url = T.plain_url(F.coalesce("link", F.lit("")))
    hit = lambda sport: T.contains_any(F.col("title"), list(sports[sport])) | T.contains_any(url, list(sports[sport]))
    out = F.lit(None).cast("string")
    for sport in reversed([s for s in sports if s != own]):
        out = F.when(hit(sport), F.lit(sport)).otherwise(out)
    return F.when(F.trim(F.coalesce("title", F.lit(""))) == "", None).when(hit(own), None).otherwise(out)


def relevant(own_sport: Column, keep_multiple: bool = True) -> Column:
    """What a verdict says of an article: no verdict keeps, other kinds drop, a sport must be the own one."""
    kind, sport = F.col("verdict.kind"), F.col("verdict.sport")
    return F.when(F.col("verdict").isNull(), True).when(kind != "news", False).when(sport == "none", True).when(
        sport == "multiple", F.lit(keep_multiple)
    ).when(sport == "other", False).otherwise(F.coalesce(sport == own_sport, F.lit(True)))


def within_week(at: Column, now: Column) -> Column:
    return at.isNull() | (F.unix_micros(now) - F.unix_micros(at) <= WEEK * 1_000_000)


def expired(published: Column, first_seen: Column, now: Column) -> Column:
    at = F.coalesce(published, first_seen)
    return at.isNull() | (F.unix_micros(now) - F.unix_micros(at) > WEEK * 1_000_000)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published"), F.asc("list_ord"), F.asc("pos")]


def first_of_each(articles: DataFrame, key: str = "link") -> DataFrame:
    """The first row of each link in list order."""
    order = Window.partitionBy(key).orderBy("list_ord", "pos")
    return articles.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def union_lists(lists: list[DataFrame]) -> DataFrame:
    out = None
    for i, rows in enumerate(lists):
        rows = rows.withColumn("list_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def credited(articles: DataFrame) -> DataFrame:
    """Items that name another outlet are credited to it and lose the tier; reach and scope stay, or get defaults."""
    other = F.col("item_source").isNotNull() & (F.lower("item_source") != F.lower("source"))
    scope = F.coalesce("scope", F.lit("broad"))
    reach = F.coalesce("reach", F.when(F.col("scope") == "team", F.lit("beat")).otherwise(F.lit("national")))
    return articles.withColumns(
        {
            "tier": F.when(other, F.lit(0)).otherwise(F.col("tier")), "reach": reach, "scope": scope,
            "source": F.when(other, F.col("item_source")).otherwise(F.col("source"))
        }
    )


def with_verdicts(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """articles with a struct ``verdict`` or null; verdicts: key of the title, kind, sport, claim."""
    keyed = articles.withColumn("_key", T.cache_key(F.col("title")))
    table = verdicts.select(F.col("key").alias("_key"), F.struct("kind", "sport", "claim").alias("verdict"))
    return keyed.join(table, "_key", "left").drop("_key")


def unanswered(articles: DataFrame, verdicts: DataFrame, size: int = 100) -> DataFrame:
    """Titles without a verdict, in batches; titles are cut at 500 characters."""
    misses = articles.select(T.cache_key(F.col("title")).alias("key"), F.substring("title", 1, 500).alias("title")).join(verdicts, "key", "left_anti")
    misses = misses.groupBy("key").agg(F.min("title").alias("title"))
    return numbered(misses, F.asc("key")).withColumn("batch", F.floor(F.col("rank") / size)).drop("rank")


def answered(articles: DataFrame, verdicts: DataFrame, calls_left: int, size: int = 100) -> DataFrame:
    """unanswered() with degraded: true for batches beyond the calls that are left, which get no verdict."""
    return unanswered(articles, verdicts, size).withColumn("degraded", F.col("batch") >= calls_left)


def merged_with_stored(fresh: DataFrame, stored: DataFrame, now: Column, keep: int = KEEP) -> DataFrame:
    """The rolling store of a team: fresh rows win and keep when they were first seen, stored ones last a week.

    Rows get rn, their rank by date in their team; those up to ``keep`` make the next store.
    """
    seen = stored.select("team", "link", F.col("first_seen").alias("_seen"))
    new = fresh.join(seen, ["team", "link"], "left").withColumn("first_seen", F.coalesce("_seen", now)).drop("_seen")
    old = stored.join(fresh.select("team", "link"), ["team", "link"], "left_anti").where(~expired(F.col("published"), F.col("first_seen"), now))
    order = Window.partitionBy("team").orderBy(F.desc_nulls_last("published"), "link")
    return new.unionByName(old.select(*new.columns)).withColumn("rn", F.row_number().over(order))


def next_store(merged: DataFrame, keep: int = KEEP) -> DataFrame:
    return merged.where(F.col("rn") <= keep).withColumn("description", T.truncated(F.col("description")))


def least_recent(uses: DataFrame, key: str = "team", keep: int = TEAMS) -> DataFrame:
    """Each key with its last use, and whether it falls out of the ``keep`` used last, which are broadcast."""
    last = uses.groupBy(key).agg(F.max("used_at").alias("last_used_at"))
    stay = last.orderBy(F.desc("last_used_at"), key).limit(keep).select(key, F.lit(False).alias("evicted"))
    return last.join(F.broadcast(stay), key, "left").withColumn("evicted", F.coalesce("evicted", F.lit(True)))


def read_marks(marks: DataFrame, now: Column, keep: int = MARKS) -> DataFrame:
    """One mark per link, the latest, of the last week, the newest of them."""
    latest = marks.groupBy("link").agg(F.max("read_at").alias("read_at")).where(F.col("read_at").isNotNull() & within_week(F.col("read_at"), now))
    return latest.orderBy(F.desc("read_at"), "link").limit(keep)


def split_brief(articles: DataFrame, marks: DataFrame) -> DataFrame:
    """articles with their section, unread or read."""
    return articles.join(
        marks.select("link", F.lit(True).alias("_read")).distinct(), "link", "left"
    ).withColumn("section", F.when(F.col("_read"), F.lit("read")).otherwise(F.lit("unread"))).drop("_read")


def brief_end(sections: DataFrame) -> DataFrame:
    """The closing line for the counts of a brief."""
    counts = sections.agg(F.count_if(F.col("section") == "unread").alias("unread"), F.count_if(F.col("section") == "read").alias("read"))
    line = F.when(
        F.col("unread") + F.col("read") == 0, F.lit("Nothing here yet")
    ).when(F.col("unread") == 0, F.lit("All read")).otherwise(F.concat(F.lit("That was all: "), F.col("unread").cast("string"), F.lit(" new")))
    return counts.withColumn("title", line)


def coverage(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Configured sources, and how many of them contribute to a final list."""
    return sources.select("name").distinct().join(
        articles.select(F.col("source").alias("name"), F.lit(1).alias("_hit")).distinct(), "name", "left"
    ).agg(F.count("*").alias("configured"), F.count("_hit").alias("contributing"))


def balanced(articles: DataFrame, window: int = 5, most: int = 2) -> DataFrame:
    """Greedy order in which no source has more than ``most`` of the last ``window`` outputs and the next, where that can be; feeds of at most ``window`` keep theirs.

    A fold over one feed at a time (column ``feed``), for feeds of bounded length. Off in pipelines by default.
    """
    import heapq
    from collections import deque

    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) <= window:  # short feeds stay as they are
            rows = rows.sort_values(["list_ord", "pos"])
            return rows.assign(rank=range(len(rows)))
        queues, out = {}, []
        for i, r in enumerate(rows.sort_values(["list_ord", "pos"]).to_dict("records")):
            queues.setdefault(r["source"], deque()).append((i, r))
        heads = [(q[0][0], source) for source, q in queues.items()]  # in order, so a heap; places differ
        while heads:
            recent, held = [r["source"] for r in out[-window:]], []
            while heads and recent.count(heads[0][1]) >= most:
                held.append(heapq.heappop(heads))
            _, source = heapq.heappop(heads) if heads else held.pop(0)
            out.append(queues[source].popleft()[1])
            if queues[source]:
                held.append((queues[source][0][0], source))
            for head in held:
                heapq.heappush(heads, head)
        return pd.DataFrame([r | {"rank": i} for i, r in enumerate(out)], columns=[*rows.columns, "rank"])

    schema = articles.withColumn("rank", F.lit(0)).schema
    return articles.groupBy("feed").applyInPandas(fold, schema)


def sample_titles(articles: DataFrame) -> DataFrame:
    """The first tenth of a list, rounded up, at most five."""
    everything = Window.partitionBy("feed")
    n = F.row_number().over(Window.partitionBy("feed").orderBy("list_ord", "pos"))
    return articles.withColumns({"_n": n, "_all": F.count("*").over(everything)}).where(F.col("_n") <= F.least(F.lit(5), F.ceil(F.col("_all") * 0.1))).drop("_n", "_all")


def toggled(keys: Column, key: Column) -> Column:
    """A set of keys with one added if it is absent, taken out if it is there."""
    return F.when(F.array_contains(keys, key), F.array_remove(keys, key)).otherwise(F.array_append(keys, key))


def rejected(before: DataFrame, after: DataFrame, key: str = "link") -> DataFrame:
    """What a filter took out: the rows of before whose link isn't in after."""
    return before.join(after.select(key).distinct(), key, "left_anti")


def team_pool(
    groups: list[tuple[DataFrame, list[str] | None]], own_sport: str, verdicts: DataFrame | None = None, off_topic: Column | None = None,
    sports: dict | None = None
) -> DataFrame:
    """The pool of a team: groups of articles, each with the names that one must have (None: taken whole), in order.

    First by link, on topic, of the own sport, not dropped by a verdict; sorted by newest_first() for the reader.
    """
    lists = [rows if names is None else naming(rows, names) for rows, names in groups]
    reason = off_topic_reason() if off_topic is None else off_topic
    pool = first_of_each(union_lists(lists)).where(reason.isNull()).where(other_sport(own_sport, sports or {}).isNull())
    if verdicts is None:
        return pool
    return with_verdicts(pool, verdicts).where(relevant(F.lit(own_sport))).drop("verdict")


def pool_groups(news: DataFrame, sites: DataFrame, local: DataFrame, national: DataFrame, names: list[str], nicknames: list[str]) -> list[tuple[DataFrame, list[str] | None]]:
    """The four groups of a team's pool in order: its news by name, its own sites whole, local sources by name and nickname, the national pool by name."""
    return [(news, names), (sites, None), (local, names + nicknames), (national, names)]


def national_pool(feeds: DataFrame, news: DataFrame) -> DataFrame:
    """Feeds before JSON news, each link once."""
    return first_of_each(union_lists([feeds, news]))


def multi_team_feed(pools: list[tuple[dict, DataFrame]]) -> DataFrame:
    """The pools of several teams (team_id, team_name, league_id), each story once, credited to the team listed first."""
    tagged = [rows.withColumns({k: F.lit(team[k]) for k in ("team_id", "team_name", "league_id")}) for team, rows in pools]
    return first_of_each(union_lists(tagged))
