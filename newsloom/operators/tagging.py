"""Which teams and players an article names.

Names of teams are a table of any size. A name meets the texts that have its longest word in an equi-join, so that an
article comes with the few names that it may hold; one fold over these, in order, looks for each and masks what it has found
before shorter ones are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

MOST_NAMES = 5000


def matchers(teams: list[dict]) -> list[dict]:
    """teams: league_id, team_id, short_name, names. By longest name, and within a team by length, longest first."""
    if sum(len(t["names"]) for t in teams) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    by_length = lambda names: sorted((n for n in names if n), key=lambda n: (-len(n), n))
    return sorted(({**t, "names": by_length(t["names"])} for t in teams if any(t["names"])), key=lambda t: (-len(t["names"][0]), t["league_id"], t["team_id"]))


def named_in(text: Column, teams: list[dict]) -> Column:
    """Indices into the matchers of the teams that a text names, in matcher order.

    One pattern of all names tells the texts that name none; the others go through a fold over the teams' patterns, which carries the
    text with what was found masked.
    """
    order = matchers(teams)
    if not order:
        return F.array().cast("array<int>")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(T.any_of(t["names"])).alias("p")) for i, t in enumerate(order)])
    begin = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        found = F.when(F.rlike(acc["rest"], t["p"]), F.array_append(acc["found"], t["i"])).otherwise(acc["found"])
        return F.struct(F.regexp_replace(acc["rest"], t["p"], F.lit("\u0001")).alias("rest"), found.alias("found"))

    some = T.contains_any(text, [n for t in order for n in t["names"]])
    return F.when(some, F.aggregate(steps, begin, step, lambda acc: acc["found"])).otherwise(F.array().cast("array<int>"))


def named_teams(teams: DataFrame) -> DataFrame:
    """_word, _name for each name of a table (league_id, team_id, short_name, name): the word it's met by, and its place in the order of
    matching (teams by longest name, a team's names by length), its pattern and its team."""
    rows = teams.where("name <> ''").select("league_id", "team_id", "short_name", "name").distinct()
    longest = rows.groupBy("league_id", "team_id").agg(F.max(F.length("name")).alias("_longest"))
    keyed = T.keyed_names(rows.join(longest, ["league_id", "team_id"]), "name")
    order = F.struct((-F.col("_longest")).alias("longest"), "league_id", "team_id", (-F.length("name")).alias("length"), "name")
    return keyed.select("_word", F.struct(order.alias("order"), F.col("_pattern").alias("pattern"), F.lower("name").alias("lower"), F.struct("league_id", "team_id", "short_name").alias("team")).alias("_name"))


def found_teams(text: Column, names: Column) -> Column:
    """The teams of the names (in order) that a text holds, each once, a name that was found being masked for those after it."""
    begin = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.filter(F.transform(names, lambda n: n["team"]), lambda _: F.lit(False)).alias("found"))

    def step(acc: Column, n: Column) -> Column:
        held = F.rlike(acc["rest"], n["pattern"])
        rest = F.when(held, F.regexp_replace(acc["rest"], n["pattern"], F.lit("\u0001"))).otherwise(acc["rest"])
        return F.struct(rest.alias("rest"), F.when(held, F.array_append(acc["found"], n["team"])).otherwise(acc["found"]).alias("found"))

    # names that aren't in the text at all need no pattern; the text is put in lower case once
    there = F.get(F.transform(F.array(F.lower(text)), lambda low: F.filter(names, lambda n: F.contains(low, n["lower"]))), F.lit(0))
    return F.array_distinct(F.aggregate(there, begin, step, lambda acc: acc["found"]))


def tagged(articles: DataFrame, teams: DataFrame | list[dict], preferred: tuple | None = None) -> DataFrame:
    """articles with mentioned_teams (title first, then description) and mentioned_team: the first, the
    preferred one first within a field, and the surfacing team of a team-scoped source if none is named.

    teams: a table of names (league_id, team_id, short_name, name), or a list of teams with their names.
    """
    if not isinstance(teams, DataFrame):
        listed = [(t["league_id"], t["team_id"], t["short_name"], n) for t in teams for n in t["names"]]
        teams = articles.sparkSession.createDataFrame(listed, "league_id string, team_id string, short_name string, name string")
    text = F.concat_ws(" ", "title", "description")
    rows = articles.withColumn("_key", T.text_key(text))
    met = rows.select("_key", F.explode(T.ascii_words(text)).alias("_word")).join(named_teams(teams), "_word")
    names = met.groupBy("_key").agg(F.array_sort(F.collect_set("_name")).alias("_names"))
    rows = rows.join(names, "_key", "left")
    none = F.filter(F.transform("_names", lambda n: n["team"]), lambda _: F.lit(False))
    of = lambda c: F.when(F.col("_names").isNotNull(), found_teams(F.coalesce(c, F.lit("")), F.col("_names")))
    rows = rows.withColumns({"_t": of("title"), "_d": of("description")})
    if preferred:
        is_it = lambda t: (t["league_id"] == preferred[0]) & (t["team_id"] == preferred[1])
        lead = lambda a: F.concat(F.filter(a, is_it), F.filter(a, lambda t: ~is_it(t)))
    else:
        lead = lambda a: a
    every = F.coalesce(F.array_distinct(F.concat(lead(F.col("_t")), lead(F.array_except("_d", "_t")))), none, F.array().cast("array<struct<league_id:string,team_id:string,short_name:string>>"))
    rows = rows.withColumn("mentioned_teams", every).withColumn("mentioned_team", F.get("mentioned_teams", F.lit(0)))
    if {"team_id", "league_id", "scope"} <= set(articles.columns):
        key = ["league_id", "team_id"]
        own = teams.where("name <> ''").groupBy(*key).agg(F.first("short_name").alias("short_name")).select(*key, F.struct(*key, "short_name").alias("_own"))
        rows = rows.join(own, key, "left").withColumn("mentioned_team", F.coalesce("mentioned_team", F.when(F.col("scope") == "team", F.col("_own"))))
    return rows.select(*[F.col(f"`{c}`") for c in articles.columns if c not in ("mentioned_teams", "mentioned_team")], "mentioned_teams", "mentioned_team")


def of_followed(articles: DataFrame, followed: DataFrame) -> DataFrame:
    """Articles that name no team, or a followed one (league_id, team_id)."""
    keys = followed.select(F.col("league_id").alias("_l"), F.col("team_id").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    named = F.col("mentioned_team")
    return articles.join(keys, (named["league_id"] == F.col("_l")) & (named["team_id"] == F.col("_t")), "left").where(named.isNull() | F.col("_hit")).drop("_l", "_t", "_hit")


def of_pools(articles: DataFrame, selected: DataFrame) -> DataFrame:
    """Articles that the pool of a selected team has brought up."""
    return articles.join(selected.select("league_id", "team_id").distinct(), ["league_id", "team_id"], "left_semi")


def player_matches(articles: DataFrame, players: DataFrame) -> DataFrame:
    """name, link, kind: full where the text has the full name, or first and last name where the table has these (first_name, last_name), surname
    where it has a surname of five letters or more that one player bears. A player with full matches keeps only those.

    Names meet texts by their last words in an equi-join, so players are not multiplied by articles; the whole name is then looked for.
    """
    text = F.concat_ws(" ", "title", "description")
    edge = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}']+", " ")), F.lit(" "))
    last_of = lambda c: F.element_at(F.split(F.trim(edge(c)), " "), -1)
    column = lambda c: F.col(c) if c in players.columns else F.lit(None).cast("string")
    roster = players.select(
        "name", column("first_name").alias("first"), F.coalesce(column("last_name"), F.element_at(F.split(T.trim_periods(F.col("name")), " "), -1)).alias("last")
    ).where("trim(name) <> ''").distinct()
    surname = F.lower(T.trim_periods(F.col("last")))
    bearers = roster.groupBy(surname.alias("surname")).agg(F.count_distinct("name").alias("bearers"))
    roster = roster.withColumn("surname", surname).join(bearers, "surname")
    forms = F.array(
        F.struct(F.lit("full").alias("kind"), F.col("name").alias("form")),
        F.struct(F.lit("full").alias("kind"), F.when(F.trim("first") != "", F.concat_ws(" ", "first", "last")).alias("form")),
        F.struct(F.lit("surname").alias("kind"), F.when((F.length("surname") >= 5) & (F.col("bearers") == 1), F.col("last")).alias("form")),
    )
    wanted = roster.select("name", F.explode(forms).alias("f")).where("f.form IS NOT NULL").select("name", "f.kind", edge(T.trim_periods(F.col("f.form"))).alias("padded"))
    wanted = wanted.withColumn("word", last_of(F.col("padded"))).where("word <> ''").distinct()
    # a text isn't copied for each of its words: words carry its key, and what they hit fetches it again
    key = T.text_key(text).alias("key")
    words = F.array_distinct(F.split(edge(text), " "))
    hits = articles.select("link", key, F.explode(words).alias("word")).join(wanted, "word").drop("word")
    texts = articles.select(key, edge(text).alias("text")).dropDuplicates(["key"])
    found = hits.join(texts, "key").where(F.contains("text", "padded")).groupBy("name", "link").agg(F.min("kind").alias("kind"))  # full comes before surname
    some = found.groupBy("name").agg(F.min("kind").alias("best"))
    return found.join(some, "name").where(F.col("kind") == F.col("best")).select("name", "link", "kind")
