"""Sports JSON to tables. Each reader takes one JSON text per row (column body) and drops or nulls what is malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.dates import feed_date
from newsloom.functions.numbers import number, team_colour, text_at, whole_within
from newsloom.operators import games as G

V = "array<variant>"
GROUPS = ("offense", "defense", "specialTeam")


def root() -> Column:
    return F.try_parse_json("body")


def items(value: Column, path: str) -> Column:
    """The array at a path, or an empty one."""
    return F.coalesce(F.try_variant_get(value, path, V), F.array().cast(V))


def news(bodies: DataFrame, source: str, scope: str) -> DataFrame:
    a = bodies.select("*", F.posexplode(items(root(), "$.articles")).alias("pos", "a"))
    at = lambda p: text_at(F.col("a"), p)
    out = a.select(
        F.lit(source).alias("source"), F.coalesce(at("$.id"), at("$.links.web.href")).alias("id"), at("$.headline").alias("title"), at("$.links.web.href").alias("link"), at("$.description").alias("description"), at("$.byline").alias("author"),
        feed_date(at("$.published")).alias("published"), at("$.images[0].url").alias("image_url"), F.lit(1).alias("tier"), F.lit("national").alias("reach"), F.lit(scope).alias("scope"), "pos",
    )
    return out.where("link IS NOT NULL AND title IS NOT NULL")


def teams(bodies: DataFrame) -> DataFrame:
    """Standings, flat or nested, to teams: each id once, by short name. bodies: league_id, body."""
    flat = items(root(), "$.standings.entries")
    nested = F.flatten(F.transform(items(root(), "$.children"), lambda c: items(c, "$.standings.entries")))
    e = bodies.select("league_id", F.posexplode(F.when(F.size(flat) > 0, flat).otherwise(nested)).alias("pos", "e"))
    at = lambda p: text_at(F.col("e"), f"$.team.{p}")
    rows = e.select(
        "league_id", "pos", at("id").alias("id"), at("displayName").alias("name"),
        F.coalesce(at("shortDisplayName"), at("displayName")).alias("short_name"), at("location").alias("location"), at("abbreviation").alias("abbreviation"),
        at("logos[0].href").alias("logo_url")
    ).where("id IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("league_id", "id").orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "pos")


def by_short_name(rows: DataFrame) -> DataFrame:
    return rows.orderBy("league_id", F.collate("short_name", "UNICODE"), "id")


def roster(bodies: DataFrame) -> DataFrame:
    g = bodies.select("team_id", F.explode(items(root(), "$.athletes")).alias("g")).select(
        "team_id", text_at(F.col("g"), "$.position").alias("position_group"), "g"
    ).where(F.col("position_group").isin(*GROUPS))
    p = g.select("team_id", "position_group", F.explode(items(F.col("g"), "$.items")).alias("p"))
    at = lambda x: text_at(F.col("p"), f"$.{x}")
    return p.select(
        "team_id", at("id").alias("id"), at("fullName").alias("full_name"), at("firstName").alias("first_name"), at("lastName").alias("last_name"),
        at("jersey").alias("jersey"), at("position.abbreviation").alias("position"), "position_group", at("headshot.href").alias("headshot_url"),
        whole_within(number(F.col("p"), "$.experience.years"), 0, 60).alias("experience_years")
    ).where("id IS NOT NULL")


def leaders(bodies: DataFrame) -> DataFrame:
    """Category by leader; the rank is the place in the list, before rows without an athlete are dropped."""
    c = bodies.select("team_id", F.posexplode(items(root(), "$.categories")).alias("cat", "c"))
    c = c.select(
        "team_id", "cat", text_at(F.col("c"), "$.name").alias("category"), text_at(F.col("c"), "$.displayName").alias("title"),
        F.posexplode(items(F.col("c"), "$.leaders")).alias("at", "l")
    )
    athlete = F.nullif(F.regexp_extract(text_at(F.col("l"), "$.athlete['$ref']"), r"/athletes/([0-9]+)", 1), F.lit(""))
    return c.select(
        "team_id", "category", F.coalesce("title", "category").alias("title"), athlete.alias("athlete_id"),
        text_at(F.col("l"), "$.displayValue").alias("display_value"), (F.col("at") + 1).alias("rank"), F.struct("cat", "at").alias("pos")
    ).where("athlete_id IS NOT NULL AND category IS NOT NULL")


def player_stats(bodies: DataFrame, season: int) -> DataFrame:
    c = bodies.select("athlete_id", F.posexplode(items(root(), "$.categories")).alias("pos", "c"))
    entry = F.get(F.filter(items(F.col("c"), "$.statistics"), lambda s: number(s, "$.season.year") == season), F.lit(0))
    strings = lambda v, p: F.transform(items(v, p), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    rows = c.select(
        "athlete_id", "pos", text_at(F.col("c"), "$.name").alias("name"), text_at(F.col("c"), "$.displayName").alias("display_name"),
        strings(F.col("c"), "$.labels").alias("labels"),
        strings(F.col("c"), "$.displayNames").alias("descriptions"), strings(entry, "$.stats").alias("values")
    )
    return rows.where(F.exists("values", lambda v: ~F.trim(v).rlike("^(?:|-+|0+(?:[.]0+)?)$")))


def _sides(value: Column, path: str) -> Column:
    return items(value, path)


def _side(sides: Column, test) -> Column:
    return F.get(F.filter(sides, test), F.lit(0))


def network(competition: Column) -> Column:
    """The first network of three shapes of broadcast lists."""
    at = lambda p: text_at(competition, p)
    return F.coalesce(at("$.broadcasts[0].names[0]"), at("$.broadcasts[0].media.shortName"), at("$.geoBroadcasts[0].media.shortName"))


def score(side: Column) -> Column:
    return F.coalesce(number(side, "$.score.value"), number(side, "$.score"))


def schedule(bodies: DataFrame) -> DataFrame:
    """bodies: team_id, body. Result, score and record only of games completed."""
    e = bodies.select("team_id", F.explode(items(root(), "$.events")).alias("e")).withColumn("c", F.try_variant_get("e", "$.competitions[0]", "variant"))
    sides = _sides(F.col("c"), "$.competitors")
    own = _side(sides, lambda s: text_at(s, "$.team.id") == F.col("team_id"))
    other = _side(sides, lambda s: text_at(s, "$.team.id") != F.col("team_id"))
    rows = e.withColumns({"own": own, "opp": other})
    done = F.coalesce(F.try_variant_get("c", "$.status.type.completed", "boolean"), F.lit(False))
    win = lambda s: F.try_variant_get(s, "$.winner", "boolean")
    records = items(F.col("own"), "$.record")
    record = F.coalesce(text_at(_side(records, lambda r: text_at(r, "$.type") == "total"), "$.displayValue"), text_at(F.get(records, F.lit(0)), "$.displayValue"))
    place = F.when(F.try_variant_get("c", "$.neutralSite", "boolean"), "neutral").otherwise(text_at(F.col("own"), "$.homeAway"))
    return rows.select(
        "team_id", text_at(F.col("e"), "$.id").alias("id"), feed_date(text_at(F.col("e"), "$.date")).alias("kickoff"), text_at(F.col("opp"), "$.team.id").alias("opponent_id"), text_at(F.col("opp"), "$.team.displayName").alias("opponent"), place.alias("place"),
        G.state_of(text_at(F.col("c"), "$.status.type.state"), done).alias("state"), F.when(done, score(F.col("own"))).alias("own_score"), F.when(done, score(F.col("opp"))).alias("opponent_score"),
        F.when(done, G.result_of(win(F.col("own")), win(F.col("opp")), score(F.col("own")), score(F.col("opp")))).alias("result"), F.when(done, record).alias("record"), network(F.col("c")).alias("network"),
    ).where("id IS NOT NULL AND opponent_id IS NOT NULL")


def odds(bodies: DataFrame) -> DataFrame:
    first = bodies.select("id", F.get(items(root(), "$.items"), F.lit(0)).alias("o")).where("o IS NOT NULL")
    at = lambda p: number(F.col("o"), p)
    return first.select(
        "id", text_at(F.col("o"), "$.provider.name").alias("provider"), text_at(F.col("o"), "$.details").alias("details"),
        at("$.overUnder").alias("over_under"), at("$.homeTeamOdds.moneyLine").alias("home_ml"), at("$.awayTeamOdds.moneyLine").alias("away_ml")
    )


def scoreboard(bodies: DataFrame) -> DataFrame:
    """bodies: league_id, body. Games need an id and both sides; the situation is that of a game in progress only."""
    e = bodies.select("league_id", F.explode(items(root(), "$.events")).alias("e")).withColumn("c", F.try_variant_get("e", "$.competitions[0]", "variant"))
    side = lambda name: _side(_sides(F.col("c"), "$.competitors"), lambda s: text_at(s, "$.homeAway") == name)
    rows = e.withColumns({"home": side("home"), "away": side("away")}).where("home IS NOT NULL AND away IS NOT NULL")
    name = lambda s: F.coalesce(text_at(s, "$.team.shortDisplayName"), text_at(s, "$.team.displayName"), text_at(s, "$.team.abbreviation"), F.lit("TBD"))
    state = G.state_of(text_at(F.col("c"), "$.status.type.state"), F.coalesce(F.try_variant_get("c", "$.status.type.completed", "boolean"), F.lit(False)))
    live = lambda p: F.when(F.col("state") == "in", text_at(F.col("c"), f"$.situation.{p}"))
    both = {}
    for s in ("home", "away"):
        both |= {f"{s}_id": text_at(F.col(s), "$.team.id"), f"{s}_name": name(F.col(s)), f"{s}_score": score(F.col(s)).cast("int")}
    rows = rows.withColumns(
        {
            "id": text_at(F.col("e"), "$.id"), "kickoff": feed_date(text_at(F.col("e"), "$.date")), "state": state,
            "period": number(F.col("c"), "$.status.period").cast("int"), "clock": text_at(F.col("c"), "$.status.displayClock"),
            "network": network(F.col("c"))
        } | both
    )
    rows = rows.withColumns({"down_distance": live("downDistanceText"), "possession": live("possession"), "last_play": live("lastPlay.text")})
    return rows.where("id IS NOT NULL").drop("e", "c", "home", "away")


def summary_drives(bodies: DataFrame) -> DataFrame:
    """Drives of game summaries (game_id, body): the current one takes the place of its earlier form, else it is the last."""
    previous, current = items(root(), "$.drives.previous"), F.try_variant_get(root(), "$.drives.current", "variant")
    rows = bodies.select("game_id", previous.alias("p"), current.alias("c")).withColumn("cid", text_at(F.col("c"), "$.id"))
    seen = F.exists("p", lambda d: text_at(d, "$.id") == F.col("cid"))
    listed = F.transform("p", lambda d: F.when(text_at(d, "$.id") == F.col("cid"), F.col("c")).otherwise(d))
    all_ = F.when(F.col("c").isNull() | F.coalesce(seen, F.lit(False)), listed).otherwise(F.concat("p", F.array("c")))
    d = rows.select("game_id", "cid", F.posexplode(all_).alias("pos", "d"))
    result = F.coalesce(text_at(F.col("d"), "$.displayResult"), text_at(F.col("d"), "$.result"))
    return d.select(
        "game_id", "pos", text_at(F.col("d"), "$.id").alias("id"), text_at(F.col("d"), "$.team.id").alias("team_id"),
        text_at(F.col("d"), "$.description").alias("description"), result.alias("result"),
        number(F.col("d"), "$.offensivePlays").cast("int").alias("plays"), number(F.col("d"), "$.yards").cast("int").alias("yards"),
        F.coalesce(text_at(F.col("d"), "$.id") == F.col("cid"), F.lit(False)).alias("is_current"), G.outcome(result).alias("outcome"),
        "d"
    )


def summary_plays(drives: DataFrame) -> DataFrame:
    """Plays of the drives, in order; a play without an id is dropped."""
    p = drives.select("game_id", F.col("pos").alias("drive_pos"), F.posexplode(items(F.col("d"), "$.plays")).alias("play_pos", "p"))
    at = lambda x: text_at(F.col("p"), x)
    n = lambda x: number(F.col("p"), x).cast("int")
    rows = p.select(
        "game_id", "drive_pos", "play_pos", F.try_variant_get("p", "$.id", "string").alias("play_id"), at("$.text").alias("text"),
        at("$.type.text").alias("type"), n("$.period.number").alias("period"), at("$.clock.displayValue").alias("clock"),
        F.coalesce(F.try_variant_get("p", "$.scoringPlay", "boolean"), F.lit(False)).alias("scoring"), n("$.homeScore").alias("home_score"),
        n("$.awayScore").alias("away_score")
    ).where("play_id IS NOT NULL")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("game_id").orderBy("drive_pos", "play_pos")))


def summary_probability(bodies: DataFrame) -> DataFrame:
    w = bodies.select("game_id", F.posexplode(items(root(), "$.winprobability")).alias("pos", "w"))
    return w.select(
        "game_id", "pos",
        F.try_variant_get("w", "$.playId", "string").alias("play_id"),
        number(F.col("w"), "$.homeWinPercentage").alias("home_win_pct")
    ).where("home_win_pct BETWEEN 0 AND 1")


def team_colours(bodies: DataFrame) -> DataFrame:
    return bodies.select("team_id", team_colour(text_at(root(), "$.team.color")).alias("colour"))


def leagues(bodies: DataFrame) -> DataFrame:
    """The league catalogue: id, name, sport and path are required, other fields go null if malformed, the first of an id counts."""
    l = bodies.select(F.posexplode(items(root(), "$.leagues")).alias("pos", "l"))
    at = lambda p: text_at(F.col("l"), f"$.{p}")
    rows = l.select(
        "pos", at("id").alias("id"), at("displayName").alias("display_name"), at("sport").alias("sport"), at("level").alias("level"),
        at("status").alias("status"), at("espnSport").alias("espn_sport"), at("espnLeaguePath").alias("espn_league_path"),
        whole_within(number(F.col("l"), "$.espnGroup"), 0, 1 << 31).alias("espn_group"),
        whole_within(number(F.col("l"), "$.seasonStartMonth"), 1, 12).alias("season_start_month"),
        F.try_variant_get("l", "$.leaderCategories", "array<string>").alias("leader_categories")
    )
    rows = rows.where("id IS NOT NULL AND display_name IS NOT NULL AND espn_sport IS NOT NULL AND espn_league_path IS NOT NULL")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("_n = 1").drop("_n")


def refreshed(catalog: DataFrame, previous: DataFrame) -> DataFrame:
    """The new catalogue, or the previous one where the new has no available league; fails if neither has."""
    for rows in (catalog, previous):
        if not rows.where("status = 'available'").isEmpty():
            return rows
    raise ValueError("no available league")


def stored_articles(bodies: DataFrame) -> DataFrame:
    """Stored JSON lists of articles: entries without link, title or first_seen are dropped, unknown words of reach and scope go to defaults."""
    a = bodies.select("team", F.posexplode(items(root(), "$")).alias("pos", "a"))
    at = lambda p: text_at(F.col("a"), f"$.{p}")
    clamp = lambda c, ok, default: F.when(c.isin(*ok), c).otherwise(default)
    rows = a.select(
        "team", "pos", at("link").alias("link"), at("title").alias("title"), at("description").alias("description"), at("source").alias("source"),
        feed_date(at("publishedAt")).alias("published"), feed_date(at("firstSeenAt")).alias("first_seen"),
        F.coalesce(whole_within(number(F.col("a"), "$.tier"), 0, 3), F.lit(0)).alias("tier"),
        clamp(at("reach"), ("national", "beat"), "national").alias("reach"),
        clamp(at("scope"), ("team", "broad"), "broad").alias("scope")
    )
    return rows.where("link IS NOT NULL AND title IS NOT NULL AND first_seen IS NOT NULL")


def stored_index(bodies: DataFrame) -> DataFrame:
    """Stored JSON indexes of teams (body) to key and last_used_at; entries without either are dropped."""
    return _entries(bodies, "key", "lastUsedAt").toDF("key", "last_used_at")


def stored_marks(bodies: DataFrame) -> DataFrame:
    """Stored JSON lists of read marks (body) to link and read_at; entries without either are dropped."""
    return _entries(bodies, "link", "readAt").toDF("link", "read_at")


def _entries(bodies: DataFrame, name: str, at: str) -> DataFrame:
    e = bodies.select(F.explode(items(root(), "$")).alias("e"))
    string = lambda p: F.when(F.schema_of_variant(F.try_variant_get("e", p, "variant")) == "STRING", text_at(F.col("e"), p))
    rows = e.select(string(f"$.{name}").alias("name"), string(f"$.{at}").alias("at"))
    return rows.where("name IS NOT NULL AND at IS NOT NULL").select("name", feed_date(F.col("at")).alias("at"))


def worksheet(texts: DataFrame) -> DataFrame:
    """Answers of worksheets (column text): one row per block that begins with ##, key and value per '- key: value' line."""
    block = texts.select(F.posexplode(F.slice(F.split("text", r"(?m)^## +"), F.lit(2), F.lit(1 << 20))).alias("pos", "b"))
    line = block.select(
        "pos",
        F.trim(F.regexp_extract("b", "^([^\n]*)", 1)).alias("subject"),
        F.explode(F.regexp_extract_all("b", F.lit(r"(?m)^- *([^:\n]+: *[^\n]*)$"), F.lit(1))).alias("l")
    )
    return line.select("subject", F.trim(F.substring_index("l", ":", 1)).alias("question"), F.trim(F.regexp_extract("l", "^[^:]+:(.*)$", 1)).alias("answer"))
