"""Queries of the sources: feeds and JSON bodies are made of the driver's rows and read back.

Each body holds what the service would send, so the twins say in SQL what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import feeds, json_api

from .base import query
from .views import load


def text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fetched(rows: DataFrame, body: Column) -> DataFrame:
    return rows.select(F.col("source").alias("name"), F.lit(2).alias("tier"), F.lit(None).cast("string").alias("reach"), F.lit("team").alias("scope"), body.alias("body"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").where("doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")


#: What the feeds are made of: a date by the minute, a title with a reference, a link; every fifth item has no link, every seventh is credited.
SQL_ITEMS = """i AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS stamp, 'https://h.test/sports/' || doc_id AS url FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL)"""


def at() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))


@query("rss_articles", f"""WITH {SQL_ITEMS} SELECT url AS link, 'A & B ' || doc_id AS title, CASE WHEN doc_id % 7 = 0 THEN 'The Wire' ELSE source END AS source, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END AS tier, stamp AS published,
  CASE WHEN doc_id % 3 = 0 THEN 'https://h.test/' || doc_id || '.jpg' END AS image_url, length(lang) AS author_len, 'beat' AS reach FROM i WHERE doc_id % 5 <> 0""")
def rss_articles(spark, sf):
    """An item per document; those without a link drop out, those of another outlet are credited to it."""
    key = text("doc_id")
    link = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("<link>https://h.test/sports/"), key, F.lit("</link>")))
    credit = F.when(F.col("doc_id") % 7 == 0, F.lit('<source url="https://w.test/">The Wire</source>'))
    image = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<enclosure url="https://h.test/'), key, F.lit('.jpg" type="image/jpeg"/>')))
    date = F.date_format(at(), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat_ws(
        "", F.lit("<item><title>A &amp;amp; B "), key, F.lit("</title>"), link, credit, image, F.lit("<description>"),
        escaped(F.coalesce("text", F.lit(""))), F.lit("</description><dc:creator>"), escaped(F.col("lang")), F.lit("</dc:creator><pubDate>"),
        date, F.lit("</pubDate></item>")
    )
    clean = F.regexp_replace(F.concat(F.lit('<?xml version="1.0"?><rss xmlns:dc="urn:dc"><channel>'), item, F.lit("</channel></rss>")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    out, _ = feeds.articles_of(fetched(documents(spark, sf), clean))
    return out.select("link", "title", "source", "tier", F.col("published").cast("timestamp_ntz").alias("published"), "image_url", F.length("author").alias("author_len"), "reach")


@query("atom_articles", f"""WITH {SQL_ITEMS} SELECT 'urn:' || doc_id AS id, url AS link, 'Title ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN stamp ELSE stamp + INTERVAL 1 DAY END AS published, 'body ' || doc_id AS description FROM i""")
def atom_articles(spark, sf):
    """Entries whose first link is a reply's, whose second one has no rel; odd ones have only the date of the update, and a body for a teaser."""
    key, date = text("doc_id"), lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    times = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<published>"), date(at()), F.lit("</published>"))).otherwise(F.lit(""))
    teaser = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("<summary>body "), key, F.lit("</summary>"))
    ).otherwise(F.concat(F.lit('<content type="html">&lt;p&gt;body '), key, F.lit("&lt;/p&gt;</content>")))
    links = F.concat(F.lit('<link rel="replies" href="https://h.test/r"/><link href="https://h.test/sports/'), key, F.lit('"/>'))
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>urn:'), key, F.lit('</id><title type="text">Title '),
        key, F.lit("</title>"), links, times, F.lit("<updated>"), date(at() + F.expr("INTERVAL 1 DAY")), F.lit("</updated>"),
        teaser, F.lit("</entry></feed>")
    )
    out, _ = feeds.articles_of(fetched(documents(spark, sf), body))
    return out.select("id", "link", "title", F.col("published").cast("timestamp_ntz").alias("published"), "description")


@query("sitemap_articles", f"""WITH {SQL_ITEMS} SELECT url AS link, 'Map ' || doc_id AS title, stamp AS published FROM i WHERE doc_id % 4 <> 1""")
def sitemap_articles(spark, sf):
    """Locations padded with white space; every fourth is not of the sports path."""
    key = text("doc_id")
    loc = F.concat(F.lit("\n  https://h.test/"), F.when(F.col("doc_id") % 4 == 1, "news/sports-bill/").otherwise("sports/"), key, F.lit("\n "))
    body = F.concat(
        F.lit('<urlset xmlns:news="urn:n"><url><loc>'), loc, F.lit("</loc><news:news><news:title>Map "), key, F.lit("</news:title><news:publication_date>"),
        F.date_format(at(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("</news:publication_date></news:news></url></urlset>")
    )
    out, _ = feeds.articles_of(fetched(documents(spark, sf), body))
    return out.select("link", "title", F.col("published").cast("timestamp_ntz").alias("published"))


@query("failed_feeds", "SELECT source AS failed_source, count(*) AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1")
def failed_feeds(spark, sf):
    """Every third feed is empty, which is no failure; the others are cut off or no feeds."""
    body = F.when(F.col("doc_id") % 3 == 0, "<rss><channel></channel></rss>").when(F.col("doc_id") % 3 == 1, "<rss><channel><item>").otherwise("<html><body/></html>")
    _, failed = feeds.articles_of(fetched(documents(spark, sf), body))
    return failed.groupBy("failed_source").agg(F.count("*").alias("n"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders")


def when_some(test: Column, value: Column) -> Column:
    return F.when(test, value)


SQL_GAMES = """g AS (SELECT *, o_custkey AS home, o_custkey + 1 AS away, (o_totalprice / 1000)::BIGINT AS hs, o_orderkey % 50 AS aw, CASE o_orderstatus WHEN 'O' THEN 'pre' WHEN 'F' THEN 'post' ELSE 'in' END AS state FROM orders)"""


def games(spark: SparkSession, sf: str) -> DataFrame:
    """Home scores are thousands, halves to the even number as in the twins."""
    state = F.when(F.col("o_orderstatus") == "O", "pre").when(F.col("o_orderstatus") == "F", "post").otherwise("in")
    return orders(spark, sf).withColumns({"state": state, "hs": F.rint(F.col("o_totalprice") / 1000).cast("long"), "aw": F.col("o_orderkey") % 50})


def event(home_score: Column, away_score: Column) -> Column:
    """A game as a board and a schedule have it; scores as numbers, strings or objects."""
    side = lambda place, team, score: F.struct(
        F.lit(place).alias("homeAway"), score.alias("score"),
        F.struct(team.alias("id"), F.concat(F.lit("Team "), team).alias("displayName"), F.concat(F.lit("T"), team).alias("shortDisplayName")).alias("team")
    )
    kind = F.struct("state", (F.col("state") == "post").alias("completed"))
    status = F.struct(kind.alias("type"), F.lit("4:05").alias("displayClock"), F.lit(3).alias("period"))
    situation = F.struct(F.lit("2nd & 5").alias("downDistanceText"), text("o_custkey").alias("possession"))
    competition = F.struct(
        F.array(side("home", text("o_custkey"), home_score), side("away", text(F.col("o_custkey") + 1), away_score)).alias("competitors"),
        status.alias("status"), situation.alias("situation"),
        F.array(F.struct(F.array(F.lit("CBX")).alias("names"))).alias("broadcasts")
    )
    return F.struct(
        text("o_orderkey").alias("id"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.array(competition).alias("competitions")
    )


@query("scoreboard", f"""WITH {SQL_GAMES} SELECT o_orderkey::VARCHAR AS id, state, home::VARCHAR AS home_id, away::VARCHAR AS away_id, hs::INT AS home_score, aw::INT AS away_score, date_trunc('minute', o_orderdate) AS kickoff, 'CBX' AS network,
  CASE WHEN state = 'in' THEN '2nd & 5' END AS down_distance, CASE WHEN state = 'in' THEN home::VARCHAR END AS possession FROM g""")
def scoreboard(spark, sf):
    bodies = games(spark, sf).select(F.lit("l").alias("league_id"), F.to_json(F.struct(F.array(event(F.col("hs"), text("aw"))).alias("events"))).alias("body"))
    return json_api.scoreboard(bodies).select(
        "id", "state", "home_id", "away_id", "home_score", "away_score", F.col("kickoff").cast("timestamp_ntz").alias("kickoff"),
        "network", "down_distance", "possession"
    )


@query("schedule", f"""WITH {SQL_GAMES} SELECT o_orderkey::VARCHAR AS id, home::VARCHAR AS team_id, away::VARCHAR AS opponent_id, 'home' AS place, state, CASE WHEN state = 'post' THEN hs::DOUBLE END AS own_score, CASE WHEN state = 'post' THEN aw::DOUBLE END AS opponent_score,
  CASE WHEN state = 'post' THEN CASE WHEN hs > aw THEN 'W' WHEN hs < aw THEN 'L' ELSE 'T' END END AS result FROM g""")
def schedule(spark, sf):
    number = lambda c: F.struct(F.col(c).alias("value"))
    bodies = games(spark, sf).select(text("o_custkey").alias("team_id"), F.to_json(F.struct(F.array(event(number("hs"), number("aw"))).alias("events"))).alias("body"))
    return json_api.schedule(bodies).select("id", "team_id", "opponent_id", "place", "state", "own_score", "opponent_score", "result")


@query("odds", "SELECT o_orderkey::VARCHAR AS id, 'book ' || o_custkey AS provider, o_orderkey % 60 + 0.5::DOUBLE AS over_under, (0 - o_custkey % 300)::DOUBLE AS home_ml FROM orders")
def odds(spark, sf):
    line = F.struct(
        F.struct(F.concat(F.lit("book "), text("o_custkey")).alias("name")).alias("provider"), (F.col("o_orderkey") % 60 + 0.5).alias("overUnder"),
        F.struct(text(-(F.col("o_custkey") % 300)).alias("moneyLine")).alias("homeTeamOdds")
    )
    bodies = orders(spark, sf).select(text("o_orderkey").alias("id"), F.to_json(F.struct(F.array(line).alias("items"))).alias("body"))
    return json_api.odds(bodies).select("id", "provider", "over_under", "home_ml")


SQL_SUMMARY = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events), d AS (SELECT *, nth // 6 AS drive, max(nth // 6) OVER (PARTITION BY user_id) AS last_drive FROM e)"""


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as a game, six a drive; the last drive is the current one too, with a new result."""
    from pyspark.sql import Window

    e = load(spark, sf, "events")
    at_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    play = F.struct(
        "at",
        F.when(F.col("event_type") != "error", text("event_id")).alias("id"), F.col("event_type").alias("text"),
        F.struct(F.lit(1).alias("number")).alias("period"), (F.col("value") > 90).alias("scoringPlay"), F.floor("value").alias("homeScore")
    )
    drives = e.withColumn("at", at_).groupBy("user_id", F.floor(F.col("at") / 6).alias("drive")).agg(F.array_sort(F.collect_list(play)).alias("plays"))
    one = lambda result: F.struct("drive", F.concat(F.lit("d"), text("drive")).alias("id"), F.lit(result).alias("result"), text("user_id").alias("team"), "plays")
    games_ = drives.groupBy("user_id").agg(F.array_sort(F.collect_list(one("PUNT"))).alias("previous"), F.max(one("TD")).alias("current"))
    return games_.select(F.col("user_id").alias("game_id"), F.to_json(F.struct(F.struct("previous", "current").alias("drives"))).alias("body"))


@query("summary_drives", f"""WITH {SQL_SUMMARY} SELECT DISTINCT user_id AS game_id, drive::INT AS pos, 'd' || drive AS id, CASE WHEN drive = last_drive THEN 'touchdown' ELSE 'punt' END AS outcome, drive = last_drive AS is_current FROM d""")
def summary_drives(spark, sf):
    """The current drive stands once, in the place of its earlier form."""
    return json_api.summary_drives(summaries(spark, sf)).select("game_id", "pos", "id", "outcome", "is_current")


@query("summary_plays", f"""WITH {SQL_SUMMARY} SELECT user_id AS game_id, event_id::VARCHAR AS play_id, drive::INT AS drive_pos, row_number() OVER (PARTITION BY user_id ORDER BY nth)::INT AS pos, value > 90 AS scoring, floor(value)::INT AS home_score FROM d WHERE event_type <> 'error'""")
def summary_plays(spark, sf):
    """Plays without an id drop out."""
    return json_api.summary_plays(json_api.summary_drives(summaries(spark, sf))).select("game_id", "play_id", "drive_pos", "pos", "scoring", "home_score")


@query("summary_probability", "SELECT user_id AS game_id, event_id::VARCHAR AS play_id, value / 100 AS home_win_pct FROM events WHERE value BETWEEN 0 AND 100")
def summary_probability(spark, sf):
    """Numbers as strings count, those out of range don't."""
    point = F.struct(F.col("event_id").alias("playId"), text(F.col("value") / 100).alias("homeWinPercentage"))
    bodies = load(spark, sf, "events").select(F.col("user_id").alias("game_id"), F.to_json(F.struct(F.array(point).alias("winprobability"))).alias("body"))
    return json_api.summary_probability(bodies).select("game_id", "play_id", "home_win_pct")


@query("json_news", "SELECT p_partkey::VARCHAR AS id, p_name AS title, 'https://n.test/' || p_partkey AS link, p_brand AS author FROM part WHERE p_partkey % 9 <> 0")
def json_news(spark, sf):
    """Articles without a link drop out."""
    web = F.struct(F.struct(F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("https://n.test/"), text("p_partkey"))).alias("href")).alias("web"))
    article = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("headline"), F.col("p_brand").alias("byline"), web.alias("links"), F.lit("no date").alias("published"))
    bodies = load(spark, sf, "part").select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("body"))
    return json_api.news(bodies, "news", "broad").select("id", "title", "link", "author")


@query("standings_teams", "SELECT DISTINCT n_regionkey AS league_id, n_nationkey::VARCHAR AS id, n_name AS name, n_name AS short_name FROM nation")
def standings_teams(spark, sf):
    """Even regions have flat standings, odd ones nested; each team comes twice."""
    entry = F.struct(F.struct(text("n_nationkey").alias("id"), F.col("n_name").alias("displayName")).alias("team"))
    rows = load(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(entry).alias("entries"))
    twice = F.concat("entries", "entries")
    flat, nested = F.struct(F.struct(twice.alias("entries")).alias("standings")), F.struct(F.array(F.struct(F.struct(twice.alias("entries")).alias("standings"))).alias("children"))
    bodies = rows.select(F.col("n_regionkey").alias("league_id"), F.when(F.col("n_regionkey") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(nested)).alias("body"))
    return json_api.teams(bodies).select("league_id", "id", "name", "short_name")


@query("roster", "SELECT s_nationkey::VARCHAR AS team_id, s_suppkey::VARCHAR AS id, s_name AS full_name, CASE WHEN s_suppkey % 2 = 0 THEN 'offense' ELSE 'defense' END AS position_group, CASE WHEN s_suppkey % 70 <= 60 THEN (s_suppkey % 70)::INT END AS experience_years FROM supplier")
def roster(spark, sf):
    """A player per supplier; those of another group drop out, years beyond sixty go."""
    player = F.struct(text("s_suppkey").alias("id"), F.col("s_name").alias("fullName"), F.struct((F.col("s_suppkey") % 70).alias("years")).alias("experience"))
    group = lambda name: F.struct(name.alias("position"), F.array(player).alias("items"))
    groups = F.array(group(F.when(F.col("s_suppkey") % 2 == 0, "offense").otherwise("defense")), group(F.lit("coach")))
    bodies = load(spark, sf, "supplier").select(text("s_nationkey").alias("team_id"), F.to_json(F.struct(groups.alias("athletes"))).alias("body"))
    return json_api.roster(bodies).select("team_id", "id", "full_name", "position_group", "experience_years")


@query("team_leaders", "SELECT p_partkey::VARCHAR AS team_id, p_brand AS category, (p_size + 1)::VARCHAR AS athlete_id, 2 AS rank FROM part UNION ALL SELECT p_partkey::VARCHAR, p_brand, p_size::VARCHAR, 3 FROM part")
def team_leaders(spark, sf):
    """The first leader has no reference to an athlete, so ranks begin at two."""
    leader = lambda key: F.struct(
        text(key).alias("displayValue"),
        F.map_from_arrays(F.array(F.lit("$ref")), F.array(F.concat(F.lit("http://s.test/athletes/"), text(key)))).alias("athlete")
    )
    nobody = F.struct(F.lit("9").alias("displayValue"), F.map_from_arrays(F.array(F.lit("$ref")), F.array(F.lit("http://s.test/teams/1"))).alias("athlete"))
    category = F.struct(F.col("p_brand").alias("name"), F.array(nobody, leader(F.col("p_size") + 1), leader(F.col("p_size"))).alias("leaders"))
    bodies = load(spark, sf, "part").select(text("p_partkey").alias("team_id"), F.to_json(F.struct(F.array(category).alias("categories"))).alias("body"))
    return json_api.leaders(bodies).select("team_id", "category", "athlete_id", "rank")


@query("player_stats", "SELECT p_partkey::VARCHAR AS athlete_id, 'run' AS name, [p_size::VARCHAR, '-'] AS \"values\" FROM part WHERE p_size <> 0")
def player_stats(spark, sf):
    """Of two seasons one is wanted; a category of zeros and dashes only is dropped."""
    season = lambda year, values: F.struct(F.struct(F.lit(year).alias("year")).alias("season"), values.alias("stats"))
    category = lambda name, values: F.struct(
        F.lit(name).alias("name"), F.array(F.lit("A"), F.lit("B")).alias("labels"),
        F.array(season(2022, F.array(F.lit("7"), F.lit("7"))), season(2023, values)).alias("statistics")
    )
    categories = F.array(category("run", F.array(text("p_size"), F.lit("-"))), category("none", F.array(F.lit("0"), F.lit("0.0"))))
    bodies = load(spark, sf, "part").select(text("p_partkey").alias("athlete_id"), F.to_json(F.struct(categories.alias("categories"))).alias("body"))
    return json_api.player_stats(bodies, 2023).select("athlete_id", "name", "values")


@query("league_catalog", "SELECT r_regionkey::VARCHAR AS id, r_name AS display_name, CASE WHEN r_regionkey BETWEEN 1 AND 12 THEN r_regionkey::INT END AS season_start_month FROM region")
def league_catalog(spark, sf):
    """A league per region, twice; one without a path drops out; months out of range go."""
    league = lambda path: F.struct(
        text("r_regionkey").alias("id"), F.col("r_name").alias("displayName"), F.lit("football").alias("espnSport"), path.alias("espnLeaguePath"),
        F.col("r_regionkey").alias("seasonStartMonth")
    )
    broken = F.struct(
        F.lit("x").alias("id"), F.lit("No path").alias("displayName"), F.lit("football").alias("espnSport"), F.lit(None).cast("string").alias("espnLeaguePath"),
        F.lit(1).alias("seasonStartMonth")
    )
    bodies = load(spark, sf, "region").select(F.to_json(F.struct(F.array(league(F.lit("nfl")), league(F.lit("other")), broken).alias("leagues"))).alias("body"))
    return json_api.leagues(bodies).select("id", "display_name", "season_start_month")


@query("stored_articles", """SELECT 'team' || (doc_id % 10) AS team, 'doc:' || doc_id AS link, 'T ' || doc_id AS title, (doc_id % 4)::INT AS tier, CASE WHEN doc_id % 2 = 0 THEN 'beat' ELSE 'national' END AS reach FROM documents WHERE doc_id IS NOT NULL AND doc_id % 6 <> 0""")
def stored_articles(spark, sf):
    """Entries without the time they were first seen drop out, unknown words of reach go to the default."""
    seen = F.when(F.col("doc_id") % 6 != 0, "2024-01-02T03:04:05Z")
    entry = F.struct(
        F.concat(F.lit("doc:"), text("doc_id")).alias("link"), F.concat(F.lit("T "), text("doc_id")).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, "beat").otherwise("odd").alias("reach"), (F.col("doc_id") % 4).alias("tier"),
        seen.alias("firstSeenAt")
    )
    bodies = load(spark, sf, "documents").where("doc_id IS NOT NULL").select(
        F.concat(F.lit("team"), text(F.col("doc_id") % 10)).alias("team"), F.to_json(F.array(entry)).alias("body")
    )
    return json_api.stored_articles(bodies).select("team", "link", "title", "tier", "reach")


@query("stored_marks", "SELECT 'doc:' || doc_id AS link, TIMESTAMP '2024-01-02 03:04:05' + to_minutes(doc_id) AS read_at FROM labels WHERE doc_id IS NOT NULL")
def stored_marks(spark, sf):
    at_ = F.date_format(F.lit("2024-01-02 03:04:05").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    mark = F.struct(F.concat(F.lit("doc:"), text("doc_id")).alias("link"), at_.alias("readAt"))
    nothing = F.struct(F.lit("").alias("link"), at_.alias("readAt"))
    bodies = load(spark, sf, "labels").where("doc_id IS NOT NULL").select(F.to_json(F.array(mark, nothing)).alias("body"))
    return json_api.stored_marks(bodies).select("link", F.col("read_at").cast("timestamp_ntz").alias("read_at"))
