"""Curated tables and their checks: nickname hazards, source yield, review state, league catalogue, logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

from .order import MOST_TASKS, tasks_for

#: Teams of a nickname that meet as many others of it at once, about, or more where that makes too many tasks.
TOGETHER = 500


def _held(teams: DataFrame) -> DataFrame:
    return teams.where(F.size("sources") > 0).select("slug", "sources", F.explode("nicknames").alias("nickname")).withColumn("nickname", F.lower("nickname")).distinct()


def _hazards(held: DataFrame, others: DataFrame, reserved: DataFrame) -> DataFrame:
    owned = held.join(reserved.select(F.lower("nickname").alias("nickname"), "owner"), "nickname").where("owner IS NULL OR owner <> slug")
    taken = owned.select("slug", "nickname", F.lit("reserved").alias("kind"), F.coalesce("owner", F.lit("")).alias("detail"))
    # dealt by nickname and in blocks on both sides, so that many teams of one nickname are no single task; blocks grow with the teams, so that they are sent no more often
    sizes = others.groupBy("nickname").agg(F.count("*").alias("m")).join(held.groupBy("nickname").agg(F.count("*").alias("n")), "nickname")
    made = int(sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)
    together = max(TOGETHER, math.isqrt(made // MOST_TASKS))
    parts = sizes.select("nickname", F.ceil(F.col("n") / together).alias("parts"), F.ceil(F.col("m") / together).alias("other_parts"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    key = ("nickname", "_part", "_other_part")
    one = _blocks(held.join(parts, "nickname"), "parts", "_part", "other_parts", "ones").withColumn("_other_part", upto("other_parts"))
    other = _blocks(others.join(parts, "nickname"), "other_parts", "_other_part", "parts", "theirs").withColumn("_part", upto("parts"))
    dealt = lambda rows, blocks: rows.select(*key, blocks).repartition(tasks_for(made), *key)
    tiles = dealt(one, "ones").join(dealt(other, "theirs"), list(key)).select("nickname", F.explode("ones").alias("one"), "theirs")
    mine = F.col("one.sources")
    met = lambda t: F.struct(
        t["slugs"].alias("others"), F.coalesce(F.arrays_overlap(mine, t["sources"]), F.lit(False)).alias("meet"),
        F.concat(F.lit(","), F.array_join(F.sort_array(F.array_intersect(mine, t["sources"])), ",")).alias("common")
    )
    listed = tiles.select("nickname", F.col("one.slugs").alias("slugs"), F.inline(F.transform("theirs", met)))  # what two lists of sources share is worked out once for all teams that have them
    kind = F.when(F.col("meet"), "shared-source").otherwise("contested")
    each = listed.select("nickname", "slugs", "others", kind.alias("kind"), F.when(F.col("meet"), F.col("common")).otherwise("").alias("more"))
    pairs = each.withColumn("slug", F.explode("slugs")).drop("slugs").withColumn("other", F.explode("others")).where("slug <> other")
    rows = pairs.select("slug", "nickname", "kind", F.concat("other", "more").alias("detail"))
    return taken.distinct().unionByName(rows if _plain(held) and _plain(others) else rows.distinct())


def _blocks(rows: DataFrame, parts: str, part: str, other_parts: str, name: str) -> DataFrame:
    """nickname, part, other_parts, and as name the teams of a block by their sources: sources, slugs."""
    by_sources = rows.groupBy("nickname", F.pmod(F.xxhash64("slug", "sources"), parts).alias(part), other_parts, "sources").agg(F.collect_list("slug").alias("slugs"))
    return by_sources.groupBy("nickname", part, other_parts).agg(F.collect_list(F.struct("sources", "slugs")).alias(name))


def _plain(held: DataFrame) -> bool:
    """Has each team a nickname once, and no slug a comma? Then no two pairs of teams read alike."""
    several = held.groupBy("slug", "nickname").agg(F.count("*").alias("n")).where("n > 1 OR contains(slug, ',')")
    return several.isEmpty()


def nickname_hazards(teams: DataFrame, reserved: DataFrame) -> DataFrame:
    """slug, nickname, kind, detail. teams: slug, nicknames, sources (broad); reserved: nickname, owner.

    reserved: another's name; shared-source: two teams with the nickname have a source in common; contested:
    two have it. Teams without a broad source are out of reach.
    """
    held = _held(teams)
    return _hazards(held, held, reserved)


def hazard_order() -> list[Column]:
    return [F.col(c) for c in ("slug", "nickname", "kind", "detail")]


def hypothetical(teams: DataFrame, candidates: DataFrame, reserved: DataFrame) -> DataFrame:
    """Hazards that each candidate (slug, word) would have of its own, tried alone against the nicknames that teams have."""
    reach = teams.where(F.size("sources") > 0).select("slug", "sources")
    tried = candidates.select("slug", F.lower("word").alias("nickname")).distinct().join(reach, "slug").select("slug", "sources", "nickname")
    return _hazards(tried, _held(teams), reserved)


def reserved_names(pro: DataFrame, floor: DataFrame) -> DataFrame:
    """nickname, owner: of pro rosters and a curated floor, whose word on the owner prevails."""
    rows = pro.select("nickname", "owner", F.lit(1).alias("p")).unionByName(floor.select("nickname", "owner", F.lit(0).alias("p")))
    return rows.groupBy(F.lower("nickname").alias("nickname")).agg(F.min_by("owner", F.struct("p", "owner")).alias("owner"))


def source_yield(articles: DataFrame, named: Column, kept: Column, by: tuple = ("source",)) -> DataFrame:
    """Per source, or by other columns such as the team: items, of them named, of them kept, and the percentage; a link counts once, for the first that has it."""
    flagged = articles.select("link", "list_ord", "pos", *by, named.alias("named"), (named & kept).alias("kept"))  # no text is shuffled
    return _yields(_firsts(flagged, ("link",), (*by, "named", "kept")), by)


def _firsts(flagged: DataFrame, keys: tuple, columns: tuple) -> DataFrame:
    """columns of the first row, in list order, of each of the keys."""
    return flagged.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("list_ord", "pos")).alias("_first")).select("_first.*")


def _yields(rows: DataFrame, by: tuple) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("named").alias("named"), F.count_if("kept").alias("kept"))
    return out.withColumn("pct", F.floor(100 * F.col("kept") / F.col("items") + 0.5).cast("long"))


def yield_funnel(articles: DataFrame, named: Column, kept: Column, least: int = 1) -> DataFrame:
    """team, source, level, items, named, kept, pct, diagnosis: what each source brings a team, and what each team gets in all.

    articles: team, source, link, list_ord, pos. level is source or team (with no source); on each a link counts once, for the first that has it there.
    """
    flagged = articles.select("team", "source", "link", "list_ord", "pos", named.alias("named"), (named & kept).alias("kept"))
    own = _yields(_firsts(flagged, ("team", "source", "link"), ("team", "source", "named", "kept")), ("team", "source")).withColumn("level", F.lit("source"))
    whole = _yields(_firsts(flagged, ("team", "link"), ("team", "named", "kept")), ("team",)).withColumns({"level": F.lit("team"), "source": F.lit(None).cast("string")})
    return diagnosed(own.unionByName(whole), least).select("team", "source", "level", "items", "named", "kept", "pct", "diagnosis")


def funnel_lines(funnel: DataFrame) -> DataFrame:
    """ord, line: the funnel as text, a team's line before those of its sources; ``stores.write_report`` writes them."""
    team, source = F.coalesce("team", F.lit("(none)")), F.coalesce("source", F.lit("(none)"))
    numbers = F.format_string("%d seen, %d named, %d kept (%d %%)", "items", "named", "kept", "pct")
    of_source = F.concat(F.lit("  "), source, F.lit(": "), numbers, F.coalesce(F.concat(F.lit(" - "), F.col("diagnosis")), F.lit("")))
    line = F.when(F.col("level") == "team", F.concat(team, F.lit(": "), F.col("kept").cast("string"), F.lit(" articles"))).otherwise(of_source)
    return funnel.select(F.struct(team.alias("team"), (F.col("level") != "team").alias("below"), source.alias("source")).alias("ord"), line.alias("line"))


def yield_groups(events: DataFrame, key: str = "group") -> DataFrame:
    """Yield events by group; passes without input aren't events."""
    rows = events.where("items_in > 0")
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("items_in").alias("items_in"), F.sum("items_out").alias("items_out"),
        F.bool_or(F.col("items_out") == 0).alias("any_zero"),
        F.bool_or(F.col("items_out") == F.col("items_in")).alias("any_full")
    )


def below_floor(yields: DataFrame, least: int) -> DataFrame:
    return yields.where(F.col("kept") < least)


def rescues(articles: DataFrame, names: list[str], nicknames: list[str]) -> DataFrame:
    """Kept articles without a school name, with the first nickname that let them in."""
    text = F.concat_ws(" ", "title", "description")
    hits = F.array_compact(F.array(*[F.when(T.contains_any(text, [n]), n) for n in nicknames]))
    return articles.where(~T.contains_any(text, names)).withColumn("nickname", F.get(hits, F.lit(0))).where("nickname IS NOT NULL")


def usefulness(rescued: DataFrame) -> DataFrame:
    return rescued.groupBy("nickname").agg(F.count("*").alias("rescues"), F.max("published").alias("last_at"))


def unhelpful(nicknames: DataFrame, rescued: DataFrame, seen_teams: DataFrame) -> DataFrame:
    """Nicknames that rescued nothing, of teams for which a local source was looked at."""
    return nicknames.join(seen_teams, "slug", "left_semi").join(rescued, "nickname", "left_anti")


def review_state(teams: DataFrame, reviewed: DataFrame) -> DataFrame:
    """slug, in_teams, in_reviewed, issue: entries on one side only are issues."""
    a, b = teams.select("slug", F.lit(True).alias("in_teams")).distinct(), reviewed.select("slug", F.lit(True).alias("in_reviewed")).distinct()
    rows = a.join(b, "slug", "full").fillna(False, ["in_teams", "in_reviewed"])
    return rows.withColumn("issue", F.when(~F.col("in_reviewed"), "unreviewed").when(~F.col("in_teams"), "unknown team"))


def sources_of_teams(teams: DataFrame, curated: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Teams with their curated sources, by slug through the aliases; a team without any stays."""
    return teams.withColumn("slug", T.aliased(F.col("short_name"), aliases)).join(curated, "slug", "left")


def catalog_of(leagues: DataFrame, sources: DataFrame) -> DataFrame:
    """Leagues with their national feeds; no feeds is an empty list."""
    feeds = sources.groupBy("league_id").agg(F.array_sort(F.collect_set("url")).alias("feeds"))
    return leagues.join(feeds, leagues["id"] == feeds["league_id"], "left").drop("league_id").withColumn("feeds", F.coalesce("feeds", F.array().cast("array<string>")))


def followed_leagues(keys: DataFrame) -> DataFrame:
    """Distinct leagues of favourite keys, in order."""
    return keys.select(T.favorite_parts(F.col("key"))["league_id"].alias("league_id")).where("league_id <> ''").distinct().orderBy("league_id")


def in_first_order(rows: DataFrame, by: str, pos: str = "pos") -> DataFrame:
    """Distinct values with the place where each came first, and whether all of them are planned."""
    return rows.groupBy(by).agg(F.min(pos).alias("first_pos"), F.bool_and(F.col("status") == "planned").alias("all_planned"))


def shaped_logs(events: DataFrame, column: str = "event") -> DataFrame:
    """Flat rows of log events held as JSON text; paths fall back from the newest form to the oldest."""
    v = F.try_parse_json(F.col(column))
    at = lambda *paths, kind="string": F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])
    url = at("$.event.request.url", "$.request.url", "$.url")
    return events.select(
        F.timestamp_millis(at("$.eventTimestamp", "$.timestamp", kind="bigint")).alias("at"), at("$.scriptName", "$.script").alias("script"), F.coalesce(at("$.outcome"), F.lit("unknown")).alias("outcome"),
        at("$.event.response.status", "$.response.status", "$.status", kind="int").alias("status"), at("$.event.request.method", "$.request.method", "$.method").alias("method"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), at("$.path")).alias("path"),
        at("$.cpuTime", "$.cpu_ms", kind="double").alias("cpu_ms"), at("$.wallTime", "$.wall_ms", kind="double").alias("wall_ms"), at("$.logs[0].level", "$.level").alias("level"), at("$.logs[0].message[0]", "$.logs[0].message", "$.message").alias("message"),
    )


def interesting(levels=("warn", "error")) -> Column:
    return (F.col("outcome") != "ok") | F.coalesce(F.col("level").isin(*levels), F.lit(False)) | F.coalesce(F.col("status") >= 400, F.lit(False))


def tallies(logs: DataFrame, columns=("path", "status", "outcome")) -> DataFrame:
    """dimension, value, n for each column, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("value")) for c in columns]))
    return logs.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def feed_status(bodies: DataFrame, slow_ms: int = 10_000) -> DataFrame:
    """status, format, items and slow of probed feeds (url, http_status, body, ms)."""
    body = F.coalesce("body", F.lit(""))
    kind = F.when(body.rlike(r"(?i)<rss\b|<channel\b"), "rss").when(body.rlike(r"(?i)<feed\b"), "atom").when(body.rlike(r"(?i)<urlset\b"), "sitemap")
    items = F.regexp_count(body, F.lit(r"(?i)<(?:item|entry|url)[\s>]"))
    status = F.when((F.col("http_status") < 200) | (F.col("http_status") >= 300) | F.col("http_status").isNull(), "HTTP").when(items == 0, "EMPTY").otherwise("OK")
    return bodies.withColumns({"format": kind, "items": items, "status": status, "slow": F.col("ms") > slow_ms})


def untriaged(feedback: DataFrame, ledger: DataFrame, build: str | None = None) -> DataFrame:
    rows = feedback if build is None else feedback.where(F.col("build") == build)
    return rows.join(ledger.select("id"), "id", "left_anti")


def over_cap(calls: DataFrame, cap: int) -> DataFrame:
    """Calls per UTC day, and whether the day's cap is reached."""
    return calls.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("calls")).withColumn("blocked", F.col("calls") >= cap)


def tally_order() -> list[Column]:
    """The largest first."""
    return [F.desc("n"), F.asc("dimension"), F.asc("value")]


def bounded_log(log: DataFrame, keep: int, at: str = "at") -> DataFrame:
    """The newest rows of a log, newest first."""
    return log.orderBy(F.desc(at)).limit(keep)


def review_counts(review: DataFrame, hazards: DataFrame) -> DataFrame:
    """How many teams are reviewed, not reviewed or unknown, and how many have hazards; review: review_state()."""
    bad = hazards.select("slug").distinct().withColumn("_bad", F.lit(True))
    rows = review.withColumn("slug", F.col("slug").cast("string")).join(bad, "slug", "left")
    return rows.agg(
        F.count_if(F.col("in_teams") & F.col("in_reviewed")).alias("reviewed"),
        F.count_if(F.col("issue") == "unreviewed").alias("unreviewed"),
        F.count_if(F.col("issue") == "unknown team").alias("unknown"),
        F.count_if(F.coalesce("_bad", F.lit(False))).alias("defects")
    )


def curated_slugs(tables: dict[str, DataFrame]) -> DataFrame:
    """slug, tables: each slug of any curated table with the names of those that have it."""
    out = None
    for name, rows in tables.items():
        own = rows.select("slug", F.lit(name).alias("_t"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("slug").agg(F.array_sort(F.collect_set("_t")).alias("tables"))


def available(leagues: DataFrame) -> DataFrame:
    return leagues.where("status = 'available'")


def under(leagues: DataFrame, sport: str | None = None, level: str | None = None, unfiled: str = "Other") -> DataFrame:
    """Leagues of a sport, and of a level in it; those without are unfiled."""
    rows = leagues.withColumns({"sport": F.coalesce("sport", F.lit(unfiled)), "level": F.coalesce("level", F.lit(unfiled))})
    for column, wanted in (("sport", sport), ("level", level)):
        rows = rows if wanted is None else rows.where(F.col(column) == wanted)
    return rows


def teams_of_favorites(keys: DataFrame, leagues: DataFrame, teams: DataFrame) -> DataFrame:
    """The teams of the known leagues of favourite keys."""
    wanted = keys.select(T.favorite_parts(F.col("key"))["league_id"].alias("league_id")).join(leagues.select(F.col("id").alias("league_id")), "league_id", "left_semi").distinct()
    return teams.join(wanted, "league_id", "left_semi")


def roster_snapshot(leagues: DataFrame) -> DataFrame:
    """Leagues with their teams, sorted by key, for a file that changes only where the rosters do."""
    team = F.struct("slug", "short_name", "display_name", "mascot")
    return leagues.groupBy("league_key").agg(F.array_sort(F.collect_set(team)).alias("teams")).orderBy("league_key")


def naming_gaps(yields: DataFrame, least_items: int = 20) -> DataFrame:
    """Sources with enough items of which none names the team: their names for it may be missing."""
    return yields.where((F.col("items") >= least_items) & (F.col("named") == 0))


def diagnosed(yields: DataFrame, least: int = 1) -> DataFrame:
    """yields with a diagnosis: nothing came, nothing named the team, filters took all, few stayed; null where enough did."""
    why = F.when(F.col("items") == 0, "empty").when(F.col("named") == 0, "not named").when(F.col("kept") == 0, "filtered").when(F.col("kept") < least, "few")
    return yields.withColumn("diagnosis", why)
