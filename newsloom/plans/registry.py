"""Queries of the domain's operators over the driver's tables, and their SQL twins.

Lexicons are words that the tables have; thresholds are scaled to their dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, numbers, text
from newsloom.operators import articles as A
from newsloom.operators import boards, claims, cluster, curation, games, tagging

from .base import QUERIES, SQL, query
from .views import NOW, SQL_ARTICLES, SQL_PAGES, SQL_PLAYS, articles, load, now, pages, plays

NAMES = ["with", "that", "para"]
COMMERCE, INSTITUTIONAL, ATHLETIC = ("worthless", "license"), ("that", "les"), ("the", "la")
SPORTS = {"football": ("with", "pour"), "basketball": ("was", "des"), "baseball": ("or", "und")}
CLAIMS = {"takes": ("worthless", "pathetic"), "evaluative": ("be",), "completed": ("was", "de"), "rumors": ("for", "und"), "service": ("to",)}
TEAMS = [
    {"league_id": "l", "team_id": "1", "short_name": "One", "names": ["of the", "the"]},
    {"league_id": "l", "team_id": "2", "short_name": "Two", "names": ["and", "und"]},
    {"league_id": "l", "team_id": "3", "short_name": "Three", "names": ["le", "la"]},
]
WORDS = lambda ws: "(?i)\\b(" + "|".join(ws) + ")\\b"
#: Sums and shares off a price, as DuckDB says it.
PRICES = "(\\$[0-9][0-9,.]*|\\b[0-9]{1,3}%)\\s*(off|or less)\\b"
T0 = f"TIMESTAMP '{NOW}'"
#: Words of the texts that titles don't differ by.
LANGUAGE = cluster.Words(stopwords=("the", "and", "for", "with", "from", "that", "this", "was", "are", "has", "its", "their", "after", "over"))


@query("name_filter", f"WITH {SQL_ARTICLES} SELECT link, title FROM a WHERE regexp_matches(title || ' ' || description, '{WORDS(NAMES)}')")
def name_filter(spark: SparkSession, sf: str) -> DataFrame:
    return A.naming(articles(spark, sf), NAMES).select("link", "title")


@query("name_filter_by_table", f"WITH {SQL_ARTICLES} SELECT link FROM a WHERE regexp_matches(title || ' ' || description, '{WORDS(['with', 'of the'])}')")
def name_filter_by_table(spark, sf):
    names = spark.createDataFrame([("with",), ("of the",)], "name string")
    return A.naming_any(articles(spark, sf), names).select("link")


@query("off_topic_filter", f"""WITH {SQL_ARTICLES} SELECT link, CASE WHEN regexp_matches(title, '{WORDS(COMMERCE)}|{PRICES}') OR regexp_matches(description, '{WORDS(COMMERCE)}|{PRICES}') THEN 'commerce'
  WHEN regexp_matches(title, '{WORDS(INSTITUTIONAL)}') AND NOT regexp_matches(title, '{WORDS(ATHLETIC)}') THEN 'institutional' END AS reason FROM a""")
def off_topic_filter(spark, sf):
    return articles(spark, sf).select("link", A.off_topic_reason(COMMERCE, INSTITUTIONAL, ATHLETIC).alias("reason"))


@query("other_sport_filter", f"""WITH {SQL_ARTICLES} SELECT link, CASE WHEN trim(title) = '' OR regexp_matches(title, '{WORDS(SPORTS["football"])}') THEN NULL
  WHEN regexp_matches(title, '{WORDS(SPORTS["basketball"])}') THEN 'basketball' WHEN regexp_matches(title, '{WORDS(SPORTS["baseball"])}') THEN 'baseball' END AS label FROM a""")
def other_sport_filter(spark, sf):
    return articles(spark, sf).select("link", A.other_sport("football", SPORTS).alias("label"))


@query("feed_window", f"WITH {SQL_ARTICLES} SELECT link, published FROM a WHERE published IS NULL OR {T0} - published <= INTERVAL 7 DAYS")
def feed_window(spark, sf):
    return articles(spark, sf).where(A.within_week(F.col("published").cast("timestamp"), now().cast("timestamp"))).select("link", "published")


@query("dedupe_first", f"""WITH {SQL_ARTICLES}, {SQL_PAGES}, u AS (SELECT link, pos, 1 AS list_ord FROM a UNION ALL SELECT link, pos, 0 AS list_ord FROM pg UNION ALL SELECT link, pos, 2 AS list_ord FROM a UNION ALL SELECT link, pos, 3 AS list_ord FROM pg)
SELECT link, list_ord::INT AS list_ord FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY list_ord, pos) AS n FROM u) WHERE n = 1""")
def dedupe_first(spark, sf):
    a, p = articles(spark, sf).select("link", "pos"), pages(spark, sf).select("link", "pos")
    return A.first_of_each(A.union_lists([p, a, a, p])).select("link", "list_ord")


@query("syndication_tier", f"""WITH {SQL_ARTICLES}, s AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 'Wire' WHEN pos % 7 = 0 THEN upper(source) END AS item_source FROM a)
SELECT link, CASE WHEN item_source IS NOT NULL AND lower(item_source) <> lower(source) THEN item_source ELSE source END AS source,
  CASE WHEN item_source IS NOT NULL AND lower(item_source) <> lower(source) THEN 0 ELSE tier END AS tier, CASE WHEN scope = 'team' THEN 'beat' ELSE 'national' END AS reach, scope FROM s""")
def syndication_tier(spark, sf):
    other = F.when(F.col("pos") % 5 == 0, F.lit("Wire")).when(F.col("pos") % 7 == 0, F.upper("source"))
    rows = articles(spark, sf).withColumns({"item_source": other, "reach": F.lit(None).cast("string")})
    return A.credited(rows).select("link", "source", "tier", "reach", "scope")


SQL_TOKENS = """tk AS (
  SELECT link, list_distinct(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(lower(title), '[^\\p{L}\\p{N}-]+', ' ', 'g'), ' +'), lambda t: regexp_replace(t, '^-+|-+$', '', 'g')),
           lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'was', 'are', 'has', 'its', 'their', 'after', 'over')),
         lambda t: CASE WHEN length(t) >= 5 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) >= 5 AND regexp_matches(t, '(?:s|x|z|ch|sh)es$') THEN left(t, length(t) - 2)
                        WHEN length(t) >= 5 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)) AS tokens, pos, published
  FROM a
), w AS (SELECT link, unnest(tokens) AS token FROM tk),
wt AS (SELECT token, count(*) AS df, greatest(ln((SELECT count(DISTINCT link) FROM w) / (1 + count(*))), 0.05) AS weight FROM w GROUP BY token)"""


def feed(spark, sf):
    return articles(spark, sf).withColumns(
        {"feed": F.lit("all"), "published": F.col("published").cast("timestamp"), "reach": F.when(F.col("scope") == "team", "beat").otherwise("national")}
    )


@query("title_tokens", f"WITH {SQL_ARTICLES}, {SQL_TOKENS} SELECT link, token FROM w")
def title_tokens(spark, sf):
    return cluster.tokens_of(feed(spark, sf), LANGUAGE).select("link", "token")


@query("idf_weights", f"WITH {SQL_ARTICLES}, {SQL_TOKENS} SELECT token, df, round(weight, 6) AS weight FROM wt")
def idf_weights(spark, sf):
    return cluster.weights_of(cluster.tokens_of(feed(spark, sf), LANGUAGE)).select("token", "df", F.round("weight", 6).alias("weight"))


@query("upper_median", f"WITH {SQL_ARTICLES}, {SQL_TOKENS} SELECT round(weight, 6) AS median FROM (SELECT weight, row_number() OVER (ORDER BY weight, token) - 1 AS rn, count(*) OVER () AS n FROM wt) WHERE rn = n // 2")
def upper_median(spark, sf):
    return cluster.upper_median(cluster.weights_of(cluster.tokens_of(feed(spark, sf), LANGUAGE))).select(F.round("median", 6).alias("median"))


SQL_PAIRS = """x AS (SELECT w.link, w.token, wt.weight, wt.weight >= (SELECT weight FROM (SELECT weight, row_number() OVER (ORDER BY weight, token) - 1 AS rn, count(*) OVER () AS n FROM wt) WHERE rn = n // 2) AS rare, tk.published
  FROM w JOIN wt USING (token) JOIN tk USING (link)),
s AS (SELECT link, sum(weight) AS total, count(*) FILTER (WHERE rare) AS rares FROM x GROUP BY link),
m AS (SELECT x.link AS anchor, y.link AS link, count(*) AS shared, count(*) FILTER (WHERE x.rare) AS rare_shared, sum(x.weight) AS sh
  FROM x JOIN x y ON x.token = y.token AND (x.published > y.published OR (x.published = y.published AND x.link < y.link)) AND x.published - y.published <= INTERVAL 36 HOURS GROUP BY 1, 2),
pr AS (SELECT m.anchor, m.link, m.shared, m.rare_shared, least(s1.rares, s2.rares) AS rare_least, 2 * m.sh / (s1.total + s2.total) AS dice FROM m JOIN s s1 ON s1.link = m.anchor JOIN s s2 ON s2.link = m.link)"""


@query("pair_score", f"WITH {SQL_ARTICLES}, {SQL_TOKENS}, {SQL_PAIRS} SELECT anchor, link, shared, round(dice, 6) AS dice FROM pr WHERE shared >= 3")
def pair_score(spark, sf):
    """All pairs with three tokens in common, of all documents by their whole first lines."""
    pairs = cluster.pair_scores(feed(spark, sf), LANGUAGE)
    return pairs.where("shared >= 3").select("anchor", "link", "shared", F.round("dice", 6).alias("dice"))


#: Anchors in order, each taking what it links to unless it is taken; then the lead of each cluster as a fold over its members.
SQL_ROLLUP = f"""WITH RECURSIVE {SQL_ARTICLES}, {SQL_TOKENS}, {SQL_PAIRS},
n AS (SELECT link, source, tier, scope = 'team' AS beat, published, row_number() OVER (ORDER BY published DESC NULLS LAST, link) AS pos FROM a),
e AS (SELECT na.pos AS a, nb.pos AS b FROM pr JOIN n na ON na.link = pr.anchor JOIN n nb ON nb.link = pr.link
  WHERE (rare_shared >= 2 OR shared >= 3) AND (rare_least = 0 OR rare_shared / rare_least >= 0.5) AND dice >= 0.55),
v AS MATERIALIZED (SELECT a, list(b) AS bs, row_number() OVER (ORDER BY a) AS k FROM e GROUP BY a),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT v.k, CASE WHEN list_contains(taken, v.a) THEN taken ELSE list_concat(taken, v.bs) END FROM g JOIN v ON v.k = g.k + 1),
t AS (SELECT DISTINCT unnest(taken) AS b FROM (SELECT taken FROM g ORDER BY k DESC LIMIT 1)),
h AS (SELECT e.b, min(e.a) AS home FROM e WHERE e.a NOT IN (SELECT b FROM t) GROUP BY e.b),
c AS (SELECT n.*, coalesce(home, pos) AS anchor_pos, CASE WHEN date_trunc('day', published) = published THEN epoch(published) + 86399.999 ELSE epoch(published) END AS stamp FROM n LEFT JOIN h ON b = pos),
l AS (SELECT anchor_pos, count(*) - 1 AS dups, max(published) AS latest,
  list_reduce(list({{'stamp': stamp, 'key': {{'tier': tier, 'far': NOT beat, 'link': link}}, 'source': source}} ORDER BY pos), lambda x, y: CASE WHEN CASE WHEN abs(y.stamp - x.stamp) <= 300 THEN y.key < x.key ELSE y.stamp < x.stamp END THEN y ELSE x END) AS best
  FROM c GROUP BY anchor_pos),
o AS (SELECT anchor_pos, list(source ORDER BY first) AS others FROM (SELECT c.anchor_pos, c.source, min(c.pos) AS first FROM c JOIN l USING (anchor_pos) WHERE c.source IS DISTINCT FROM l.best.source GROUP BY 1, 2) GROUP BY 1)
SELECT best.key.link AS lead, dups::INT AS duplicate_count, coalesce(others, []) AS also_covered_by, latest AS latest_published_at, anchor_pos::INT AS anchor_pos FROM l LEFT JOIN o USING (anchor_pos)"""


@query("cluster_rollup", SQL_ROLLUP)
def cluster_rollup(spark, sf):
    """All documents by their whole first lines, as one feed."""
    rows = feed(spark, sf)
    rolled = cluster.rolled_up(rows, cluster.clusters(rows, None, LANGUAGE))
    return rolled.select("lead", "duplicate_count", "also_covered_by", F.col("latest_published_at").cast("timestamp_ntz").alias("latest_published_at"), "anchor_pos")


@query("claim_type", f"""WITH {SQL_ARTICLES}, v AS (SELECT doc_id, min(CASE WHEN toxic = 1 THEN 'rumor' ELSE 'take' END) AS remote FROM labels GROUP BY doc_id), f AS (
  SELECT a.*, v.remote, regexp_matches(title, '{WORDS(CLAIMS["takes"])}') AS tk, regexp_matches(title, '{WORDS(CLAIMS["evaluative"])}') AS ev, regexp_matches(title, '{WORDS(CLAIMS["completed"])}') AS co,
         regexp_matches(title, '{WORDS(CLAIMS["rumors"])}') OR regexp_matches(description, '{WORDS(CLAIMS["rumors"])}') AS ru, rtrim(title) LIKE '%?' AND NOT regexp_matches(title, '{WORDS(CLAIMS["service"])}') AS qu
  FROM a LEFT JOIN v ON v.doc_id = a.pos)
SELECT link, CASE WHEN tk OR (NOT ev AND co) OR ru OR qu THEN 'evidence' ELSE 'default' END AS basis,
  CASE WHEN tk THEN 'take' WHEN NOT ev AND co THEN 'reported' WHEN ru THEN 'rumor' WHEN qu THEN 'take' ELSE coalesce(remote, 'unlabeled') END AS claim_type FROM f""")
def claim_type(spark, sf):
    labels = load(spark, sf, "labels").groupBy(F.col("doc_id").alias("pos")).agg(F.min(F.when(F.col("toxic") == 1, "rumor").otherwise("take")).alias("remote"))
    rows = articles(spark, sf).join(labels, "pos", "left")
    return rows.select("link", claims.local_claim(CLAIMS)["basis"].alias("basis"), claims.merged_claim(F.col("remote"), CLAIMS).alias("claim_type"))


SQL_TAGGED = "list_filter([CASE WHEN regexp_matches({0}, '(?i)\\b(of the|the)\\b') THEN 'One' END, CASE WHEN regexp_matches({0}, '(?i)\\b(and|und)\\b') THEN 'Two' END, CASE WHEN regexp_matches({0}, '(?i)\\b(le|la)\\b') THEN 'Three' END], lambda x: x IS NOT NULL)"


@query("team_tag", f"""WITH {SQL_ARTICLES}, m AS (SELECT link, {SQL_TAGGED.format("title")} AS t, {SQL_TAGGED.format("description")} AS d FROM a), l AS (SELECT link, list_concat(t, list_filter(d, lambda x: NOT list_contains(t, x))) AS teams FROM m)
SELECT link, teams[1] AS mentioned, array_to_string(teams, ',') AS mentioned_all FROM l""")
def team_tag(spark, sf):
    rows = tagging.tagged(articles(spark, sf), TEAMS)
    return rows.select("link", F.col("mentioned_team.short_name").alias("mentioned"), F.array_join("mentioned_teams.short_name", ",").alias("mentioned_all"))


PLAYERS = ["Of The", "An Anthat", "That", "Elle Pour", "Und Der"]


@query("player_match", f"""WITH {SQL_ARTICLES}, n AS (SELECT unnest({PLAYERS}) AS name), s AS (SELECT name, lower(string_split(name, ' ')[-1]) AS word, count(*) OVER (PARTITION BY lower(string_split(name, ' ')[-1])) AS bearers FROM n),
t AS (SELECT link, ' ' || regexp_replace(lower(title || ' ' || description), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g') || ' ' AS text FROM a),
k AS (SELECT name, link, CASE WHEN contains(text, ' ' || lower(name) || ' ') THEN 'full' WHEN length(word) >= 5 AND bearers = 1 AND contains(text, ' ' || word || ' ') THEN 'surname' END AS kind FROM t, s)
SELECT name, link, kind FROM (SELECT *, bool_or(kind = 'full') OVER (PARTITION BY name) AS f FROM k WHERE kind IS NOT NULL) WHERE kind = 'full' OR NOT f""")
def player_match(spark, sf):
    return tagging.player_matches(articles(spark, sf), spark.createDataFrame([(n,) for n in PLAYERS], "name string"))


@query("leader_boards", """WITH r AS (SELECT p_brand, l_suppkey, sum((l_extendedprice * 100)::BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cents DESC, l_suppkey) AS rank FROM r)
SELECT p_brand, l_suppkey AS s_suppkey, s_name, place FROM (SELECT k.*, s_name, row_number() OVER (PARTITION BY p_brand ORDER BY rank, l_suppkey) AS place FROM k JOIN supplier ON l_suppkey = s_suppkey) WHERE place <= 3""")
def leader_boards(spark, sf):
    revenue = load(spark, sf, "lineitem").join(
        load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).groupBy("p_brand", "l_suppkey").agg(F.sum((F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    ranked = revenue.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("cents"), "l_suppkey")))
    leaders = ranked.select(
        F.lit(1).alias("team_id"), F.col("p_brand").alias("category"), F.col("p_brand").alias("title"), F.col("l_suppkey").alias("athlete_id"),
        "rank", F.lit(0).alias("pos")
    )
    roster = load(spark, sf, "supplier").select(F.lit(1).alias("team_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"))
    return boards.leader_boards(leaders, roster).select(F.col("category").alias("p_brand"), F.col("athlete_id").alias("s_suppkey"), F.col("full_name").alias("s_name"), "place")


@query("schedule_odds", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F'), o AS (SELECT l_orderkey, max(l_quantity) AS over_under FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, over_under, CASE WHEN o_totalprice > 100000 THEN 'W' WHEN o_totalprice < 100000 THEN 'L' ELSE 'T' END AS result FROM s LEFT JOIN o ON o_orderkey = l_orderkey WHERE n <= 5""")
def schedule_odds(spark, sf):
    orders = load(spark, sf, "orders")
    schedule = orders.select(
        F.col("o_custkey").alias("team_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("kickoff"),
        F.when(F.col("o_orderstatus") == "F", "post").otherwise("pre").alias("state"), "o_totalprice"
    )
    odds = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("over_under"))
    no = F.lit(None).cast("boolean")
    return games.upcoming_with_odds(schedule, odds).select(
        F.col("id").alias("o_orderkey"), F.col("team_id").alias("o_custkey"), "over_under",
        games.result_of(no, no, F.col("o_totalprice"), F.lit(100000.0)).alias("result")
    )


SQL_DELTA = f"""{SQL_PLAYS}, q AS (SELECT *, CASE WHEN type <> 'error' THEN home_win_pct - last_value(home_win_pct IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS delta FROM p)"""


@query("win_prob_delta", f"WITH {SQL_DELTA} SELECT play_id AS event_id, round(delta, 9) AS delta FROM q")
def win_prob_delta(spark, sf):
    return games.deltas(plays(spark, sf), ("error",)).select(F.col("play_id").alias("event_id"), F.round("delta", 9).alias("delta"))


@query("turning_point", f"WITH {SQL_DELTA} SELECT game_id AS user_id, play_id AS event_id, round(delta, 9) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY abs(delta) DESC, pos) AS n FROM q WHERE abs(delta) >= 0.05) WHERE n = 1")
def turning_point(spark, sf):
    return games.turning_points(plays(spark, sf), clock_kinds=("error",)).select(
        F.col("game_id").alias("user_id"), F.col("play_id").alias("event_id"), F.round("delta", 9).alias("delta")
    )


@query("since_marker", f"""WITH {SQL_PLAYS}, m AS (SELECT game_id, min(pos) AS mpos FROM p WHERE type = 'purchase' GROUP BY 1), r AS (SELECT p.*, mpos FROM p LEFT JOIN m USING (game_id))
SELECT game_id AS user_id, bool_or(mpos IS NOT NULL) AS marker_found, count(*) FILTER (WHERE mpos IS NULL OR pos > mpos) AS new_events, coalesce(greatest(max(CASE WHEN mpos IS NULL OR pos >= mpos THEN 5 - points END), 0), 0) AS max_drop FROM r GROUP BY 1""")
def since_marker(spark, sf):
    rows = plays(spark, sf).withColumns({"home_score": F.col("points"), "away_score": F.lit(5), "period": F.lit(1)})
    first = rows.where("type = 'purchase'").groupBy("game_id").agg(F.min_by("play_id", "pos").alias("play_id"))
    return games.swings(rows, first).select(
        F.col("game_id").alias("user_id"), "marker_found", "new_plays", "home_deficit"
    ).toDF("user_id", "marker_found", "new_events", "max_drop")


@query("trailing_run", f"WITH {SQL_PLAYS} SELECT game_id AS user_id, count(*) FILTER (WHERE b = 0) AS run_len FROM (SELECT game_id, sum((type <> 'view')::INT) OVER (PARTITION BY game_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS b FROM p) GROUP BY 1")
def trailing_run(spark, sf):
    drives = plays(spark, sf).withColumns({"outcome": F.col("type"), "is_current": F.lit(False)})
    return games.trailing_run(drives, "view").select(F.col("game_id").alias("user_id"), "run_len")


SQL_MERGED = f"""{SQL_ARTICLES}, {SQL_PAGES}, st AS (SELECT team, link, published, TIMESTAMP '2024-01-01 06:00:00' AS seen FROM a UNION ALL SELECT team, link, NULL, TIMESTAMP '2024-01-01 06:00:00' + to_hours(page_id) FROM pg JOIN pages ON page_id = pos),
merged AS (SELECT a.team, a.link, a.published, coalesce(st.seen, {T0}) AS first_seen FROM a LEFT JOIN st USING (team, link)
  UNION ALL SELECT team, link, published, seen FROM st WHERE {T0} - coalesce(published, seen) <= INTERVAL 7 DAYS AND NOT EXISTS (SELECT 1 FROM a f WHERE f.link = st.link AND f.team = st.team))"""


@query("retention_merge", f"WITH {SQL_MERGED} SELECT team, link, first_seen, row_number() OVER (PARTITION BY team ORDER BY published DESC NULLS LAST, link) AS rn FROM merged")
def retention_merge(spark, sf):
    """All documents are fresh; all of them, and all pages, are stored."""
    fresh = articles(spark, sf).select("team", "link", F.col("published").cast("timestamp").alias("published"))
    begin = F.lit("2024-01-01 06:00:00").cast("timestamp")
    old = pages(spark, sf).select(
        "team", "link", F.col("published").cast("timestamp").alias("published"),
        (begin + F.make_dt_interval(hours=F.col("pos").cast("int"))).alias("first_seen")
    )
    stored = fresh.withColumn("first_seen", begin).unionByName(old)
    return A.merged_with_stored(fresh, stored, now().cast("timestamp")).select("team", "link", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "rn")


@query("lru_evict", "SELECT user_id, row_number() OVER (ORDER BY m DESC, user_id) > 50 AS evicted FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1)")
def lru_evict(spark, sf):
    return A.least_recent(load(spark, sf, "events").select("user_id", F.col("ts").alias("used_at")), "user_id").select("user_id", "evicted")


@query("read_split", f"WITH {SQL_ARTICLES} SELECT CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.pos) THEN 'read' ELSE 'unread' END AS section, count(*) AS n FROM a GROUP BY 1")
def read_split(spark, sf):
    marks = load(spark, sf, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("link"))
    return A.split_brief(articles(spark, sf), marks).groupBy("section").agg(F.count("*").alias("n"))


@query("source_yield", f"""WITH {SQL_ARTICLES}, f AS (SELECT source, regexp_matches(title || ' ' || description, '{WORDS(NAMES)}') AS named, NOT regexp_matches(title, '{WORDS(COMMERCE)}') AS keep FROM a)
SELECT *, floor(100 * kept / items + 0.5)::BIGINT AS pct FROM (SELECT source, count(*) AS items, count(*) FILTER (WHERE named) AS named, count(*) FILTER (WHERE named AND keep) AS kept FROM f GROUP BY 1)""")
def source_yield(spark, sf):
    rows = articles(spark, sf).withColumn("list_ord", F.lit(0))
    return curation.source_yield(rows, text.contains_any(A.title_and_description(), NAMES), ~text.contains_any(F.col("title"), list(COMMERCE)))


@query("yield_funnel", f"""WITH {SQL_ARTICLES}, f AS (SELECT team, source, link, regexp_matches(title || ' ' || description, '{WORDS(NAMES)}') AS n, NOT regexp_matches(title, '{WORDS(COMMERCE)}') AS k FROM a),
y AS (SELECT team, source, CASE WHEN grouping(source) = 1 THEN 'team' ELSE 'source' END AS level, count(DISTINCT link) AS items, count(DISTINCT CASE WHEN n THEN link END) AS named, count(DISTINCT CASE WHEN n AND k THEN link END) AS kept FROM f GROUP BY GROUPING SETS ((team, source), (team)))
SELECT *, floor(100 * kept / items + 0.5)::BIGINT AS pct, CASE WHEN named = 0 THEN 'not named' WHEN kept = 0 THEN 'filtered' WHEN kept < 5 THEN 'few' END AS diagnosis FROM y""")
def yield_funnel(spark, sf):
    """Two lists of the same articles, so that each link comes twice and counts once."""
    a = articles(spark, sf)
    return curation.yield_funnel(A.union_lists([a, a]), text.contains_any(A.title_and_description(), NAMES), ~text.contains_any(F.col("title"), list(COMMERCE)), 5)


@query("nickname_hazards", """WITH t AS (SELECT 's' || s_suppkey AS slug, 'n' || (s_suppkey % 7) AS nickname, ['f' || (s_suppkey % 3)] AS sources FROM supplier)
SELECT slug, nickname, 'reserved' AS kind, 'owner' AS detail FROM t WHERE nickname = 'n1' UNION
SELECT x.slug, x.nickname, CASE WHEN x.sources = y.sources THEN 'shared-source' ELSE 'contested' END, CASE WHEN x.sources = y.sources THEN y.slug || ',' || x.sources[1] ELSE y.slug END FROM t x JOIN t y ON x.nickname = y.nickname AND x.slug <> y.slug""")
def nickname_hazards(spark, sf):
    key = F.col("s_suppkey")
    teams = load(spark, sf, "supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("slug"),
        F.array(F.concat(F.lit("N"), (key % 7).cast("string"))).alias("nicknames"),
        F.array(F.concat(F.lit("f"), (key % 3).cast("string"))).alias("sources")
    )
    return curation.nickname_hazards(teams, spark.createDataFrame([("N1", "owner")], "nickname string, owner string"))


@query("period_refresh", """SELECT strftime(ts - INTERVAL 5 HOURS, '%Y-%m-%d') || ':' || CASE WHEN hour(ts) BETWEEN 5 AND 10 THEN 'morning' WHEN hour(ts) BETWEEN 11 AND 16 THEN 'midday' ELSE 'evening' END AS period_key, count(*) AS n FROM events GROUP BY 1""")
def period_refresh(spark, sf):
    return load(spark, sf, "events").groupBy(dates.period_key(F.col("ts")).alias("period_key")).agg(F.count("*").alias("n"))


@query("verdict_cache_key", f"WITH {SQL_ARTICLES} SELECT link, 'v1:' || sha256(trim(regexp_replace(lower(title), '\\s+', ' ', 'g'))) AS key FROM a")
def verdict_cache_key(spark, sf):
    return articles(spark, sf).select("link", text.cache_key(F.col("title")).alias("key"))


@query("page_text", """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '(?is)<img\\b[^>]*?\\bsrc\\s*=\\s*["'']([^"'']+)["'']', 1), '') AS first_img,
  length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_len FROM pages""")
def page_text(spark, sf):
    html = F.col("html")
    return load(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), text.first_image(html).alias("first_img"),
        F.length(text.squash(F.regexp_replace(html, "<[^>]*>", " "))).alias("text_len")
    )


#: DuckDB's form of the references, the ampersand's last; the tables have none by number.
SQL_DECODED = "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
for _name, _char in text.ENTITIES.items():
    if _name != "amp":
        SQL_DECODED = f"replace({SQL_DECODED}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("page_decoded", f"SELECT page_id, length(replace({SQL_DECODED}, '&amp;', '&')) AS decoded_len FROM pages")
def page_decoded(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).alias("decoded_len"))


@query("truncated_teaser", f"""WITH {SQL_ARTICLES}, h AS (SELECT link, description AS t, substr(description, 1, 100) AS head FROM a)
SELECT link, CASE WHEN length(t) <= 100 THEN t ELSE regexp_replace(CASE WHEN contains(head, ' ') AND length(head) - length(regexp_extract(head, ' ([^ ]*)$', 1)) - 1 > 50 THEN substr(head, 1, length(head) - length(regexp_extract(head, ' ([^ ]*)$', 1)) - 1) ELSE head END, '\\s+$', '') || '…' END AS teaser FROM h""")
def truncated_teaser(spark, sf):
    return articles(spark, sf).select("link", text.truncated(F.col("description"), 100).alias("teaser"))


@query("log_tallies", "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM events GROUP BY 2")
def log_tallies(spark, sf):
    return curation.tallies(load(spark, sf, "events"), ("event_type", "user_id"))


@query("source_slugs", "SELECT DISTINCT source, trim(regexp_replace(lower(source || ' St. ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def source_slugs(spark, sf):
    d = load(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    return d.select("source", text.slug(F.concat_ws(" St. ", "source", "lang")).alias("slug")).distinct()


@query("season_counts", "SELECT year(o_orderdate) - (month(o_orderdate) < 8)::INT AS season, count(*) AS n FROM orders GROUP BY 1")
def season_counts(spark, sf):
    return load(spark, sf, "orders").groupBy(dates.season_of(F.col("o_orderdate"), F.lit(8)).alias("season")).agg(F.count("*").alias("n"))


@query("relative_labels", f"""WITH {SQL_ARTICLES}, s AS (SELECT link, published, epoch({T0}) - epoch(published) AS sec FROM a)
SELECT link, CASE WHEN published IS NULL THEN '' WHEN floor(sec / 60 + 0.5) < 1 THEN 'just now' WHEN floor(sec / 60 + 0.5) < 60 THEN floor(sec / 60 + 0.5)::BIGINT || 'm ago' WHEN floor(sec / 3600 + 0.5) < 24 THEN floor(sec / 3600 + 0.5)::BIGINT || 'h ago'
  WHEN floor(sec / 86400 + 0.5) < 7 THEN floor(sec / 86400 + 0.5)::BIGINT || 'd ago' ELSE strftime(published, '%b %-d') END AS label FROM s""")
def relative_labels(spark, sf):
    return articles(spark, sf).select("link", dates.relative_label(F.col("published").cast("timestamp"), now().cast("timestamp")).alias("label"))


@query("contrast", """WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part),
l AS (SELECT p_partkey, list_transform([r, g, b], lambda x: CASE WHEN x / 255 <= 0.04045 THEN x / 255 / 12.92 ELSE pow((x / 255 + 0.055) / 1.055, 2.4) END) AS v FROM c)
SELECT p_partkey, round(1.05 / (0.2126 * v[1] + 0.7152 * v[2] + 0.0722 * v[3] + 0.05), 6) AS ratio FROM l""")
def contrast(spark, sf):
    key = F.col("p_partkey")
    colour = F.concat(*[F.lpad(F.lower(F.hex((key * m) % 256)), 2, "0") for m in (37, 91, 13)])
    return load(spark, sf, "part").select("p_partkey", F.round(numbers.contrast(F.lit("#ffffff"), colour), 6).alias("ratio"))


@query("visible_colours")
def visible_colours(spark, sf):
    key = F.col("p_partkey")
    colour = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex((key * m) % 256)), 2, "0") for m in (37, 91, 13)])
    return load(spark, sf, "part").select("p_partkey", colour.alias("colour"), numbers.visible_on(colour, "#101418").alias("visible"))


@query("balanced_feed")
def balanced_feed(spark, sf):
    day = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("undated"))
    team = F.concat_ws(" ", "team", day, F.when(F.col("published").isNull(), F.floor(F.col("pos") / 10_000).cast("string")))  # the undated by runs of places
    rows = articles(spark, sf).select(team.alias("feed"), "link", "source", F.lit(0).alias("list_ord"), "pos")
    return A.balanced(rows).select("feed", "link", "source", "rank")


@query("coverage", f"WITH {SQL_ARTICLES} SELECT count(DISTINCT source) + 1 AS configured, count(DISTINCT CASE WHEN tier = 1 THEN source END) AS contributing FROM a")
def coverage(spark, sf):
    rows = articles(spark, sf)
    curated = rows.select(F.col("source").alias("name")).unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return A.coverage(rows.where("tier = 1"), curated)


@query("review_audit", "SELECT coalesce(s.k, c.k) AS slug, s.k IS NOT NULL AS in_teams, c.k IS NOT NULL AS in_reviewed, CASE WHEN c.k IS NULL THEN 'unreviewed' WHEN s.k IS NULL THEN 'unknown team' END AS issue FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) s FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM customer ) c ON s.k = c.k")
def review_audit(spark, sf):
    return curation.review_state(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("slug")), load(spark, sf, "customer").select(F.col("c_nationkey").alias("slug")))


@query("followed_ticker", """WITH g AS (SELECT o_orderkey AS id, o_custkey AS home, o_custkey + 1 AS away, CASE o_orderstatus WHEN 'O' THEN 'pre' WHEN 'F' THEN 'post' ELSE 'in' END AS state FROM orders)
SELECT id, state, CASE WHEN home IN (SELECT s_suppkey FROM supplier) THEN 'home' ELSE 'away' END AS followed_side FROM g WHERE home IN (SELECT s_suppkey FROM supplier) OR away IN (SELECT s_suppkey FROM supplier)""")
def followed_ticker(spark, sf):
    """Followed are the teams of a table, the suppliers."""
    o = load(spark, sf, "orders")
    rows = o.select(
        F.lit("l").alias("league_id"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("home_id"), (F.col("o_custkey") + 1).alias("away_id"),
        F.when(F.col("o_orderstatus") == "O", "pre").when(F.col("o_orderstatus") == "F", "post").otherwise("in").alias("state")
    )
    followed = load(spark, sf, "supplier").select(F.lit("l").alias("league_id"), F.col("s_suppkey").alias("team_id")).distinct()
    return games.followed_games(rows, followed).select("id", "state", "followed_side")


@query("yield_groups", "SELECT event_type AS \"group\", count(*) AS n, sum(user_id) AS items_in, sum(user_id % 3) AS items_out, bool_or(user_id % 3 = 0) AS any_zero, bool_or(user_id % 3 = user_id) AS any_full FROM events WHERE user_id > 0 GROUP BY 1")
def yield_groups(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("group"), F.col("user_id").alias("items_in"), (F.col("user_id") % 3).alias("items_out"))
    return curation.yield_groups(e)


@query("events_watermark", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def events_watermark(spark, sf):
    """An extension: the batch twin of the windowed stream."""
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("drive_outcomes", """WITH r AS (SELECT ['TD', 'touchdown', ' fg ', 'FIELD GOAL', 'MISSED FG', 'Blocked FG', 'FG MISSED', 'PUNT', 'BLOCKED PUNT', 'INT', 'FUMBLE LOST', 'TO', 'DOWNS', 'SAFETY', 'INT TD', 'BLOCKED FG TD', 'PUNT RETURN TD', 'END OF HALF', 'NEW', ''] AS results,
  ['touchdown', 'touchdown', 'field_goal', 'field_goal', 'missed_kick', 'missed_kick', 'missed_kick', 'punt', 'punt', 'turnover', 'turnover', 'turnover', 'downs', 'safety', 'return_touchdown', 'return_touchdown', 'return_touchdown', 'period_end', 'other', 'other'] AS outcomes)
SELECT o_orderkey, results[1 + o_orderkey % 20] AS result, outcomes[1 + o_orderkey % 20] AS outcome FROM orders, r""")
def drive_outcomes(spark, sf):
    results = [
        "TD", "touchdown", " fg ", "FIELD GOAL", "MISSED FG", "Blocked FG", "FG MISSED", "PUNT", "BLOCKED PUNT", "INT",
        "FUMBLE LOST", "TO", "DOWNS", "SAFETY", "INT TD", "BLOCKED FG TD", "PUNT RETURN TD", "END OF HALF", "NEW", ""
    ]
    result = F.get(F.array(*[F.lit(r) for r in results]), (F.col("o_orderkey") % 20).cast("int"))
    return load(spark, sf, "orders").select("o_orderkey", result.alias("result"), games.outcome(result).alias("outcome"))


@query("feed_dates", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 5 HOURS WHEN 2 THEN date_trunc('minute', o_orderdate) WHEN 3 THEN o_orderdate - INTERVAL 2 HOURS END AS published FROM orders""")
def feed_dates(spark, sf):
    """Order dates as feeds write them: with a zone by name, as pages render them, with an offset; a day that isn't, and no date."""
    at = F.col("o_orderdate").cast("timestamp")
    form = lambda f: F.date_format(at, f)
    rest = F.when(F.col("o_orderkey") % 6 == 4, F.concat(F.lit("Monday, February 30, "), form("yyyy"), F.lit(" - 09:00"))).otherwise(F.concat(F.lit("coming in "), form("MMMM")))
    body = (
        F.when(F.col("o_orderkey") % 6 == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderkey") % 6 == 1, form("EEE, d MMM yyyy HH:mm:ss 'EST'"))
        .when(F.col("o_orderkey") % 6 == 2, form("EEEE, MMMM d, yyyy - HH:mm"))
        .when(F.col("o_orderkey") % 6 == 3, form("dd MMM yyyy HH:mm:ss '+0200'"))
        .otherwise(rest)
    )
    return load(spark, sf, "orders").select("o_orderkey", dates.feed_date(body).cast("timestamp_ntz").alias("published"))


@query("catch_up", f"""WITH {SQL_PLAYS}, d AS (SELECT *, (pos - 1) // 4 AS drive_pos, max(pos) OVER (PARTITION BY game_id) AS final FROM p),
m AS (SELECT game_id, min(pos) AS mpos, min((pos - 1) // 4) AS mdrive FROM d WHERE type = 'purchase' GROUP BY 1),
x AS (SELECT d.*, mpos, mdrive FROM d LEFT JOIN m USING (game_id)),
dr AS (SELECT game_id, drive_pos, any_value(mdrive) AS mdrive, any_value(mpos) AS mpos, max(pos) AS last_pos, any_value(final) AS final FROM x GROUP BY 1, 2),
dn AS (SELECT game_id, count(*) FILTER (WHERE mdrive IS NULL OR drive_pos > mdrive OR (drive_pos = mdrive AND last_pos > mpos)) AS new_drives,
  count(*) FILTER (WHERE drive_pos < mdrive OR (drive_pos = mdrive AND last_pos = mpos AND last_pos < final)) AS earlier_drives FROM dr GROUP BY 1),
w AS (SELECT game_id, arg_max(home_win_pct, pos) FILTER (WHERE home_win_pct IS NOT NULL AND pos <= mpos) AS at_marker, arg_min(home_win_pct, pos) FILTER (WHERE home_win_pct IS NOT NULL) AS first_pct,
  arg_max(home_win_pct, pos) FILTER (WHERE home_win_pct IS NOT NULL) AS to_pct, count(*) FILTER (WHERE mpos IS NULL OR pos > mpos) AS new_plays FROM x GROUP BY 1)
SELECT game_id AS user_id, new_drives, earlier_drives, new_plays, round(coalesce(at_marker, first_pct), 9) AS from_pct, round(to_pct, 9) AS to_pct,
  round(CASE WHEN new_plays > 0 THEN to_pct - coalesce(at_marker, first_pct) END, 9) AS swing FROM w JOIN dn USING (game_id)""")
def catch_up(spark, sf):
    """Users are games, four events a drive, the last one on the field; the marker is the first purchase."""
    rows = plays(spark, sf).withColumns({"drive_pos": F.floor((F.col("pos") - 1) / 4), "home_score": F.lit(0), "away_score": F.lit(0), "period": F.lit(1)})
    marker = rows.where("type = 'purchase'").groupBy("game_id").agg(F.min_by("play_id", "pos").alias("play_id"))
    last = Window.partitionBy("game_id")
    drives = rows.groupBy("game_id", F.col("drive_pos").alias("pos")).agg(F.max("pos").alias("last_pos")).withColumn("is_current", F.max("pos").over(last) == F.col("pos"))
    parts = games.split_drives(drives, rows, marker).groupBy("game_id").agg(
        F.count_if(F.col("part") == "new").alias("new_drives"),
        F.count_if(F.col("part") == "earlier").alias("earlier_drives")
    )
    r = lambda c: F.round(c, 9).alias(c)
    return games.swings(rows, marker).join(parts, "game_id").select(
        F.col("game_id").alias("user_id"), "new_drives", "earlier_drives", "new_plays", r("from_pct"), r("to_pct"), r("swing")
    )


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named, on-topic articles of the week, the first of each link, newest first."""
    rows = A.naming(articles(spark, sf_dir), NAMES).withColumn("list_ord", F.lit(0))
    rows = A.first_of_each(rows.where(A.off_topic_reason(COMMERCE, INSTITUTIONAL, ATHLETIC).isNull()))
    return rows.where(A.within_week(F.col("published").cast("timestamp"), now().cast("timestamp"))).orderBy(*A.newest_first()).select("link", "title", "published")


from . import bodies, followers  # noqa: E402, F401  (register their queries)
