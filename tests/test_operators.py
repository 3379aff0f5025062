import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, numbers, text
from newsloom.operators import articles, boards, claims, cluster, curation, games, tagging


def column(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)])
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows.orderBy("i").collect()]


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


V = F.col("v")
# Words of the tests' own.
STOP = ("the", "and")
LEXICON = {"takes": ("winners and losers",), "evaluative": ("best",), "completed": ("signed",), "rumors": ("reportedly", "linked to"), "service": ("how to watch",)}
OFF_TOPIC = articles.off_topic_reason(("promo code",))
SPORTS = {"football": ("quarterback",), "baseball": ("pitcher",)}


def test_word_boundaries(spark):
    assert column(spark, ["an Ohio win", "OHIO", "Ohioan", "l'Ohio-", "ohioé", None], text.contains_any(V, ["ohio"])) == [True, True, False, True, True, False]
    assert column(spark, ["C++", "C++x", "a.b", "axb"], text.contains_any(V, ["C++", "a.b"])) == [False, True, True, False]
    with pytest.raises(ValueError):
        text.bounded("")
    assert column(spark, ["x"], text.contains_any(V, [])) == [False]


def test_text_functions(spark):
    assert column(spark, ["<p>a &amp; b</p>\n c&#39;s &#x2019;", None], text.strip_tags(V)) == ["a & b c's ’", None]
    assert column(spark, ["Breaking: Hawks' coaches sign two-year deals - The Paper", "the of"], text.title_tokens(V, F.lit("The Paper"), STOP, ("breaking",))) == [["hawk", "coach", "sign", "two-year", "deal"], ["of"]]
    assert column(spark, ["stories", "boxes", "glass", "wins", "coaches"], text.singular(V)) == ["story", "box", "glass", "wins", "coach"]
    assert column(spark, ["a" * 10, "one two three four", "x" * 30], text.truncated(V, 12)) == ["a" * 10, "one two…", "x" * 12 + "…"]
    assert column(spark, ["one two\n three four", "one two\u00a0 \t three"], text.truncated(V, 9)) == ["one two…", "one two…"]
    titles = ["Hawks–Doves: a night", "The teams' win | The Paper", "All good : the paper", "Ends in the paper", "Trades — here's how", "Étoile d'or - The Paper "]
    assert column(spark, titles, text.title_tokens(V, F.lit("The Paper"))) == [["hawk", "dove", "night"], ["the", "team", "win"], ["all", "good"], ["ends", "in", "the", "paper"], ["trade", "here", "how"], ["étoile", "or"]]
    assert column(spark, ["He said “we should win” now"], text.strip_quotes(V)) == ["He said   now"]
    assert column(spark, ["Ohio St."], text.aliased(V, {"ohio-st": "ohio-state"}), text.expansions(V)) == [("ohio-state", ["Ohio St.", "Ohio State"])]
    assert column(spark, ["l:t:x", "bare"], text.favorite_parts(V)) == [("l", "t:x"), ("bare", None)]
    assert column(spark, ["Golden Bears"], text.nickname_candidates(V)) == [["golden bears", "golden bear", "bears", "bear"]]
    said = ["(Shotgun) A.Ray pass short (B.Low; C.Day).", "(No Huddle, Shotgun) A.Ray run (penalty declined) gain", "Kick good", "(12:01) Ray run (O'Neil.)", "(Shotgun, Wildcat) B.Oak run", "Kick (blocked.)", "Up the middle ( D.Elm ).", "(shotgun)", None]
    cleaned = ["A.Ray pass short.", "A.Ray run (penalty declined) gain", "Kick good", "(12:01) Ray run.", "(Shotgun, Wildcat) B.Oak run", "Kick (blocked.)", "Up the middle ( D.Elm ).", "", None]
    assert column(spark, said, text.play_text(V)) == cleaned
    assert column(spark, ["&mdash;&nbsp;&copy; &#8217;&#x27; &amp;lt; &#99999999; &AMP;"], text.decode_entities(V)) == ["\u2014 &copy; \u2019' &lt; &#99999999; &"]
    keys = spark.range(1).select(text.migrated_favorites(F.array(*[F.lit(x) for x in (" 13 ", "l:13", "k:9", "", None, "13")]), "l").alias("k")).first().k
    assert keys == ["l:13", "k:9"]
    made = spark.range(1).select(text.site_path(F.lit("s"), F.lit("p")), text.core_path(F.lit("s"), F.lit("p")), text.entity_key(F.lit("s"), F.lit("p"), F.lit("4")), text.pool_key(F.lit("l"), F.lit("s"), F.lit("p"), F.lit("4")), text.board_filter(F.lit(8)), text.board_filter(F.lit(None).cast("int"))).first()
    assert tuple(made) == ("s/p", "s/leagues/p", "s/p:4", "l:s/p:4", "?groups=8", "")
    assert column(spark, ["https://a.example.com/x"], text.operator_of(V, {"fam": "example[.]org"})) == ["a.example.com"]


def test_dates(spark):
    got = column(spark, ["Tue, 02 Jan 2024 10:30:00 GMT", "2 Jan 2024 10:30 EST", "2024-01-02T10:30Z", "2024-01-02T10:30:05.123+02:00", "Tuesday, January 2, 2024 - 16:05", "January 2, 2024 - 4:05", "2024-01-02", "31 Feb 2024 10:00 GMT", "Friday, February 30, 2024 - 09:00", "Tue, January 2, 2024 - 24:00", "Jan 2, 2024 - 9:00", "soon", None], dates.feed_date(V))
    d = datetime
    assert got == [d(2024, 1, 2, 10, 30), d(2024, 1, 2, 15, 30), d(2024, 1, 2, 10, 30), d(2024, 1, 2, 8, 30, 5, 123000), d(2024, 1, 2, 16, 5), d(2024, 1, 2, 4, 5), d(2024, 1, 2), None, None, None, None, None, None]
    at = F.to_timestamp(V)
    assert column(spark, ["2024-07-31 00:00:00", "2024-08-01 00:00:00"], dates.season_of(at, F.lit(8))) == [2023, 2024]
    assert column(spark, ["2024-01-02 04:59:00", "2024-01-02 05:00:00", "2024-01-02 17:00:00"], dates.period_key(at)) == ["2024-01-01:evening", "2024-01-02:morning", "2024-01-02:evening"]
    assert dates.window_spec("90m") == 5400 and dates.window_spec("9d") == 3 * 86400


def test_colours(spark):
    assert column(spark, ["#fff", "000000", "zz"], F.round(numbers.contrast(V, F.lit("#000000")), 2), numbers.ink_on(V)) == [(21.0, numbers.INK), (1.0, numbers.WHITE), (None, numbers.INK)]
    for ground in ("#101418", "#ffffff"):
        shown = column(spark, ["#001133", "#ffee00", "#808080", "nope", None], numbers.visible_on(V, ground))
        assert shown[3:] == [None, None]
        assert all(c >= 3.0 for c in column(spark, shown[:3], numbers.contrast(V, F.lit(ground))))


def test_claims(spark):
    a = frame(spark, "title string, description string", ("Smith signed by Hawks", None), ("Hawks reportedly want Smith", ""), ("Is Smith the best?", ""), ("How to watch: who plays?", ""), ("Winners and losers", ""), ("Smith says 'best team signed'", "talk"), ("Coach is linked to job", None))
    got = [tuple(r[0]) for r in a.coalesce(1).select(claims.local_claim(LEXICON)).collect()]
    assert got == [("reported", "evidence"), ("rumor", "evidence"), ("take", "evidence"), ("reported", "default"), ("take", "evidence"), ("reported", "default"), ("rumor", "evidence")]
    assert [r[0] for r in a.limit(1).select(claims.merged_claim(F.lit("rumor"), LEXICON)).collect()] == ["reported"]


TEAMS = [{"league_id": "l", "team_id": "1", "short_name": "Miami", "names": ["Miami"]}, {"league_id": "l", "team_id": "2", "short_name": "Miami Ohio", "names": ["Miami Ohio", "RedHawks"]}]


def test_tagging_masks_longer_names(spark):
    a = frame(spark, "title string, description string, league_id string, team_id string, scope string", ("Miami Ohio wins", "Miami too", "l", "1", "broad"), ("Miami loses", "RedHawks", "l", "2", "team"), ("None here", None, "l", "2", "team"), ("None here", None, "l", "2", "broad"))
    rows = tagging.tagged(a.coalesce(1), TEAMS).collect()
    assert [[t.team_id for t in r.mentioned_teams] for r in rows] == [["2", "1"], ["1", "2"], [], []]
    assert [r.mentioned_team and r.mentioned_team.team_id for r in rows] == ["2", "1", "2", None]
    followed = frame(spark, "league_id string, team_id string", ("l", "2"))
    assert tagging.of_followed(tagging.tagged(a, TEAMS), followed).count() == 3


def test_player_full_matches_win(spark):
    a = frame(spark, "link string, title string, description string", ("1", "Ann Carter scores", ""), ("2", "Carter again", ""), ("3", "Lee runs", ""), ("4", "Novak stars", ""))
    p = frame(spark, "name string", ("Ann Carter",), ("Bo Lee",), ("Cy Novak",))
    assert sorted(map(tuple, tagging.player_matches(a, p).collect())) == [("Ann Carter", "1", "full"), ("Cy Novak", "4", "surname")]


def test_players_by_first_and_last_name(spark):
    a = frame(spark, "link string, title string, description string", ("1", "Kenneth Walker runs", ""), ("2", "Ken Walker", ""), ("3", "Kenneth Walker III", ""), ("4", "Smithers", None), ("5", "no one", "Jo Smithers."))
    p = frame(spark, "name string, first_name string, last_name string", ("Kenneth Walker III", "Kenneth", "Walker"), ("Jo B. Smithers Jr.", "Jo", "Smithers"), ("Al Walker", "Al", "Walker"), ("", "", ""))
    assert sorted(map(tuple, tagging.player_matches(a, p).collect())) == [("Jo B. Smithers Jr.", "5", "full"), ("Kenneth Walker III", "1", "full"), ("Kenneth Walker III", "3", "full")]


def test_tags_of_a_table_against_the_fold_of_a_list(spark):
    """Names that lie in each other, of several words and teams, in both fields, with a preferred team."""
    import random

    random.seed(4)
    pieces = ["North", "shore", "line", "East", "A&M", "x"]
    teams = [{"league_id": "l", "team_id": str(i), "short_name": f"T{i}", "names": list({" ".join(random.choices(pieces, k=random.randint(1, 3))) for _ in range(2)})} for i in range(12)]
    rows = [(str(i), " ".join(random.choices(pieces, k=6)), " ".join(random.choices(pieces, k=6)) if i % 5 else None) for i in range(80)] + [("x", None, None), ("y", "", "A&M"), ("y", "", "A&M")]
    a = frame(spark, "link string, title string, description string", *rows)
    names = frame(spark, "league_id string, team_id string, short_name string, name string", *[("l", t["team_id"], t["short_name"], n) for t in teams for n in t["names"]], ("l", "99", "None", ""), ("l", "98", "Sign", "!"))
    order = tagging.matchers(teams)
    listed = a.withColumns({"t": tagging.named_in(F.col("title"), teams), "d": tagging.named_in(F.col("description"), teams)})
    first = next(i for i, t in enumerate(order) if t["team_id"] == "3")
    want = []
    for r in listed.collect():
        lead = lambda x: sorted(x, key=lambda i: i != first)
        want.append((r.link, [order[i]["team_id"] for i in [*lead(r.t), *lead([i for i in r.d if i not in r.t])]]))
    got = [(r.link, [t.team_id for t in r.mentioned_teams]) for r in tagging.tagged(a, names, ("l", "3")).collect()]
    assert sorted(got) == sorted(want) and len(got) == 83


def headlines():
    t = datetime(2024, 1, 5, 6)
    rows = [("f", f"x{i}", f"Filler alpha{i} beta{i} gamma{i}", "S", t + timedelta(minutes=i), 1, "national") for i in range(16)]
    rows += [("f", "a", "Hawks coach Smith signs extension", "One", t, 2, "national"), ("f", "b", "Smith signs extension as Hawks coach", "Two", t + timedelta(hours=1), 1, "beat"), ("f", "c", "Hawks coach Smith signs extension", "Three", t + timedelta(hours=60), 1, "beat"), ("f", "d", "Hawks coach Smith signs extension", "Four", None, 1, "beat")]
    return rows


SCHEMA = "feed string, link string, title string, source string, published timestamp, tier int, reach string"


def test_clusters_do_not_depend_on_order(spark):
    rows, seen = headlines(), []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        a = frame(spark, SCHEMA, *rows)
        rolled = cluster.rolled_up(a, cluster.clusters(a)).collect()
        seen.append(sorted(map(str, rolled)))
        merged = [r for r in rolled if r.duplicate_count]
        assert [(r.lead, r.also_covered_by) for r in merged] == [("a", ["Two"])]
    assert seen[0] == seen[1]
    assert cluster.clusters(frame(spark, SCHEMA, *rows), max_input=5).where("anchor <> link").count() == 0


def test_opposed_terms(spark):
    got = frame(spark, "a array<string>, b array<string>", (["win"], ["loss"]), (["win", "loss"], ["loss"]), (["win"], ["win"])).select(cluster.opposed(F.col("a"), F.col("b"), (("win", "loss"),))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_retention_is_idempotent(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    schema = "team string, link string, published timestamp, description string"
    fresh = frame(spark, schema, ("t", "1", datetime(2024, 1, 1), "x"), ("t", "2", datetime(2024, 1, 9), "x"))
    stored = frame(spark, schema + ", first_seen timestamp", ("t", "2", datetime(2024, 1, 9), "old", datetime(2024, 1, 5)), ("t", "3", datetime(2024, 1, 2), "old", datetime(2024, 1, 2)), ("t", "4", None, "old", datetime(2024, 1, 8)))
    merged = articles.merged_with_stored(fresh, stored, now)
    got = {r.link: r.first_seen for r in merged.collect()}
    assert got == {"1": datetime(2024, 1, 10), "2": datetime(2024, 1, 5), "4": datetime(2024, 1, 8)}
    again = articles.merged_with_stored(fresh, articles.next_store(merged).drop("rn"), now)
    assert {r.link: r.first_seen for r in again.collect()} == got


def test_prices_are_commerce(spark):
    texts = ["$1,299 off a seat", "20%off", "$9 or less", "Take $5.50  off", "20% offense up", "x20% off", "1000% off", "$5 million offer", "90 off"]
    rows = [(str(i), t, "") for i, t in enumerate(texts)]
    got = frame(spark, "link string, title string, description string", *rows).coalesce(1).select(articles.off_topic_reason()).collect()
    assert [r[0] == "commerce" for r in got] == [True] * 4 + [False] * 5


def test_short_feeds_stay(spark):
    rows = [("f", str(i), s, 0, i) for i, s in enumerate("AAABB")]
    got = articles.balanced(frame(spark, "feed string, link string, source string, list_ord int, pos int", *rows)).orderBy("rank").collect()
    assert "".join(r.source for r in got) == "AAABB"


def test_balance(spark):
    rows = [("f", f"{i}", "A" if i < 6 else f"B{i}", 0, i) for i in range(9)]
    got = [r.source[0] for r in articles.balanced(frame(spark, "feed string, link string, source string, list_ord int, pos int", *rows)).orderBy("rank").collect()]
    assert got == list("AABBBAAAA")


def test_pool_and_verdicts(spark):
    schema = "link string, title string, description string, pos int"
    one = frame(spark, schema, ("1", "Hawks win", "", 0), ("2", "Others win", "", 1))
    two = frame(spark, schema, ("1", "Copy", "", 0), ("3", "Promo code for Hawks", "", 1), ("4", "Hawks pitcher", "", 2))
    assert sorted((r.link, r.list_ord) for r in articles.team_pool([(one, ["Hawks"]), (two, None)], "football", off_topic=OFF_TOPIC, sports=SPORTS).collect()) == [("1", 0)]
    verdicts = frame(spark, "t string, kind string, sport string, claim string", ("Hawks  WIN", "ad", "football", None)).withColumn("key", text.cache_key(F.col("t")))
    assert articles.team_pool([(one, ["Hawks"])], "football", verdicts).count() == 0
    assert articles.unanswered(one, verdicts).count() == 1


def test_boards(spark):
    schema = "team_id string, category string, title string, athlete_id string, rank int, pos int"
    leaders = frame(spark, schema, *[("t", "pass", "Passing Leader", str(i), i + 1, 10 + i) for i in range(6)], ("t", "rush", "Rushing Leaders per game", "1", 1, 3), ("t", "sack", "Sacks", "zz", 1, 0))
    roster = frame(spark, "team_id string, id string, full_name string, last_name string", *[("t", str(i), f"P{i}", "Carter" if i in (2, 4) else f"Li{i}") for i in range(1, 6)])
    rows = boards.leader_boards(leaders, roster).orderBy("board", "place").collect()
    assert [(r.athlete_id, r.matches_surname, r.title, r.place) for r in rows] == [("1", True, "Rushing Leaders per game", 1), ("1", True, "Passing", 1), ("2", False, "Passing", 2), ("3", True, "Passing", 3)]
    named = boards.leader_boards(leaders, roster, ["pass", "none", "rush"], top=1).orderBy("board").collect()
    assert [(r.category, r.athlete_id) for r in named] == [("pass", "1"), ("rush", "1")]


def plays(spark):
    rows = [("g", 1, "p1", "rush", 1, 0, 0), ("g", 2, "p2", "Timeout", 1, 0, 0), ("g", 3, "p3", "pass", 1, 0, 7), ("g", 4, "p4", "pass", 5, 10, 7)]
    probability = frame(spark, "game_id string, pos int, play_id string, home_win_pct double", ("g", 0, "p0", 0.5), ("g", 1, "p1", 0.9), ("g", 2, "p1", 0.6), ("g", 3, "p2", 0.1), ("g", 4, "p3", 0.3), ("g", 5, "p4", 0.8))
    return games.with_probability(frame(spark, "game_id string, pos int, play_id string, type string, period int, home_score int, away_score int", *rows), probability)


def test_catch_up(spark):
    p = plays(spark)
    assert {r.play_id: r.delta and round(r.delta, 6) for r in games.deltas(p).collect()} == {"p1": None, "p2": None, "p3": 0.2, "p4": 0.5}
    assert [r.play_id for r in games.turning_points(p).collect()] == ["p4"]
    marked = lambda play: frame(spark, "game_id string, play_id string", ("g", play))
    known = games.swings(p, marked("p2")).first()
    assert (known.marker_found, known.new_plays, round(known.swing, 6), known.home_deficit, known.overtime) == (True, 2, 0.7, 7, True)
    unknown = games.swings(p, marked("zz")).first()
    assert (unknown.marker_found, unknown.new_plays) == (False, 4)
    points = frame(spark, "game_id string, pos int, home_win_pct double", ("g", 0, 0.5), ("g", 9, 0.95))
    for marker in (marked(None), marked("p1").limit(0)):
        none = games.swings(p, marker, points).first()
        assert (none.marker_found, none.marker_pos, none.from_pct, round(none.swing, 6)) == (True, None, 0.5, 0.45)
    assert games.swings(p, marked("p4"), points).first().swing is None
    seeded = p.withColumn("from_pct", F.lit(0.5))
    assert {r.play_id: r.delta and round(r.delta, 6) for r in games.deltas(seeded).collect()}["p1"] == 0.1


def test_drives_part_at_the_marker(spark):
    p = frame(spark, "game_id string, pos int, play_id string, drive_pos int", *[("g", i + 1, f"p{i}", i // 2) for i in range(6)])
    drives = frame(spark, "game_id string, pos int, is_current boolean", ("g", 0, False), ("g", 1, False), ("g", 2, True))
    parts = lambda play: [(r.part, r.started_before) for r in games.split_drives(drives, p, frame(spark, "game_id string, play_id string", ("g", play))).orderBy("pos").collect()]
    assert parts("p1") == [("earlier", False), ("new", False), ("new", False)]
    assert parts("p2") == [("earlier", False), ("new", True), ("new", False)]
    assert parts("p5") == [("earlier", False), ("earlier", False), (None, False)]
    assert parts(None) == parts("gone") == [("new", False)] * 3


#: What a sentence of each rule can say.
WORDING = {
    "final_level": "",
    "final_rally": "{a} {n}",
    "final_extra": "{a}",
    "final_narrow": "{a} {n}",
    "final": "{a} {n}",
    "unchanged": "",
    "returned": "{a}",
    "rally": "{a} {n}",
    "no_points": "",
    "even": "{n}",
    "ahead": "{a} {n}",
    "new_leader": "{a}",
    "levelled": "",
    "both_lost_it": "{n}",
    "lost_it_once": "{a}",
    "lost_it_twice": "{a}",
    "lost_it": "{a} {n}",
    "reply": "{a} {b} {x} {y}",
    "in_a_row": "{a}",
    "march": "{a} {n} {m} {x}",
    "kick_blocked": "{a}",
    "kick_missed": "{a}",
    "opened": "{a}",
    "punts": "{n}",
    "both_added": "{a} {b} {n} {m}",
    "added": "{a} {n}",
    "quiet": "",
}


def said(spark, lines=(), now=(0, 0), before=(0, 0), deficit=(0, 0), marker=True, state="in", period=4, wording=WORDING):
    """The rule and sentence for new drives (side, outcome and what differs), scores now and at the marker, and deficits between."""
    header = frame(spark, "game_id string, state string, home_name string, away_name string, home_score int, away_score int, period int", ("g", state, "Oak", "Elm", *now, period))
    plays_ = [("g", 1, "m", 0, "rush", 1, *before, None), ("g", 2, "x", 0, "rush", 1, before[0], before[0] + deficit[0], None), ("g", 3, "y", 0, "rush", 1, before[1] + deficit[1], before[1], None)]
    plays_ = plays_[:1] + [x for x, d in zip(plays_[1:], deficit) if d]
    p = frame(spark, "game_id string, pos int, play_id string, drive_pos int, type string, period int, home_score int, away_score int, home_win_pct double", *plays_)
    p = p.withColumn("pos", F.when(F.col("play_id") == "m", 1).otherwise(F.col("pos")))
    rows = [("g", i + 1, x[0], x[1], x[2].get("result", x[1]) if len(x) > 2 else x[1], *((x[2].get("plays", 5), x[2].get("yards", 30), x[2].get("current", False)) if len(x) > 2 else (5, 30, False))) for i, x in enumerate(lines)]
    drives = frame(spark, "game_id string, pos int, side string, outcome string, result string, plays int, yards int, is_current boolean", ("g", 0, "home", "other", "", 1, 1, True), *rows)
    r = games.summaries(header, p, drives, frame(spark, "game_id string, play_id string", ("g", "m" if marker else None)), wording=wording).first()
    return r.rule, r.blurb


H, A = "home", "away"
BLURBS = [
    (dict(state="post", now=(20, 20)), "final_level", ""),
    (dict(state="post", now=(24, 21), deficit=(17, 0)), "final_rally", "Oak 17"),
    (dict(state="post", now=(24, 27), period=5), "final_extra", "Elm"),
    (dict(state="post", now=(24, 21)), "final_narrow", "Oak 3"),
    (dict(state="post", now=(42, 10)), "final", "Oak 32"),
    (dict(), "unchanged", ""),
    (dict(lines=[(H, "return_touchdown"), (A, "punt")], before=(3, 0), now=(3, 7)), "returned", "Elm"),
    (dict(lines=[(H, "touchdown")], before=(3, 17), now=(21, 17), deficit=(14, 0)), "rally", "Oak 14"),
    (dict(lines=[(A, "punt")], marker=False), "no_points", ""),
    (dict(lines=[(A, "field_goal"), (H, "field_goal")], marker=False, now=(3, 3)), "even", "3"),
    (dict(lines=[(A, "field_goal"), (H, "turnover")], marker=False, now=(0, 3)), "ahead", "Elm 3"),
    (dict(lines=[(A, "touchdown")], before=(3, 0), now=(3, 7)), "new_leader", "Elm"),
    (dict(lines=[(A, "field_goal")], before=(3, 0), now=(3, 3)), "levelled", ""),
    (dict(lines=[(H, "turnover"), (A, "turnover")]), "both_lost_it", "2"),
    (dict(lines=[(H, "turnover"), (A, "downs")]), "lost_it_once", "Oak"),
    (dict(lines=[(A, "turnover"), (A, "turnover")]), "lost_it_twice", "Elm"),
    (dict(lines=[(H, "turnover")] * 3), "lost_it", "Oak 3"),
    (dict(lines=[(H, "field_goal"), (A, "touchdown")], before=(7, 0), now=(10, 7)), "reply", "Oak Elm field goal touchdown"),
    (dict(lines=[(H, "touchdown"), (A, "punt"), (H, "field_goal")], before=(7, 0), now=(17, 0)), "in_a_row", "Oak"),
    (dict(lines=[(A, "punt"), (H, "touchdown", dict(yards=80, plays=12))], before=(7, 0), now=(14, 0)), "march", "Oak 80 12 touchdown"),
    (dict(lines=[(A, "missed_kick", dict(result="MISSED FG"))]), "kick_missed", "Elm"),
    (dict(lines=[(A, "missed_kick", dict(result="Blocked FG")), (H, "punt")]), "kick_blocked", "Elm"),
    (dict(lines=[(A, "field_goal"), (H, "punt")], before=(7, 0), now=(7, 3)), "opened", "Elm"),
    (dict(lines=[(H, "punt"), (A, "punt"), (H, "punt"), (A, "other", dict(current=True))]), "punts", "3"),
    (dict(lines=[(H, "field_goal"), (A, "punt")], before=(7, 3), now=(10, 3)), "added", "Oak 3"),
    (dict(lines=[(H, "touchdown"), (A, "punt")], before=(21, 7), now=(28, 9)), "both_added", "Oak Elm 7 2"),
    (dict(lines=[(H, "punt"), (A, "downs")], before=(7, 3), now=(7, 3)), "quiet", ""),
    (dict(state="pre", lines=[(H, "punt")]), None, None),
]


@pytest.mark.parametrize(("case", "rule", "sentence"), BLURBS, ids=[str(b[1]) for b in BLURBS])
def test_blurbs(spark, case, rule, sentence):
    assert said(spark, **case) == (rule, sentence)


def test_every_rule_has_words_and_a_case(spark):
    assert set(WORDING) == {b[1] for b in BLURBS} - {None}
    assert said(spark, wording={"unchanged": "Nichts Neues."}) == ("unchanged", "Nichts Neues.")


def test_outcomes_and_lines(spark):
    cases = {"TD": "touchdown", "FG": "field_goal", "INT": "turnover", "MISSED FG": "missed_kick", "PUNT": "punt", "END OF HALF": "period_end", "END OF GAME": "period_end", "FUMBLE": "turnover", "DOWNS": "downs", "SAFETY": "safety", "BLOCKED FG": "missed_kick", "BLOCKED PUNT": "punt"}
    cases |= {"INT TD": "return_touchdown", "FUMBLE TD": "return_touchdown", "PUNT RETURN TD": "return_touchdown", "BLOCKED FG TD": "return_touchdown", " td ": "touchdown", "FG MISSED": "missed_kick", "TO": "turnover", "SOMETHING NEW": "other", "": "other", "Turnover on Downs": "downs"}
    assert column(spark, [*cases, None], games.outcome(V)) == [*cases.values(), "other"]
    assert column(spark, ["9 plays, 75 yards, 4:01", "1 play, -4 yards, 0:12", "in progress"], games.drive_numbers(V)) == [(9, 75, "4:01"), (1, -4, "0:12"), (None, None, None)]
    assert column(spark, ["1", "5", "6", "0", None], games.period_label(V.cast("int"))) == ["1Q", "OT", "2OT", "", ""]
    clock = ["Official Timeout", "Timeout", "End Period", "End of Half", "Two-minute warning", "Coin Toss", " end"]
    other = ["Rush", "Punt", "Endzone catch", "Field Goal Good", "", None, "Long timeout"]
    assert column(spark, clock + other, games.clock_event(V)) == [True] * len(clock) + [False] * len(other)


def test_tickers(spark):
    schema = "state string, followed_side string, neutral boolean, home_abbr string, away_abbr string, home_score int, away_score int, home_id string, away_id string, status string, period int, network string, down_distance string, possession string"
    rows = frame(
        spark, schema, ("in", "home", False, "OAK", "ELM", 21, 17, "h", "a", "8:12 - 3rd", 3, "X", "3rd & 4", "a"), ("pre", "away", False, "OAK", "ELM", None, None, "h", "a", None, None, "CBX", None, None),
        ("pre", "away", True, "OAK", "ELM", None, None, "h", "a", None, None, None, None, None), ("post", "away", False, "OAK", "ELM", 30, 33, "h", "a", None, 5, None, None, None), ("in", "home", None, "OAK", "ELM", 0, 0, "h", "a", "", 1, None, "1st", "z"),
    )
    got = [r[0] for r in rows.coalesce(1).select(games.ticker_line(F.lit("Sat 15:30"))).collect()]
    dot = " \u00b7 "
    assert got == [f"OAK 21 vs ELM 17{dot}8:12 - 3rd{dot}3rd & 4 \u25cf ELM", f"ELM @ OAK{dot}Sat 15:30{dot}CBX", f"ELM vs OAK{dot}Sat 15:30", f"Final/OT{dot}ELM 33 @ OAK 30", f"OAK 0 vs ELM 0{dot}1st"]
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    games_ = frame(spark, "id string, league_id string, home_id string, away_id string, state string, kickoff timestamp, completed boolean", ("1", "l", "x", "y", "pre", datetime(2024, 1, 1, 18), False), ("2", "l", "y", "x", "in", datetime(2023, 12, 1), False), ("3", "l", "x", "z", "post", datetime(2024, 1, 1, 5), True), ("4", "l", "x", "z", "post", datetime(2024, 1, 1, 4), False), ("5", "k", "x", "z", "in", datetime(2024, 1, 1), False), ("6", "l", "x", "z", "pre", datetime(2024, 1, 1, 19), False))
    followed = frame(spark, "league_id string, team_id string", ("l", "x"))
    assert [(r.id, r.followed_side) for r in games.ticker(games_, followed, now).collect()] == [("2", "away"), ("1", "home"), ("3", "home")]
    assert [r[0] for r in games_.orderBy("id").select(games.tappable(now)).collect()] == [True, False, True, False, False, False]


def test_drive_lines(spark):
    drives = frame(spark, "game_id string, pos int, abbr string, result string, outcome string, plays int, yards int, time string, is_current boolean", ("g", 0, "ELM", "Touchdown", "touchdown", 12, 75, "6:35", False), ("g", 1, "OAK", "x", "other", 1, 4, "0:10", True), ("g", 2, "OAK", "", "punt", None, None, None, False))
    p = frame(spark, "game_id string, pos int, drive_pos int, home_score int, away_score int", ("g", 1, 0, 3, 0), ("g", 2, 0, 10, 14))
    rows = games.with_end_scores(drives, p).orderBy("pos")
    dot, dash = " \u00b7 ", "\u2013"
    assert [r[0] for r in rows.select(games.drive_line(F.lit("home"))).collect()] == [f"ELM{dot}Touchdown{dot}12 plays, 75 yds, 6:35{dot}10{dash}14", f"OAK{dot}On the field{dot}1 play, 4 yds", f"OAK{dot}Drive"]
    assert rows.select(games.drive_line(F.lit("away"))).first()[0].endswith(f"14{dash}10")
    assert [r.pos for r in drives.where(games.matters()).collect()] == [0, 1]


def test_hazards_and_hypotheticals(spark):
    teams = frame(spark, "slug string, nicknames array<string>, sources array<string>", ("a", ["Cats"], ["s"]), ("b", ["cats"], ["s", "t"]), ("c", ["cats"], ["u"]), ("d", ["cats"], []))
    reserved = frame(spark, "nickname string, owner string", ("bears", "pro"))
    got = sorted((r.slug, r.kind, r.detail) for r in curation.nickname_hazards(teams, reserved).collect())
    assert got == [("a", "contested", "c"), ("a", "shared-source", "b,s"), ("b", "contested", "c"), ("b", "shared-source", "a,s"), ("c", "contested", "a"), ("c", "contested", "b")]
    tried = curation.hypothetical(teams, frame(spark, "slug string, word string", ("a", "Bears"), ("a", "Owls")), reserved)
    assert [(r.slug, r.nickname, r.kind) for r in tried.collect()] == [("a", "bears", "reserved")]
    # two candidates of one nickname are tried alone, so neither contests the other
    alone = curation.hypothetical(teams, frame(spark, "slug string, word string", ("a", "Owls"), ("b", "owls"), ("c", "CATS")), reserved)
    assert sorted((r.slug, r.nickname, r.detail) for r in alone.collect()) == [("c", "cats", "a"), ("c", "cats", "b")]
    assert [r.owner for r in curation.reserved_names(frame(spark, "nickname string, owner string", ("Bears", "x"), ("Owls", "y")), frame(spark, "nickname string, owner string", ("bears", None))).orderBy("nickname").collect()] == [None, "y"]


def test_hazards_of_one_nickname_are_many_tasks(spark, monkeypatch):
    """Few bytes that make many rows; slugs with commas, of which two pairs can read alike, come once."""
    from newsloom.operators import order

    monkeypatch.setattr(order, "MADE", 500)
    monkeypatch.setattr(curation, "TOGETHER", 10)
    teams = frame(spark, "slug string, nicknames array<string>, sources array<string>", *[(f"t{i}", ["Cats"], [f"s{i % 3}", None, "r"][: 1 + i % 2]) for i in range(80)])
    reserved = frame(spark, "nickname string, owner string", ("cats", "t1"), ("CATS", "t1"))
    got = curation.nickname_hazards(teams, reserved).withColumn("task", F.spark_partition_id()).collect()
    made = [r for r in got if r.kind != "reserved"]
    assert len({(r.slug, r.kind, r.detail) for r in got}) == len(got) == 80 * 79 + 79 and len({r.task for r in made}) > 3
    alike = frame(spark, "slug string, nicknames array<string>, sources array<string>", ("a", ["x"], ["c", "d"]), ("b", ["x"], ["c", "d"]), ("b,c", ["x"], ["d"]))
    assert sorted((r.slug, r.detail) for r in curation.nickname_hazards(alike, reserved).collect()) == [("a", "b,c,d"), ("b", "a,c,d"), ("b", "b,c,d"), ("b,c", "a,d"), ("b,c", "b,d")]


def test_hazards_meet_in_blocks_that_grow_with_the_teams(spark, monkeypatch):
    """Blocks on both sides against plain pairs; with few tasks there are few blocks, so that a team is sent no more often the more teams there are."""
    monkeypatch.setattr(curation, "TOGETHER", 3)
    monkeypatch.setattr(curation, "MOST_TASKS", 4)
    lists = [["s"], ["s", "t"], ["u", None], [None], [], ["t", "s"], None]
    rows = [(f"t{i}", ["Cats", "owls"] if i % 5 else ["OWLS"], lists[i % 7]) for i in range(60)] + [(None, ["cats"], ["s"]), ("none", None, ["s"])]
    teams = frame(spark, "slug string, nicknames array<string>, sources array<string>", *rows)
    sent, blocks = [], curation._blocks
    monkeypatch.setattr(curation, "_blocks", lambda rows, *names: sent.append(rows.agg(F.max("parts")).first()[0]) or blocks(rows, *names))
    made = curation.nickname_hazards(teams, frame(spark, "nickname string, owner string"))
    held = [(slug, n.lower(), sources) for slug, nicknames, sources in rows if sources and slug for n in nicknames or []]
    want = []
    for x, n, mine in held:
        for y, other, theirs in held:
            if n == other and x != y:
                common = sorted({v for v in mine if v} & {v for v in theirs if v})
                want.append((x, n, "shared-source" if common else "contested", ",".join([y, *common])))
    assert sorted(tuple(r) for r in made.collect()) == sorted(want) and len(want) > 1000
    assert sent and max(sent) <= 2  # blocks of three would be twenty
    tried = curation.hypothetical(teams, frame(spark, "slug string, word string", ("t1", "Cats"), ("t2", "dogs")), frame(spark, "nickname string, owner string"))
    assert sorted((r.slug, r.detail) for r in tried.collect()) == sorted((x, d) for x, n, _, d in want if x == "t1" and n == "cats")


def test_logs_and_status(spark):
    events = frame(spark, "event string", ('{"eventTimestamp": 0, "scriptName": "w", "outcome": "ok", "event": {"request": {"url": "https://h/v1/x?q", "method": "GET"}, "response": {"status": 503}}, "logs": [{"level": "log", "message": ["hi"]}]}',), ("nonsense",))
    rows = curation.shaped_logs(events.coalesce(1)).collect()
    assert (rows[0].path, rows[0].status, rows[0].message, rows[0].at) == ("/v1/x", 503, "hi", datetime(1970, 1, 1)) and rows[1].outcome == "unknown"
    assert curation.shaped_logs(events).where(curation.interesting()).count() == 2
    bodies = frame(spark, "url string, http_status int, body string, ms int", ("a", 200, "<rss><channel><item>x</item></channel></rss>", 5), ("b", 200, "<feed></feed>", 5), ("c", 404, None, 20_000))
    assert [(r.status, r.format, r["items"], r.slow) for r in curation.feed_status(bodies.coalesce(1)).collect()] == [("OK", "rss", 1, False), ("EMPTY", "atom", 0, False), ("HTTP", None, 0, True)]


def test_balanced_against_the_plain_fold(spark):
    import random

    random.seed(3)
    rows = [("f", f"l{i}", random.choice("aaaabbc"), 0, i) for i in range(300)]
    pending, want = list(rows), []
    while pending:
        recent = [r[2] for r in want[-5:]]
        want.append(pending.pop(next((i for i, r in enumerate(pending) if recent.count(r[2]) < 2), 0)))
    got = articles.balanced(frame(spark, "feed string, link string, source string, list_ord int, pos int", *rows)).orderBy("rank").collect()
    assert [r.link for r in got] == [r[1] for r in want]


def clusters_by_feed(a):
    """The fold over whole feeds, and the plan's pairs: the result to match."""
    pairs, rows = cluster.accepted(cluster.pair_scores(a), a).collect(), a.collect()
    rows = sorted(rows, key=lambda r: (r.feed, -r.published.timestamp() if r.published else float("inf"), r.link))
    home, place = {}, {}
    for r in rows:
        place[r.feed] = place.get(r.feed, 0) + 1
        if (r.feed, r.link) not in home:
            home[r.feed, r.link] = (r.link, place[r.feed])
            for p in pairs:
                if (p.feed, p.anchor) == (r.feed, r.link):
                    home.setdefault((p.feed, p.link), (r.link, place[r.feed]))
    return sorted((f, h[0], link, h[1]) for (f, link), h in home.items())


def test_clusters_by_component(spark):
    import random
    from datetime import datetime, timedelta

    random.seed(11)
    words = ["harbor", "council", "bridge", "market", "garden", "winter", "player", "signing"]
    rows = [(f"f{i % 2}", f"l{i}", " ".join(random.sample(words, 4)), "s", datetime(2024, 1, 1) + timedelta(hours=i) if i % 11 else None) for i in range(120)]
    a = spark.createDataFrame(rows, "feed string, link string, title string, source string, published timestamp")
    got = cluster.clusters(a)
    plan = got._jdf.queryExecution().toString()
    assert 'row_number' not in plan and "flatMapGroupsInPandas(feed" not in plan.replace("FlatMapGroupsInPandas [feed", "flatMapGroupsInPandas(feed")
    got = sorted(map(tuple, got.collect()))
    assert got == clusters_by_feed(a) and 10 < len({r[:2] for r in got}) < 110


def test_upper_median_ranks_no_tokens(spark):
    weights = frame(spark, "feed string, token string, df long, n long, weight double", *[("f", f"t{i}", 1, 20, float(i % 7)) for i in range(30)], *[("g", f"t{i}", 1, 3, 1.0) for i in range(4)])
    got = cluster.upper_median(weights)
    assert {r.feed: r.median for r in got.collect()} == {"f": sorted(i % 7 for i in range(30))[15], "g": None}
    assert "row_number" not in got._jdf.queryExecution().toString()


def test_names_of_a_table(spark):
    """Names of any number of words meet rows of any link, each row once."""
    a = frame(spark, "link string, title string, description string", (None, "Ohio State wins", ""), (None, "Ohio State wins", ""), ("x", "State of Ohio", "C++ here"), ("x", "ohio state", None), ("y", "Nothing", "OHIOState"), ("z", "l'Ohio-State", ""))
    names = frame(spark, "name string", ("Ohio State",), ("C++",), (None,), ("ohio state",), ("\u65e5\u672c",))
    got = sorted(str(r.link) for r in articles.naming_any(a, names).collect())
    assert got == ["None", "None", "x"]
    for one in ("Ohio State", "ohio", "State of Ohio", "wins", "nothing"):
        want = sorted(map(str, articles.naming(a, [one]).collect()))
        assert sorted(map(str, articles.naming_any(a, frame(spark, "name string", (one,))).collect())) == want


def test_pairs_against_all_pairs(spark):
    """Meeting by the less common tokens loses no pair with three tokens or two rare ones in common."""
    random.seed(5)
    words = [f"word{i}" for i in range(40)]
    rows = [("f", f"l{i:03}", " ".join(random.choices(words[:8], k=3) + random.choices(words, k=3)), "s", datetime(2024, 1, 1) + timedelta(minutes=37 * i)) for i in range(120)]
    a = frame(spark, "feed string, link string, title string, source string, published timestamp", *rows)
    tokens = {}
    for r in cluster.tokens_of(a).collect():
        tokens.setdefault(r.link, set()).add(r.token)
    weights = {r.token: r.weight for r in cluster.weights_of(cluster.tokens_of(a)).collect()}
    median = cluster.upper_median(cluster.weights_of(cluster.tokens_of(a))).first().median
    at, want = {r[1]: r[4] for r in rows}, {}
    for x in at:
        for y in at:
            if x != y and timedelta(0) <= at[x] - at[y] <= timedelta(hours=36):
                both = tokens[x] & tokens[y]
                rare = sum(weights[t] >= median for t in both)
                if len(both) >= 3 or rare >= 2:
                    dice = 2 * sum(weights[t] for t in both) / sum(weights[t] for t in [*tokens[x], *tokens[y]])
                    want[x, y] = (len(both), rare, round(dice, 9))
    got = {(r.anchor, r.link): (r.shared, r.rare_shared, round(r.dice, 9)) for r in cluster.pair_scores(a).collect()}
    assert got == want and len(want) > 100
    for least in (0.4, 0.55, 0.9):
        alike = {(r.anchor, r.link): (r.shared, r.rare_shared, round(r.dice, 9)) for r in cluster.pair_scores(a, least_dice=least).collect()}
        assert alike == {k: v for k, v in want.items() if v[2] >= least} and len(alike) < len(want)


@pytest.mark.parametrize("dense", [0.0, 0.2, 2.0])
def test_pairs_are_counted_in_tiles(spark, monkeypatch, dense):
    """Blocks of few titles, tokens counted by lists or by matrices, a band of no neighbour, stamps of one second: all pairs, each once, and none joined as a row."""
    from newsloom.operators import tiles

    for name, value in {"TITLES": 7, "TILES": 2, "LISTED": 50, "COLUMNS": 3, "DENSE": dense}.items():
        monkeypatch.setattr(tiles, name, value)
    random.seed(6)
    words = [f"word{i}" for i in range(40)]
    at = [datetime(2024, 1, 1) + timedelta(minutes=53 * i) for i in range(70)] + [datetime(2024, 5, 1, 2, 3, 4, i % 3) for i in range(20)]
    rows = [("f" if i % 5 else "g", f"l{i:02}", " ".join(random.choices(words[:8], k=3) + random.choices(words, k=4)), "s", t) for i, t in enumerate(at)]
    rows += [("f", "undated", " ".join(words), "s", None), ("f", "empty", "", "s", at[0]), ("alone", "x", "word1 word2 word3", "s", at[0])]
    a = frame(spark, "feed string, link string, title string, source string, published timestamp", *rows)
    weights = {(r.feed, r.token): r.weight for r in cluster.weights_of(cluster.tokens_of(a)).collect()}
    medians = {r.feed: r.median for r in cluster.upper_median(cluster.weights_of(cluster.tokens_of(a))).collect()}
    tokens, want = {}, {}
    for r in cluster.tokens_of(a).collect():
        tokens.setdefault((r.feed, r.link), {})[r.token] = weights[r.feed, r.token]
    is_rare = lambda feed, t: medians[feed] is not None and weights[feed, t] >= medians[feed]
    dated = [(r[0], r[1], r[4]) for r in rows if r[4] and (r[0], r[1]) in tokens]
    for feed, x, at_x in dated:
        for other, y, at_y in dated:
            seconds = (at_x.replace(microsecond=0) - at_y.replace(microsecond=0)).total_seconds()
            if feed == other and x != y and 0 <= seconds <= 36 * 3600 and (at_x > at_y or x < y):
                one, two = tokens[feed, x], tokens[feed, y]
                both, rares = one.keys() & two.keys(), [sum(is_rare(feed, t) for t in side) for side in (one, two)]
                rare = sum(is_rare(feed, t) for t in both)
                if len(both) >= 3 or rare >= 2:
                    want[feed, x, y] = (len(both), rare, min(rares), round(2 * sum(one[t] for t in both) / (sum(one.values()) + sum(two.values())), 9))
    pairs = cluster.pair_scores(a)
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert {(r.feed, r.anchor, r.link): (r.shared, r.rare_shared, r.rare_least, round(r.dice, 9)) for r in got} == want and len(got) == len(want) > 200
    assert len({r.task for r in got}) > 3 and "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_tagging_masks_in_order(spark):
    """The fold gives what masking names one after another gives."""
    import re

    random.seed(2)
    names = ["north", "north shore", "shore", "shore line", "line", "east line", "east"]
    teams = [{"league_id": "l", "team_id": str(i), "short_name": n, "names": [n]} for i, n in enumerate(names)]
    texts = [" ".join(random.choices(["North", "shore", "line", "east", "x"], k=8)) for _ in range(60)] + ["", None]
    order = tagging.matchers(teams)

    def plain(value):
        rest, found = value or "", []
        for i, t in enumerate(order):
            pattern = re.compile("|".join(rf"(?<![A-Za-z0-9_]){n}(?![A-Za-z0-9_])" for n in t["names"]), re.I)
            if pattern.search(rest):
                found.append(i)
                rest = pattern.sub("\u0001", rest)
        return found

    assert column(spark, texts, tagging.named_in(V, teams)) == [plain(t) for t in texts]


@pytest.mark.parametrize("density", [0.01, 0.05, 0.3, "chain"])
def test_anchors_by_rounds_against_the_fold(spark, density):
    random.seed(11)
    n = 60
    links = [(i, i + 1) for i in range(12)] if density == "chain" else [(a, b) for a in range(n) for b in range(a + 1, n) if random.random() < density]
    home = {}
    for x in range(n):
        if x not in home:
            home[x] = x
            for a, b in links:
                if a == x:
                    home.setdefault(b, x)
    got = {r.node: r.home for r in cluster.homes_of(frame(spark, "a long, b long", *links)).collect()}
    assert got == {k: v for k, v in home.items() if k != v}


def taken_in_order(links, most=200):
    """Plain fold: node, the anchor that takes it."""
    home = {}
    for x in range(most):
        if home.setdefault(x, x) == x:
            for a, b in links:
                if a == x:
                    home.setdefault(b, x)
    return {k: v for k, v in home.items() if k != v}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """What is written doesn't grow with the length of a chain of nodes that wait for each other."""
    links, kinds, stored = [(i, i + 1) for i in range(60)], [], cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df, kind: kinds.append(kind) or stored(df, kind))
    got = {r.node: r.home for r in cluster.homes_of(frame(spark, "a long, b long", *links)).collect()}
    assert got == taken_in_order(links) and len(got) == 30 and len(kinds) <= 10


def test_an_anchor_settled_late_has_what_a_later_one_took(spark):
    """3 is an anchor as 1 takes 2; so it has 5, which 4 links to as well and takes at once."""
    got = {r.node: r.home for r in cluster.homes_of(frame(spark, "a long, b long", (1, 2), (2, 3), (3, 5), (4, 5))).collect()}
    assert got == {2: 1, 5: 3}


def test_homes_of_many_slabs(spark, monkeypatch):
    """Slabs of a few links, two of them settled again at a time, give what one pass gives."""
    monkeypatch.setattr(cluster, "AT_ONCE", 2)
    rng = random.Random(3)
    links = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(100) for _ in range(160))]
    got = {r.node: r.home for r in cluster.homes_of(frame(spark, "a long, b long", *links), 20).collect()}
    assert got == taken_in_order(links)


def test_no_links_no_homes(spark):
    assert cluster.homes_of(frame(spark, "a long, b long", (1, 2)).limit(0)).count() == 0


def test_funnel_and_its_text(spark, tmp_path):
    from newsloom.sources import stores

    rows = [("Oak", "a", "1", 0, 1, "Oak wins"), ("Oak", "b", "1", 1, 1, "Oak wins"), ("Oak", "b", "2", 0, 2, "Oak ad"), ("Oak", None, "3", 0, 3, "rain"), ("Elm", "b", "1", 0, 4, "Oak wins"), (None, "a", "4", 0, 5, "Oak")]
    seen = frame(spark, "team string, source string, link string, list_ord int, pos int, title string", *rows)
    funnel = curation.yield_funnel(seen, F.col("title").contains("Oak"), ~F.col("title").contains("ad"))
    got = {(r.team, r.source, r.level): (r["items"], r.named, r.kept, r.diagnosis) for r in funnel.collect()}
    assert got == {
        ("Oak", "a", "source"): (1, 1, 1, None), ("Oak", "b", "source"): (2, 2, 1, None), ("Oak", None, "source"): (1, 0, 0, "not named"), ("Oak", None, "team"): (3, 2, 1, None),
        ("Elm", "b", "source"): (1, 1, 1, None), ("Elm", None, "team"): (1, 1, 1, None), (None, "a", "source"): (1, 1, 1, None), (None, None, "team"): (1, 1, 1, None),
    }
    stores.write_report(curation.funnel_lines(funnel.where("team = 'Oak'")), str(tmp_path / "report"), "line")
    (file,) = (tmp_path / "report").glob("part-*.txt")
    assert file.read_text().splitlines() == ["Oak: 1 articles", "  (none): 1 seen, 0 named, 0 kept (0 %) - not named", "  a: 1 seen, 1 named, 1 kept (100 %)", "  b: 2 seen, 2 named, 1 kept (50 %)"]


def test_lists_and_marks(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    uses = frame(spark, "team string, used_at timestamp", *[(f"t{i}", datetime(2024, 1, 1 + i)) for i in range(5)], ("t0", datetime(2024, 1, 9)))
    assert {r.team: r.evicted for r in articles.least_recent(uses, keep=2).collect()} == {"t0": False, "t4": False, "t1": True, "t2": True, "t3": True}
    marks = frame(spark, "link string, read_at timestamp", ("a", datetime(2024, 1, 9)), ("a", datetime(2024, 1, 8)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 7)), ("d", None))
    assert [r.link for r in articles.read_marks(marks, now).collect()] == ["a", "c"] and [r.link for r in articles.read_marks(marks, now, 1).collect()] == ["a"]
    a = frame(spark, "link string, title string, description string, pos int", *[(f"l{i}", f"Title {i}", "", i) for i in range(25)])
    left = articles.answered(a, frame(spark, "key string"), calls_left=2, size=10)
    assert {(r.batch, r.degraded, r.n) for r in left.groupBy("batch", "degraded").agg(F.count("*").alias("n")).collect()} == {(0, False, 10), (1, False, 10), (2, True, 5)}
    assert articles.rejected(a, a.where("pos < 20")).count() == 5
    split = articles.split_brief(a, frame(spark, "link string", ("l1",), ("l1",)))
    assert [tuple(r)[:2] for r in articles.brief_end(split).collect()] == [(24, 1)]
    assert [r.pos for r in articles.sample_titles(a.withColumns({"feed": F.lit("f"), "list_ord": F.lit(0)})).collect()] == [0, 1, 2]
    keys = frame(spark, "k array<string>", (["a"],)).select(articles.toggled(F.col("k"), F.lit("a")), articles.toggled(F.col("k"), F.lit("b"))).first()
    assert tuple(keys) == ([], ["a", "b"])


def test_feeds_of_several_teams(spark):
    rows = lambda *links: frame(spark, "link string, pos int, published timestamp", *[(x, i, datetime(2024, 1, 1)) for i, x in enumerate(links)])
    team = lambda i: {"team_id": i, "team_name": f"T{i}", "league_id": "l"}
    got = articles.multi_team_feed([(team("1"), rows("a", "b")), (team("2"), rows("b", "c"))]).collect()
    assert sorted((r.link, r.team_id, r.team_name) for r in got) == [("a", "1", "T1"), ("b", "1", "T1"), ("c", "2", "T2")]
    assert sorted((r.link, r.list_ord) for r in articles.national_pool(rows("a"), rows("a", "z")).collect()) == [("a", 0), ("z", 1)]
    a = frame(spark, "link string, title string, description string, pos int", ("1", "Oak wins", "", 0), ("2", "Acorns win", "", 1), ("3", "Other", "", 2))
    groups = articles.pool_groups(a, a.where("link = '3'"), a, a.limit(0), ["Oak"], ["Acorns"])
    assert sorted((r.link, r.list_ord) for r in articles.team_pool(groups, "football").collect()) == [("1", 0), ("2", 2), ("3", 1)]


def test_curated_tables(spark):
    leagues = frame(spark, "id string, sport string, level string, status string", ("a", "football", "pro", "available"), ("b", None, None, "planned"), ("c", "football", None, "planned"))
    assert [r.id for r in curation.available(leagues).collect()] == ["a"]
    ids = lambda rows: sorted(r.id for r in rows.collect())
    assert ids(curation.under(leagues, "football")) == ["a", "c"] and ids(curation.under(leagues, "Other", "Other")) == ["b"] and ids(curation.under(leagues)) == ["a", "b", "c"]
    keys = frame(spark, "key string", ("a:1",), ("zz:2",), ("a:3",))
    teams = frame(spark, "league_id string, id string", ("a", "1"), ("a", "9"), ("c", "1"))
    assert sorted(r.id for r in curation.teams_of_favorites(keys, leagues, teams).collect()) == ["1", "9"]
    assert [r.league_id for r in curation.followed_leagues(keys).collect()] == ["a", "zz"]
    slugs = lambda *x: frame(spark, "slug string", *[(v,) for v in x])
    assert {r.slug: r.tables for r in curation.curated_slugs({"one": slugs("x", "y"), "two": slugs("y", "y")}).collect()} == {"x": ["one"], "y": ["one", "two"]}
    review = curation.review_state(slugs("x", "y"), slugs("y", "z"))
    assert tuple(curation.review_counts(review, slugs("y", "q")).first()) == (1, 1, 1, 1)
    log = frame(spark, "at timestamp, n int", *[(datetime(2024, 1, 1, i), i) for i in range(9)])
    assert [r.n for r in curation.bounded_log(log, 3).collect()] == [8, 7, 6]
    snapshot = frame(spark, "league_key string, slug string, short_name string, display_name string, mascot string", ("b", "x", "X", "X", "m"), ("a", "z", "Z", "Z", "m"), ("a", "y", "Y", "Y", "m"))
    assert [(r.league_key, [t.slug for t in r.teams]) for r in curation.roster_snapshot(snapshot).collect()] == [("a", ["y", "z"]), ("b", ["x"])]
    yields = frame(spark, "source string, items int, named int, kept int", ("a", 30, 0, 0), ("b", 30, 4, 2), ("c", 3, 0, 0))
    assert [r.source for r in curation.naming_gaps(yields).collect()] == ["a"] and sorted(r.source for r in curation.below_floor(yields, 1).collect()) == ["a", "c"]
    seen = frame(spark, "link string, team string, source string, title string, list_ord int, pos int", ("1", "t", "a", "Oak wins", 0, 0), ("1", "t", "b", "Oak wins", 0, 1), ("2", "t", "b", "Oak ad", 0, 2), ("3", "u", "b", "Elm", 0, 3))
    funnel = curation.diagnosed(curation.source_yield(seen, F.col("title").contains("Oak"), ~F.col("title").contains("ad"), ("team", "source")))
    assert sorted((r.team, r.source, r["items"], r.named, r.kept, r.diagnosis) for r in funnel.collect()) == [("t", "a", 1, 1, 1, None), ("t", "b", 1, 1, 0, "filtered"), ("u", "b", 1, 0, 0, "not named")]
    rescued = curation.rescues(frame(spark, "title string, description string, published timestamp", ("Acorns win", "", datetime(2024, 1, 2)), ("Oak Acorns", "", None), ("Nuts", "", datetime(2024, 1, 3))), ["Oak"], ["Nuts", "Acorns"])
    assert {(r.nickname, r.rescues) for r in curation.usefulness(rescued).collect()} == {("Acorns", 1), ("Nuts", 1)}
    nicknames = frame(spark, "slug string, nickname string", ("s", "Acorns"), ("s", "Hogs"), ("t", "Hens"))
    assert [r.nickname for r in curation.unhelpful(nicknames, rescued.select("nickname"), slugs("s")).collect()] == ["Hogs"]
    calls = frame(spark, "at timestamp", (datetime(2024, 1, 1, 1),), (datetime(2024, 1, 1, 2),), (datetime(2024, 1, 2),))
    assert sorted((str(r.day), r.calls, r.blocked) for r in curation.over_cap(calls, 2).collect()) == [("2024-01-01", 2, True), ("2024-01-02", 1, False)]
    catalog = curation.catalog_of(leagues, frame(spark, "league_id string, url string", ("a", "u"), ("a", "t"))).collect()
    assert {r.id: r.feeds for r in catalog} == {"a": ["t", "u"], "b": [], "c": []}
    placed = curation.in_first_order(leagues.withColumn("pos", F.lit(1)).na.fill("Other"), "sport").collect()
    assert {(r.sport, r.all_planned) for r in placed} == {("football", False), ("Other", True)}
    assert curation.untriaged(frame(spark, "id string, build string", ("1", "b"), ("2", "b"), ("3", "c")), frame(spark, "id string", ("1",)), "b").count() == 1
    assert [r.slug for r in curation.sources_of_teams(frame(spark, "short_name string", ("Oak St.",)), frame(spark, "slug string, name string", ("oak-state", "n")), {"oak-st": "oak-state"}).collect()] == ["oak-state"]


def test_labels_and_numbers(spark):
    labels = {"a": "One", "b": "Two"}
    assert column(spark, ["a", "z", None], claims.label_of(V, labels)) == ["One", "Unlabeled", "Unlabeled"]
    assert column(spark, ["news", "ad", None], claims.disagreement(V, F.lit(False))) == ["verdict keeps", None, None]
    assert column(spark, ["110", "-120", None], numbers.moneyline(V.cast("int"))) == ["+110", "-120", None]
    assert column(spark, ["1", "0", "2"], numbers.percent_label(V.cast("int"), F.lit(3))) == ["33%", "0%", "67%"]
    at = F.to_timestamp(V)
    assert column(spark, ["2024-01-06 15:30:00", "2024-01-05 09:00:00"], dates.kickoff_label(at, F.lit("2024-01-05 08:00:00").cast("timestamp"))) == ["Sat 15:30", "09:00"]
    assert column(spark, ["Oak Tree", "Elm"], text.mentions_loosely(F.array(F.lit("oak")), V)) == [True, False]
    assert column(spark, ["oak", "state", "a-b"], text.drops_a_word(V, F.lit("oak-state"))) == [True, True, False]
    weights = F.create_map(F.lit("a"), F.lit(2.0))
    both = numbers.weighted_dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c")), weights)
    assert round(spark.range(1).select(both).first()[0], 6) == round(2 * 2 / 6, 6)
    claims_ = frame(spark, "claim_type string", ("rumor",), ("take",))
    assert claims.of_claim(claims_, "all").count() == 2 and claims.of_claim(claims_, "take").count() == 1
    stats = frame(spark, "labels array<string>, values array<string>", (["A", "B"], ["1", ""]), (["A"], ["0.0"]))
    assert [(r.label, r.value) for r in boards.stat_rows(stats).collect()] == [("A", "1"), ("B", "-")]


def test_visible_colours_stay_above_the_ratio(spark):
    """Of many colours each shown form has the contrast as painted, and those that had it stay."""
    random.seed(8)
    many = [f"#{random.randrange(1 << 24):06x}" for _ in range(300)]
    for ground in ("#101418", "#ffffff"):
        rows = spark.createDataFrame([(c,) for c in many], "v string").select("v", numbers.visible_on(V, ground).alias("s"))
        rows = rows.select("v", "s", numbers.contrast(F.col("s"), F.lit(ground)).alias("c"), numbers.contrast(V, F.lit(ground)).alias("c0")).collect()
        assert all(r.c >= 3.0 and (r.s == r.v or r.c0 < 3.0) for r in rows) and any(r.s != r.v for r in rows)
