import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.sources import stores
from newsloom.streaming import live

T = lambda h, m=0, d=1: datetime(2024, 1, d, h, m)


def stream(spark, tmp_path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def run(spark, df, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_windowed_counts_match_the_batch(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    rows = [(1, T(1, m)) for m in (0, 10, 50)] + [(2, T(3))]
    s = stream(spark, tmp_path, schema, rows, [(9, T(9))])
    got = run(spark, live.windowed_counts(s), "append")
    batch = {tuple(r) for r in live.windowed_counts(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == batch == {(T(1), 3), (T(3), 1)}


def test_first_seen_survives(spark, tmp_path):
    schema = "team string, link string, seen_at timestamp"
    s = stream(spark, tmp_path, schema, [("t", "a", T(1))], [("t", "a", T(5)), ("t", "b", T(6))])
    got = run(spark, live.first_seen(s), "update")
    assert ("t", "a", T(1), T(5)) in got and ("t", "b", T(6), T(6)) in got


def test_first_mark_counts(spark, tmp_path):
    s = stream(spark, tmp_path, "link string, read_at timestamp", [("a", T(1)), ("b", T(2))], [("a", T(3))])
    assert sorted(run(spark, live.first_marks(s), "append")) == [("a", T(1)), ("b", T(2))]


def test_alike_arrivals_match_the_batch(spark, tmp_path):
    """Over several triggers the stream tells the pairs that the table has, and its state goes."""
    random.seed(4)
    words = ["harbor", "council", "bridge", "market", "garden", "winter", "player", "signing"]
    rows = [(f"f{i % 2}", f"l{i:02}", " ".join(random.sample(words, 4)), "s", T(0) + timedelta(hours=2 * i)) for i in range(60)]
    rows += [rows[5], (None, "n", rows[5][2], "s", rows[5][4]), ("f1", "none", rows[5][2], "s", None), ("f1", "empty", "", "s", T(5)), ("f1", "null", None, "s", T(5))]
    rows.sort(key=lambda r: r[4] or T(0))
    schema = "feed string, link string, title string, source string, published timestamp"
    batches = [rows[i : i + 22] for i in range(0, len(rows), 22)]
    s = stream(spark, tmp_path, schema, *batches, [("z", "z", "last", "s", T(0) + timedelta(days=60))])
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.alike_arrivals(s, again).writeStream.format("memory").queryName("alike").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = spark.createDataFrame(rows, schema)
    batch = sorted(map(tuple, live.alike_arrivals(table, table).collect()))
    tokens = {r[1]: set(r[2].split()) for r in rows if r[2]}
    at = {r[1]: r for r in rows if r[0] and r[4]}
    want = sorted(
        (x[0], x[1], y[1], x[4], len(tokens[x[1]] & tokens[y[1]]))
        for x in at.values() for y in at.values()
        if x[0] == y[0] and x[1] in tokens and y[1] in tokens and timedelta(0) < x[4] - y[4] <= timedelta(hours=36) and len(tokens[x[1]] & tokens[y[1]]) >= 3
    )
    assert batch == want and len(want) > 20
    assert sorted(map(tuple, spark.table("alike").collect())) == want
    joined = q.lastProgress["stateOperators"]
    assert sum(o["numRowsTotal"] for o in joined) < 10


def test_failed_poll_keeps_the_board(spark, tmp_path):
    s = stream(spark, tmp_path, "league_id string, body string, polled_at timestamp", [("l", "one", T(2))], [("l", None, T(3))], [("l", "late", T(1))])
    assert {r[1] for r in run(spark, live.last_good_boards(s), "update")} == {"one"}


def test_markers_clear_at_the_end(spark, tmp_path):
    s = stream(spark, tmp_path, "game_id string, play_id string, state string, at timestamp", [("g", "p1", "in", T(1)), ("h", "q", "in", T(1))], [("g", "p9", "post", T(2))])
    got = run(spark, live.markers(s), "update")
    assert ("h", "q", T(1)) in got and ("g", None, T(2)) in got
    assert live.poll_delay(0, 100, False) == 100 and live.poll_delay(0, 10**6, False) == 900 and live.poll_delay(0, None, True) == 30


def test_markers_of_a_reader_are_bounded(spark, tmp_path):
    """Over several triggers: what a reader's markers are at the end is what one fold over all visits leaves."""
    random.seed(3)
    visits = [(random.choice("ab"), f"g{random.randrange(7)}", f"p{i}", "post" if i % 9 == 8 else "in", T(1) + timedelta(minutes=i)) for i in range(60)]
    want = {"a": {}, "b": {}}
    for reader, game, play, state, _ in visits:
        mine = want[reader]
        mine.pop(game, None)
        if state != "post":
            mine[game] = play
        if len(mine) > 3:
            mine.pop(next(iter(mine)))
    schema = "reader string, game_id string, play_id string, state string, at timestamp"
    s = stream(spark, tmp_path, schema, *[visits[i : i + 15] for i in range(0, 60, 15)], [(None, "g", "p", "in", T(1)), ("a", None, "p", "in", T(1)), ("b", "old", "p", "in", T(0))])
    got = {"a": {}, "b": {}}
    for reader, game, play, _ in run(spark, live.reader_markers(s, keep=3), "update"):
        got[reader].pop(game, None)
        if play is not None:
            got[reader][game] = play
    assert got == want and max(map(len, want.values())) == 3


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda team, *links: spark.createDataFrame([(team, x, "word " * 100, i + 1) for i, x in enumerate(links)], "team string, link string, description string, rn int")
    stores.write_teams(rows("a", "1", "2").unionByName(rows("b", "3")), path)
    stores.write_teams(rows("a", "9"), path)
    got = spark.read.parquet(path)
    assert sorted((r.team, r.link) for r in got.collect()) == [("a", "9"), ("b", "3")] and all(len(r.description) <= 301 and r.description.endswith("…") for r in got.collect())
    assert stores.clear(spark, path) == 2 and spark.read.parquet(path).count() == 0
    old, new = spark.createDataFrame([("a", 1, T(1)), ("b", 1, T(1))], "k string, v int, at timestamp"), spark.createDataFrame([("a", 2, T(2))], "k string, v int, at timestamp")
    assert sorted((r.k, r.v) for r in stores.upserted(old, new, "k").collect()) == [("a", 2), ("b", 1)]


def test_periods_are_claimed_once(spark, tmp_path):
    s = stream(spark, tmp_path, "who string, at timestamp", [("a", T(6))], [("b", T(7)), ("c", T(12))], [("d", T(4, d=2))])
    assert sorted((r[0], r[2]) for r in run(spark, live.refresh_claims(s), "append")) == [("a", "2024-01-01:morning"), ("c", "2024-01-01:midday"), ("d", "2024-01-01:evening")]
    assert live.summary_poll_delay(True, True, True) == 20 and live.summary_poll_delay(True, False, True) is None
    rows = spark.createDataFrame([("g", f"p{i}", T(1, i)) for i in range(25)] + [("h", None, T(9))], "game_id string, play_id string, at timestamp")
    assert [r.play_id for r in live.kept_markers(rows).collect()][:2] == ["p24", "p23"] and live.kept_markers(rows).count() == 20


def test_keyed_tables_marks_and_reports(spark, tmp_path):
    path = str(tmp_path / "keyed")
    table = lambda *rows: spark.createDataFrame(list(rows), "k string, v int, at timestamp")
    table(("a", 1, T(1)), ("b", 1, T(1))).write.parquet(path)
    stores.write_keyed(table(("a", 2, T(1)), ("b", 0, T(0)), ("c", 3, None)), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 3)]
    assert {r.k for r in stores.unexpired(table(("a", 1, T(1)), ("b", 1, T(1, d=9))), F.lit("2024-01-11 00:00:00").cast("timestamp"), days=5).collect()} == {"b"}
    marks, mark = str(tmp_path / "marks"), lambda *rows: spark.createDataFrame(list(rows), "link string, read_at timestamp")
    mark(("x", T(1)), ("y", T(1))).write.parquet(marks)
    stores.write_marks(mark(("x", T(2, d=8)), ("z", T(1, d=9))), marks, F.lit("2024-01-09 12:00:00").cast("timestamp"))
    assert sorted(r.link for r in spark.read.parquet(marks).collect()) == ["x", "z"]
    status = spark.createDataFrame([("OK", "rss", 3, 5, "u1", False), ("HTTP", None, 0, 9, "u2", True)], "status string, format string, items int, ms int, url string, slow boolean")
    stores.write_report(stores.status_report(status), str(tmp_path / "text"), "line")
    lines = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert lines[0].startswith("HTTP") and lines[1].startswith("OK") and lines[2] == "1 passing, 1 failing, 1 slow"
    stores.write_report(status, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    logs = spark.createDataFrame([(T(1), "a"), (T(5), "b")], "at timestamp, event string")
    stores.write_logs(logs.withColumnRenamed("event", "path"), logs, str(tmp_path / "logs"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 02:00:00").cast("timestamp"))
    assert sorted((r.kind, "a" in r.row) for r in spark.read.json(str(tmp_path / "logs")).collect()) == [("raw", True), ("shaped", True)]
    favorites = spark.createDataFrame([("me", [" 13 ", "l:13"]), ("you", [])], "owner string, entries array<string>")
    assert {r.owner: (r.entries, r.onboarded) for r in stores.hydrated_favorites(favorites, "l").collect()} == {"me": (["l:13"], True), "you": ([], False)}
