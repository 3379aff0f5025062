"""Timers of polls, on the clock: delays are cut to tenths of seconds."""

import time
from datetime import datetime, timedelta, timezone

from newsloom.streaming import live, polls

NOW = datetime.now(timezone.utc).replace(tzinfo=None)


def put(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def until(found, most=40):
    end = time.time() + most
    while not found() and time.time() < end:
        time.sleep(0.5)
    return found()


def started(spark, df, name):
    return df.writeStream.format("memory").queryName(name).outputMode("update").trigger(processingTime="1 second").start()


def test_boards_are_due_while_games_are_on(spark, tmp_path):
    schema, at = "league_id string, live boolean, kickoff timestamp, at timestamp", str(tmp_path / "in")
    soon = NOW + timedelta(days=1)
    put(spark, [("on", True, None, NOW), ("next", False, soon, NOW), ("off", False, None, NOW), (None, True, None, NOW), ("none", True, None, None), ("null", None, None, NOW)], schema, at)

    def delay(now, kickoff, is_live):
        seconds = live.poll_delay(now, kickoff, is_live)
        return seconds and seconds / 300  # 0.1 s for 30 s, 3 s for 15 min

    q = started(spark, polls.due_boards(spark.readStream.schema(schema).parquet(at), delay), "due_boards")
    try:
        due = lambda: [r.league_id for r in spark.table("due_boards").collect()]
        assert until(lambda: due().count("on") >= 2 and "next" in due())  # again and again, though nothing comes back
        assert due().count("on") >= due().count("next") and set(due()) == {"on", "next"}
        put(spark, [("on", False, None, NOW + timedelta(minutes=1)), ("next", False, None, NOW - timedelta(days=1))], schema, at)  # over; a late answer
        assert until(lambda: q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1)
        told = due()
        assert until(lambda: due().count("next") > told.count("next")) and due().count("on") == told.count("on")
    finally:
        q.stop()


def test_summaries_are_due_while_they_are_looked_at(spark, tmp_path):
    schema, at = "reader string, game_id string, live boolean, focused boolean, foreground boolean, at timestamp", str(tmp_path / "in")
    put(spark, [("a", "g", True, True, True, NOW), ("b", "g", True, True, False, NOW), ("c", "g", True, None, True, NOW), ("d", "g", False, True, True, NOW)], schema, at)
    q = started(spark, polls.due_summaries(spark.readStream.schema(schema).parquet(at), lambda *known: live.summary_poll_delay(*known) and 0.1), "due_summaries")
    try:
        assert until(lambda: spark.table("due_summaries").count() >= 2)
        assert {(r.reader, r.game_id) for r in spark.table("due_summaries").collect()} == {("a", "g")} and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    finally:
        q.stop()
