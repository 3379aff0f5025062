"""Streams: arrivals of articles, read marks, live boards and markers. Each has a batch twin."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions import text as T
from newsloom.functions.dates import period_key
from newsloom.operators.cluster import WINDOW_HOURS, Words

WEEK = "7 days"
POLL_LIVE, POLL_SUMMARY = "30 seconds", "20 seconds"


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window; those later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def first_marks(marks: DataFrame) -> DataFrame:
    """The first read mark of a link within a week counts."""
    return marks.withWatermark("read_at", WEEK).dropDuplicatesWithinWatermark(["link"])


def first_seen(arrivals: DataFrame) -> DataFrame:
    """team, link, first_seen, seen_at for each arrival: when a link first came, for a week from then on.

    State is one time per link and goes after the week.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames)
        first = min(rows["seen_at"].min(), pd.Timestamp(state.get[0])) if state.exists else rows["seen_at"].min()
        state.update((first,))
        due = int(first.timestamp() * 1000) + 7 * 86_400_000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"team": key[0], "link": key[1], "first_seen": first, "seen_at": rows["seen_at"].max()}, index=[0])

    keyed = arrivals.withWatermark("seen_at", "0 seconds").groupBy("team", "link")
    return keyed.applyInPandasWithState(
        fold,
        "team string, link string, first_seen timestamp, seen_at timestamp", "first_seen timestamp", "update", GroupStateTimeout.EventTimeTimeout
    )


def alike_arrivals(newer: DataFrame, older: DataFrame, words: Words = Words(), least_shared: int = 3, late: str = "1 hour") -> DataFrame:
    """feed, anchor, link, anchor_at, shared: titles that came at most 36 hours apart with ``least_shared`` tokens in common, newer (then smaller link) first.

    newer and older are the same arrivals (feed, link, title, source, published), read twice. As a stream, state on both sides goes when no title within the window can come any more, a pair is told
    when the watermark has passed its newer title, and arrivals later than the watermark are left out; tables give all pairs. Repeated arrivals count once; those without a feed or date don't count.
    """

    def side(rows: DataFrame, *names: str) -> DataFrame:
        dated = rows.where("published IS NOT NULL").withWatermark("published", late)
        tokens = F.array_distinct(T.title_tokens(F.col("title"), F.col("source"), words.stopwords, words.prefixes))
        return dated.select("feed", F.explode(tokens).alias("token"), "link", "published").toDF(*names)

    a, b = side(newer, "feed", "token", "anchor", "anchor_at"), side(older, "_feed", "_token", "link", "at")
    near = (F.col("at") <= F.col("anchor_at")) & (F.col("at") >= F.col("anchor_at") - F.make_dt_interval(hours=F.lit(WINDOW_HOURS)))
    ordered = (F.col("anchor_at") > F.col("at")) | (F.col("anchor") < F.col("link"))
    met = a.join(b, (F.col("feed") == F.col("_feed")) & (F.col("token") == F.col("_token")) & near & ordered).where("anchor <> link")
    shared = F.size(F.collect_set("token")).alias("shared")
    return met.select("feed", "anchor", "link", "anchor_at", "token").groupBy("feed", "anchor", "link", "anchor_at").agg(shared).where(F.col("shared") >= least_shared)


def last_good_boards(polls: DataFrame) -> DataFrame:
    """league_id, body, polled_at: the last poll that succeeded; a failed one (body null) keeps it. A late answer loses to a newer one."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).dropna(subset=["body"]).sort_values("polled_at")
        known = state.getOption
        if len(rows) and (known is None or rows["polled_at"].iloc[-1] >= pd.Timestamp(known[1])):
            state.update((rows["body"].iloc[-1], rows["polled_at"].iloc[-1]))
        if state.exists:
            body, at = state.get
            yield pd.DataFrame({"league_id": [key[0]], "body": [body], "polled_at": [at]})

    return polls.groupBy("league_id").applyInPandasWithState(
        fold, "league_id string, body string, polled_at timestamp", "body string, polled_at timestamp", "update", GroupStateTimeout.NoTimeout
    )


def markers(visits: DataFrame) -> DataFrame:
    """game_id, play_id, at: where each game was last left; a final game (state post) clears its marker."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.concat(frames).sort_values("at").iloc[-1]
        if last["state"] == "post":
            state.remove()
            yield pd.DataFrame({"game_id": [key[0]], "play_id": pd.Series([None], dtype=object), "at": [last["at"]]})
        else:
            state.update((last["play_id"],))
            yield pd.DataFrame({"game_id": [key[0]], "play_id": [last["play_id"]], "at": [last["at"]]})

    return visits.groupBy("game_id").applyInPandasWithState(fold, "game_id string, play_id string, at timestamp", "play_id string", "update", GroupStateTimeout.NoTimeout)


def kept_markers(rows: DataFrame, keep: int = 20) -> DataFrame:
    """The newest markers of the batch view."""
    return rows.where("play_id IS NOT NULL").orderBy(F.desc("at"), "game_id").limit(keep)


def reader_markers(visits: DataFrame, keep: int = 20) -> DataFrame:
    """reader, game_id, play_id, at for each marker that changes: where a reader last left a game; play_id is null where the marker is gone.

    visits: reader, game_id, play_id, state, at; those of a trigger count in the order of at, then game_id, then play_id, and the last of a game stands. A final game (state post) clears
    its marker. A reader's markers are one state of at most ``keep`` games; beyond, the one left longest ago goes, for good. Visits without a reader or a game aren't marked.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        changed = {}
        for v in pd.concat(frames).sort_values(["at", "game_id", "play_id"]).itertuples():
            kept.pop(v.game_id, None)
            changed[v.game_id] = (None if v.state == "post" else v.play_id, v.at)
            if v.state != "post":
                kept[v.game_id] = [v.play_id, v.at.isoformat()]
            if len(kept) > keep:
                oldest = min(kept, key=lambda g: (pd.Timestamp(kept[g][1]), g))
                changed[oldest] = (None, pd.Timestamp(kept.pop(oldest)[1]))
        if kept:
            state.update((json.dumps(kept),))
        elif state.exists:
            state.remove()
        rows = [(key[0], game, play, at) for game, (play, at) in changed.items()]
        yield pd.DataFrame(rows, columns=["reader", "game_id", "play_id", "at"]).astype({"play_id": object})

    told = visits.where("reader IS NOT NULL AND game_id IS NOT NULL AND at IS NOT NULL")
    return told.groupBy("reader").applyInPandasWithState(
        fold, "reader string, game_id string, play_id string, at timestamp", "kept string", "update", GroupStateTimeout.NoTimeout
    )


def poll_delay(now: float, kickoff: float | None, live: bool) -> float | None:
    """Seconds to the next poll: 30 while a game is on, else towards the next kickoff, from 30 s to 15 min."""
    if live:
        return 30.0
    return None if kickoff is None else min(max(kickoff - now, 30.0), 900.0)


def summary_poll_delay(live: bool, focused: bool, foreground: bool) -> float | None:
    """Seconds to the next poll of a game's summary: 20 while it is on and looked at, else none."""
    return 20.0 if live and focused and foreground else None


def refresh_claims(attempts: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of the attempts (at) in each refresh period, which claims it; period is its key."""
    return attempts.withColumn("period", period_key(F.col("at"))).withWatermark("at", late).dropDuplicatesWithinWatermark(["period"])
