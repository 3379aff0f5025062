"""When to ask again, as streams with timers: a row comes out whenever a league's board or a game's summary is due.

What is asked then comes back as a row of the stream that goes in, which sets the timer anew. An answer that never comes leaves the timer as it was, so
that the next row is due one delay later. State is a few facts a key, and goes when there is nothing to wait for.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .live import poll_delay, summary_poll_delay


def _due(rows: DataFrame, keys: list[str], facts: dict[str, Column], delay: Callable[[float, dict], float | None]) -> DataFrame:
    """keys, due_at: each time that the delay for a key's latest facts (by at) has gone by; delay takes the time in seconds and the facts."""

    def wait(state: GroupState, known: dict, at: float) -> None:
        now = state.getCurrentProcessingTimeMs() / 1000
        seconds = delay(now, known)
        if seconds is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(known), at, now + seconds))
            state.setTimeoutDuration(max(int(seconds * 1000), 1))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            known, at, due = state.get
            wait(state, json.loads(known), at)
            yield pd.DataFrame([(*key, pd.Timestamp(round(due * 1000), unit="ms"))], columns=[*keys, "due_at"])
            return
        last = pd.concat(frames).sort_values(["_at", "_facts"]).iloc[-1]
        if not state.exists or last["_at"] >= state.get[1]:
            wait(state, json.loads(last["_facts"]), float(last["_at"]))
        else:  # a late answer: what is known stays, with the time that is left
            left = state.get[2] - state.getCurrentProcessingTimeMs() / 1000
            state.setTimeoutDuration(max(int(left * 1000), 1))

    told = F.to_json(F.struct(*[c.alias(name) for name, c in facts.items()]), {"ignoreNullFields": "false"})
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "at"])).select(*keys, (F.unix_micros("at") / 1e6).alias("_at"), told.alias("_facts"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name in keys)
    return known.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, due_at timestamp", "facts string, at double, due double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def due_boards(boards: DataFrame, delay: Callable = poll_delay) -> DataFrame:
    """league_id, due_at for each time that a league's board is to be asked for.

    boards: league_id, live (a followed game is on), kickoff (of the next one, or null), at; the latest of a league counts, without a league or at none does. While
    a game is on the next one is due after 30 s, else towards the kickoff, after 30 s to 15 min; without either none is.
    """
    facts = {"live": F.coalesce("live", F.lit(False)), "kickoff": F.unix_micros("kickoff") / 1e6}
    return _due(boards, ["league_id"], facts, lambda now, known: delay(now, known["kickoff"], known["live"]))


def due_summaries(views: DataFrame, delay: Callable = summary_poll_delay) -> DataFrame:
    """reader, game_id, due_at for each time that a game's summary is to be asked for: every 20 s, while it is on and its reader looks at it.

    views: reader, game_id, live, focused, foreground, at; the latest of a reader's game counts, nulls are false.
    """
    names = ("live", "focused", "foreground")
    return _due(views, ["reader", "game_id"], {n: F.coalesce(n, F.lit(False)) for n in names}, lambda _, known: delay(*[known[n] for n in names]))
