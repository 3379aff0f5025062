"""Tables in versions, the rolling store as a sink, counters: batches that are replayed or die midway, state that goes."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.sources import versions
from newsloom.streaming import store

from .test_streaming import run, stream

T = lambda h, m=0, d=1: datetime(2024, 1, d, h, m)
ARRIVAL = "team string, link string, description string, published timestamp, seen_at timestamp"


def arrivals(n=90, days=16):
    random.seed(8)
    rows = []
    for i in range(n):
        at = T(0) + timedelta(days=days * i / n)
        published = random.choice([None, at - timedelta(hours=random.randrange(100))])
        rows.append((random.choice(["t1", "t2", None if i % 30 == 7 else "t3"]), f"u{random.randrange(25)}", f"d{i}", published, at))
    return rows


def folded(batches, keep):
    """The store after all batches, row by row."""
    held, week = {}, timedelta(days=7)
    for batch in batches:
        batch = [r for r in batch if r[0] and r[1] and r[4]]
        if not batch:
            continue
        now = max(r[4] for r in batch)
        fresh = {(r[0], r[1]): r for r in sorted(batch, key=lambda r: r[4])}
        merged = {k: (r[2], r[3], held[k][2] if k in held else now) for k, r in fresh.items()}
        merged |= {k: v for k, v in held.items() if k not in fresh and now - (v[1] or v[2]) <= week}
        held = {}
        for team in {k[0] for k in merged}:
            mine = sorted(((k, v) for k, v in merged.items() if k[0] == team), key=lambda e: (e[1][1] is None, -(e[1][1] or T(0)).timestamp(), e[0][1]))
            held |= dict(mine[:keep])
    return held


def rows_of(spark, path):
    return {(r.team, r.link): (r.description, r.published, r.first_seen) for r in versions.read(spark, path).collect()}


def test_the_stream_makes_the_store_of_a_fold(spark, tmp_path):
    rows, path = arrivals(), str(tmp_path / "store")
    batches = [rows[i : i + 30] for i in range(0, 90, 30)]
    q = stream(spark, tmp_path, ARRIVAL, *batches).writeStream.foreachBatch(store.merge_into(path, keep=6)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    want = folded(batches, 6)
    assert rows_of(spark, path) == want and len(want) == 18 and len(versions.committed(spark, path)) == 2


def test_replayed_and_broken_batches(spark, tmp_path, monkeypatch):
    rows, path = arrivals(60), str(tmp_path / "store")
    one, two = (spark.createDataFrame(r, ARRIVAL) for r in (rows[:30], rows[30:]))
    merge = store.merge_into(path, keep=6)
    merge(one, 0)
    first = rows_of(spark, path)
    merge(two, 0)  # a batch id that counts already
    assert rows_of(spark, path) == first == folded([rows[:30]], 6)
    real = versions._at

    def dies(spark, at):
        if "/_commits/" in at:
            raise OSError("gone")
        return real(spark, at)

    monkeypatch.setattr(versions, "_at", dies)
    with pytest.raises(OSError):
        merge(two, 1)
    monkeypatch.undo()
    assert versions.committed(spark, path) == [0] and rows_of(spark, path) == first  # written, but without its record
    merge(two.limit(0), 1)
    assert rows_of(spark, path) == first
    merge(two, 1)
    assert rows_of(spark, path) == folded([rows[:30], rows[30:]], 6) != first


def test_teams_not_used_lately_leave_the_store(spark, tmp_path):
    uses = spark.createDataFrame([("t1", T(1)), ("t2", T(5)), ("t3", T(3)), ("t3", T(9))], "team string, used_at timestamp")
    store.merge_into(str(tmp_path / "s"), uses=uses, teams=2)(spark.createDataFrame(arrivals(40), ARRIVAL), 3)
    assert {k[0] for k in rows_of(spark, str(tmp_path / "s"))} == {"t2", "t3"} and versions.committed(spark, str(tmp_path / "s")) == [3]


def test_versions(spark, tmp_path):
    path, rows = str(tmp_path / "v"), lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert versions.read(spark, path) is None and versions.committed(spark, path) == [] and versions.pruned(spark, path) == []
    assert versions.publish(rows(1), path) and versions.publish(versions.read(spark, path).union(rows(2)), path) and versions.publish(rows(), path, 7)
    assert not versions.publish(rows(9), path, 7) and not versions.publish(rows(9), path, 3)
    assert versions.committed(spark, path) == [0, 1, 7] and versions.read(spark, path).count() == 0 and versions.read(spark, path, 5) is None
    assert sorted(r.v for r in versions.read(spark, path, 1).collect()) == [1, 2]
    rows(5).write.parquet(f"{path}/versions/0004")  # of an attempt that died
    assert versions.pruned(spark, path, 1) == [0, 1] and versions.committed(spark, path) == [7]
    assert [p.name for p in (tmp_path / "v/versions").iterdir()] == ["7"]


def test_catalogues_are_swapped_or_kept(spark, tmp_path):
    path, table = str(tmp_path / "c"), lambda *x: spark.createDataFrame(list(x), "id string, status string")
    with pytest.raises(ValueError):
        versions.swap_catalog(table(("a", "planned")), path)
    ids = lambda rows: sorted(r.id for r in rows.collect())
    assert ids(versions.swap_catalog(table(("a", "available")), path)) == ["a"]
    assert ids(versions.swap_catalog(table(("b", "planned")), path)) == ["a"]  # kept, as nothing is available
    assert ids(versions.swap_catalog(table(("a", "available")), path)) == ["a"] and versions.committed(spark, path) == [0]
    assert ids(versions.swap_catalog(table(("b", "available"), ("c", "planned")), path)) == ["b", "c"] and versions.committed(spark, path) == [0, 1]


def test_calls_of_a_day(spark, tmp_path):
    schema = "at timestamp, prefix string, n int"
    calls = [[(T(1), "calls", 2), (T(23), "calls", None), (T(2), "vet", 1)], [(T(3, d=2), "calls", 5), (T(4), "calls", 1), (None, "calls", 9)], [(T(1, d=9), "calls", 1)], [(T(3, d=9), "vet", 1)], [(T(5), "calls", 50), (T(2, d=9), "calls", 1)]]
    q = store.daily_calls(stream(spark, tmp_path, schema, *calls)).writeStream.format("memory").queryName("calls").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    counts = spark.table("calls")
    last = {(r.day, r.prefix): r.calls for r in counts.groupBy("day", "prefix").agg(F.max("calls").alias("calls")).collect()}
    assert last == {(date(2024, 1, 1), "calls"): 4, (date(2024, 1, 1), "vet"): 1, (date(2024, 1, 2), "calls"): 5, (date(2024, 1, 9), "calls"): 2, (date(2024, 1, 9), "vet"): 1}  # what came a week late counts no more
    assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) == 2
    asked = spark.createDataFrame([(1, "calls", T(9)), (2, "vet", T(9)), (3, "calls", T(9, d=3)), (4, "other", T(9)), (5, None, T(9)), (6, "calls", None), (7, "calls", T(1, d=2))], "i int, prefix string, at timestamp")
    caps = spark.createDataFrame([("calls", 5), ("vet", 1)], "prefix string, cap int")
    assert {r.i: r.allowed for r in store.within_cap(asked, counts, caps).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_titles_are_asked_about_once_in_ninety_days(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    s = stream(spark, tmp_path, "title string, at timestamp", [("One  title", day(0)), (None, day(0))], [("one title", day(60)), ("Two", day(60))], [("three", day(100))], [("three", day(101))], [("ONE TITLE", day(102)), ("two", day(102))])
    got = sorted((r[1], r[2]) for r in run(spark, store.new_titles(s), "append"))
    assert got == [("ONE TITLE", day(102)), ("One  title", day(0)), ("Two", day(60)), ("three", day(100))]
