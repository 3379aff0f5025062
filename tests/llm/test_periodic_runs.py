import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import periodic_runs as P

from .conftest import SF, words


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def plain_runs(w, power=P.POWER, shortest=P.SHORTEST):
    """Every maximal stretch of each period, kept where the period is its smallest."""
    out = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(shortest, power * q) and j > i and smallest_period(w[i : i + length]) == q:
                out.add((i, length, q))
            i = max(j, i) + 1
    return sorted(out)


def planted(w, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(text, doc_id):
    w = planted(words(text), doc_id)
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    return (doc_id, len(runs), start, length, period, best and 1000 * length // period, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_plain_python(spark):
    rows = P.op11_periodic_runs(spark, SF)
    assert rows.columns == COLUMNS
    want = [plain_row(r.text, r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in rows.collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in want) > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=40), max_size=5))
def test_runs_of_pieces(pieces):
    got = P.runs_of(pieces)
    assert got == [(k, *r) for k, w in enumerate(pieces) for r in plain_runs(w)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=5))
def test_words_left_out_are_in_no_run(texts):
    """Through the n-grams as well."""
    runs, collapsed = P.of_batch(pa.array([" ".join(w) for w in texts], pa.string()), group=30)
    for w, found, rest in zip(texts, runs, collapsed, strict=True):
        want = plain_runs(w)
        assert [tuple(r.values()) for r in found] == want
        drop = {i for s, n, q in want for i in range(s + q, s + n)}
        assert rest == " ".join(x for i, x in enumerate(w) if i not in drop)


def test_nested_and_overlapping_runs():
    w = ("a a a a a a b " * 5).split()
    assert {(s, n, q) for _, s, n, q in P.runs_of([w])} == set(plain_runs(w)) and len(plain_runs(w)) == 6


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=40))
def test_extensions(text):
    s = [ord(c) - 96 for c in text] + [0]
    e = P.Extensions(*P.tour(P.tree(s, 4), 4, 1))
    a, b = map(np.array, zip(*[(i, j) for i in range(len(s)) for j in range(len(s)) if i != j], strict=True))
    common = lambda i, j: next(k for k in range(len(s)) if s[i + k] != s[j + k])
    assert e.of(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(range(len(s)), key=lambda i: s[i:]) == np.argsort(e.rank).tolist()


def test_lyndon_orders():
    """Both orders put an end first; the second turns the alphabet."""
    s = [2, 1, 2, 2, 1, 0]
    back = P.tour(P.tree(s, 3), 3, 1, True)[0].tolist()
    turned = [[0 if c == 0 else 3 - c for c in s[i:]] for i in range(6)]
    assert back == sorted(range(6), key=lambda i: turned[i])
    assert P.next_smaller(np.array([3, 1, 2, 0])).tolist() == [1, 3, 3, 4]


def test_edges(spark, edge_docs, no_docs):
    rows = P.periodic_runs(edge_docs)
    assert rows.columns == [*edge_docs.columns, "runs", "collapsed"] and rows.count() == 10
    got = {r.doc_id: r for r in rows.where("doc_id IS NOT NULL").collect()}
    assert got[3].collapsed == got[4].collapsed == "" and got[3].runs == []
    (run,) = got[5].runs
    assert (run.start, run.length, run.period) == (0, 15_000, 5) and got[5].collapsed == "lorem ipsum dolor sit amet"
    assert got[6].collapsed == "lorem ipsum dolor sit amet end" and got[5].size == "mine"
    assert P.periodic_runs(no_docs).count() == 0
    clash = edge_docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    assert sorted(r.collapsed or "" for r in P.periodic_runs(clash).collect()) == sorted(r.collapsed or "" for r in rows.collect())
    null = P.periodic_runs(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert null.runs == [] and null.collapsed == ""


def test_planting(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i in ids for n in (1, 2, 7, 40)] + [(5, ""), (None, "a b c"), (ids[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select(F.struct("doc_id", "text").alias("r"), P.with_planted(F.col("text"), F.col("doc_id")).alias("t")).collect()
    assert len(ids) > 30
    for r in got:
        assert words(r.t) == planted(words(r.r.text), r.r.doc_id)


@pytest.mark.parametrize("period", [1, 3, 500, 40_000])
def test_long_texts(period):
    rng = random.Random(period)
    cycle = [f"w{rng.random()}" for _ in range(period)]
    w = [f"a{i}" for i in range(1000)] + cycle * max(4, 2000 // period) + ["z"]
    (runs,), (rest,) = P.of_batch(pa.array([" ".join(w)]))
    assert [tuple(r.values()) for r in runs] == [(1000, period * max(4, 2000 // period), period)]
    assert rest.split() == w[:1000] + cycle + ["z"]
