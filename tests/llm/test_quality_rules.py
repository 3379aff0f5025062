import collections
import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import quality_rules as Q

from .conftest import SF, words

MASK = (1 << 64) - 1


def of_text(w):
    return xxhash.xxh64_intdigest(w.encode(), 42)


def of_longs(*xs):
    h = 42
    for x in xs:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", x & MASK), h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def grams(text):
    h = [of_text(w) for w in words(text)]
    return [signed(x) % Q.BUCKETS for x in h + [of_longs(a, b) for a, b in zip(h, h[1:])]]


def test_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r[0] for r in Q.trusted_of(labels).collect()}
    docs = documents.collect()
    raw, target = collections.Counter(), collections.Counter()
    for d in docs:
        g = grams(d.text)
        raw.update(g)
        if d.doc_id in trusted:
            target.update(g)
    r, t, prior = sum(raw.values()), sum(target.values()), Q.SMOOTHING * Q.BUCKETS
    # the target multinomial, drawn to the raw one by the prior, against the raw one
    ratio = lambda b: math.log((target[b] + prior * raw[b] / r) / (t + prior)) - math.log(raw[b] / r)
    got = {x.doc_id: x for x in Q.op1_quality_rules(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        x, g = got[d.doc_id], grams(d.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(d.text)
        score = sum(map(ratio, g)) / len(g)
        assert x.score == pytest.approx(score, abs=1e-3)
        if abs(score - Q.THRESHOLD) > 1e-3:
            assert x.kept == (not x.base_failed and score >= Q.THRESHOLD)


@pytest.mark.parametrize(("sf", "caught"), [("sf0.001", 0), ("sf0.01", 0.8)])
def test_clean_documents_stay_and_junk_goes(spark, sf, caught):
    sf = SF.replace("sf0.001", sf)
    rows = Q.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert all(r.kept for r in rows if r.quality)
    junk = [r for r in rows if not r.quality]
    assert sum(not r.kept for r in junk) >= caught * len(junk)


@pytest.mark.parametrize("text", ["a b c d e f g h " * 4, " ".join(map(str, range(40))) + " 3 4 5 6 7 8 9 10", "x\nx\n \n \nx y", "one two", "w " * 9])
def test_repeats(spark, edge_docs, text):
    got = Q.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), edge_docs.limit(0)).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == base(text)


def test_edges(edge_docs, no_docs):
    rows = Q.quality_rules(edge_docs, edge_docs.where("doc_id = 1").select("doc_id")).collect()
    assert len(rows) == 10 and {r["size"] for r in rows} == {"mine"}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
    assert Q.quality_rules(no_docs, no_docs.select("doc_id")).count() == 0


def test_columns_named_like_temporary_ones(spark, documents):
    names = ["_m", "__m", "_id", "_deal", "_trusted", "t", "g", "bucket", "raw"]
    more, trusted = documents.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names}), documents.where("doc_id % 2 = 0").select("doc_id")
    got = Q.quality_rules(more, trusted)
    assert sorted(got.columns) == sorted([*more.columns, *Q.COMPUTED])
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)
    columns = ["doc_id", *Q.COMPUTED]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, Q.quality_rules(documents, trusted).select(*columns).collect()))
