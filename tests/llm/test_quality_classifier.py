import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import quality_classifier as C

from .conftest import SF, words


def test_features():
    data, offsets = C.T.buffers(pa.array(["ab cd", None, "ab\tcd", "abcdefg"]))
    found, text = C.features(data, offsets)
    of = lambda i: sorted(found[text == i].tolist())
    assert of(0) == of(2) and not of(1)
    # 2 words, and the runs of 3: "ab ", " cd"; of 5: none, since a space would be inside
    assert len(of(0)) == 2 + 2 and len(of(3)) == 1 + 5 + 3


def runs_of(text):
    """The features of a text as strings: words, and runs of 3 and 5 characters with spaces at their ends only."""
    plain = re.sub(r"[\x20\x09-\x0D]", " ", text or "")
    out = [("word", w) for w in words(text)]
    for n in C.RUNS:
        out += [(n, plain[i : i + n]) for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1]]
    return out


def test_features_are_of_characters(documents):
    """Equal strings have equal features and, but for collisions, others differ; accented letters are whole."""
    texts = [r.text for r in documents.limit(40).collect()] + ["é😀ß", "", None, "a é b\u00a0c", " é "]
    data, offsets = C.T.buffers(pa.array(texts))
    found, owner = C.features(data, offsets, 1 << 30)
    bucket = {}
    for i, text in enumerate(texts):
        want, got = collections.Counter(runs_of(text)), collections.Counter(found[owner == i].tolist())
        assert sorted(want.values()) == sorted(got.values()) and len(found[owner == i]) == len(runs_of(text))
        (alone, _) = C.features(*C.T.buffers(pa.array([text])), 1 << 30)
        assert collections.Counter(alone.tolist()) == got
        bucket.update(dict.fromkeys(got, 0))
    assert len(bucket) == len({f for t in texts for f in runs_of(t)})


def test_learning_against_plain_python():
    """Forward pass, slopes and updates of two epochs, number by number."""
    buckets, dim, epochs, rate = 8, 3, 2, 0.7
    rows = [([0, 3], [0.25, 0.75], 1), ([1], [1.0], 0), ([3, 5, 7], [0.5, 0.25, 0.25], 0), ([0, 7], [0.5, 0.5], 1)]
    got = C.learn([(np.array(a), np.array(s, np.float32), y) for a, s, y in rows], buckets, dim, epochs, rate)
    random = np.random.default_rng(C.SEED)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).tolist()
    out, step, losses = [[0.0] * dim, [0.0] * dim], 0, []
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, share, label = rows[i]
            pace = rate * (1 - step / (epochs * len(rows)))
            step += 1
            mean = [sum(s * vectors[b][k] for b, s in zip(at, share, strict=True)) for k in range(dim)]
            logits = [sum(o * m for o, m in zip(row, mean, strict=True)) for row in out]
            total = sum(math.exp(x) for x in logits)
            p = [math.exp(x) / total for x in logits]
            losses.append(-math.log(p[label]))
            slope = [p[c] - (c == label) for c in range(2)]
            back = [sum(slope[c] * out[c][k] for c in range(2)) for k in range(dim)]
            for c in range(2):
                for k in range(dim):
                    out[c][k] -= min(pace, 1) * slope[c] * mean[k]
            for b, s in zip(at, share, strict=True):
                for k in range(dim):
                    vectors[b][k] -= pace * s * back[k]
    want = [sum(v[k] * (out[1][k] - out[0][k]) for k in range(dim)) for v in vectors]
    assert got == pytest.approx(want, abs=1e-6) and sum(losses[len(rows) :]) < sum(losses[: len(rows)])


def test_scores_against_a_loop_over_features(spark, documents):
    weights = np.random.default_rng(1).normal(size=1 << 10).astype(np.float32)
    for r, got in zip(documents.limit(30).collect(), C.score_texts(pa.array([r.text for r in documents.limit(30).collect()]), weights), strict=True):
        found, _ = C.features(*C.T.buffers(pa.array([r.text])), len(weights))
        logit = sum(float(weights[b]) for b in found) / max(len(found), 1)
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-6)


def test_sample_is_of_documents_that_exist(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 100, 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert C.labelled_sample(docs, labels, F.lit(False), 10).count() == 10


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = C.op9_quality_classifier(spark, sf)
    rows = got.where("held_out").join(labels, "doc_id").collect()
    right = [r.predicted == r.quality for r in rows]
    good = [r.predicted for r in rows if r.quality]
    assert len(rows) > 50 and np.mean(right) >= 0.93 and np.mean(good) >= 0.97
    assert got.count() == 1000 and got.where("score < 0 OR score > 1").count() == 0


def test_learns_from_the_rest_only(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = C.held_out_by(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (C.fit(C.labelled_sample(documents, x, held, 30), epochs=2) for x in (labels, turned))
    assert (one == two).all()
    assert C.labelled_sample(documents, labels, held, 3).count() == 6


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (5, 1)], "doc_id long, quality int")
    weights = C.fit(C.labelled_sample(edge_docs, labels, F.lit(False)), epochs=1)
    rows = C.classify(edge_docs, weights, C.held_out_by(F.col("doc_id"))).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (3, 4)] == [0.5, 0.5]
    none = C.fit(C.labelled_sample(edge_docs, labels.limit(0), F.lit(False)), epochs=1)
    assert C.classify(no_docs, none, F.lit(False)).count() == 0


def test_sample_has_a_row_a_document_and_a_bound_of_bytes(spark):
    docs = spark.createDataFrame([(i % 40, "word " * 20) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id long, quality int")
    sample = lambda **how: C.labelled_sample(docs, labels, F.lit(False), **how)
    assert sample().groupBy("quality").count().collect() and {(r.quality, r["count"]) for r in sample().groupBy("quality").count().collect()} == {(0, 20), (1, 20)}
    assert {(r.quality, r["count"]) for r in sample(most_bytes=250).groupBy("quality").count().collect()} == {(0, 3), (1, 3)}


def test_scan_is_not_in_the_task_that_learns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda *a: seen.append(a), raising=True)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    C.fit(C.labelled_sample(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"), F.lit(False)), epochs=1)
    assert not seen
