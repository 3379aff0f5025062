"""A text of 400,000 words and one of a single word of two million characters, through every operator."""

import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, license_scan, lm_score, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, token_counts, warc
from newsloom.llm.common import shared_path

ITEM = "the quick brown fox jumps over the lazy dog near the river bank at dawn"
SECRET = "password = hunter2hunter2hunter2"


@pytest.fixture(scope="module")
def long_docs(spark):
    words = [f"w{i * i % 9973}" for i in range(400_000)]
    tail = f"\nReleased under the MIT License.\n{ITEM}\n{SECRET}"
    rows = [(1, " ".join(words) + tail, "a"), (2, " ".join([*words[:-1], "other"]) + tail, "a"), (3, "x" * 2_000_000, "b"), (4, "short text", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()


def test_rules_and_sizes(long_docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(long_docs, long_docs.where("doc_id = 4")).collect()}
    assert got[1].n_words == 400_000 + 5 + 15 + 3 and got[3].word_chars == 2_000_000 and got[3].base_failed and not got[1].n_dup_lines
    assert got[1].n_repeat_words > 300_000  # the words repeat with a period
    assert {r.doc_id: r["size"] for r in mixing.mixing_plan(long_docs).select("doc_id", "size").collect()}[1] == got[1].n_words


def test_classes_and_leaks(spark, long_docs):
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(long_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    found = {r.doc_id: [(x.start, x.end, x.edits) for x in r.leaks] for r in decontaminate.marked(long_docs, items).collect()}
    at = lambda i: (texts[i].index(ITEM), texts[i].index(ITEM) + len(ITEM), 0)
    assert found == {1: [at(1)], 2: [at(2)], 3: [], 4: []}


def test_secrets_and_licences(long_docs):
    rows = {r.doc_id: r for r in secret_scan.secret_spans(long_docs).collect()}
    text = rows[1].text
    assert [(s.start, s.end) for s in rows[1].base] == [(text.index(SECRET), len(text))] and not rows[4]["all"]
    assert secret_scan.redact(long_docs).where("doc_id = 1").first().text.endswith(secret_scan.MASK)
    assert sorted((r.doc_id, r.license) for r in license_scan.license_matches(long_docs).collect()) == [(1, "MIT"), (2, "MIT")]


def test_models_and_tokens(long_docs):
    scores = {r.doc_id: r for r in lm_score.lm_scores(long_docs, F.lit(False), block_bytes=1 << 20).collect()}
    assert scores[1].n_tokens == 400_000 + 5 + 15 + 3 + 1 and scores[3].n_tokens == 2 and all(r.score < 0 for r in scores.values())
    sample = quality_classifier.labelled_sample(long_docs, long_docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"), F.lit(False))
    weights = quality_classifier.fit(sample, epochs=1)
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(long_docs, weights, F.lit(False)).collect())
    lengths = sorted(r.length for r in token_counts.lengths(long_docs).collect())
    assert lengths[0] < 10 and lengths[-1] > 400_000 and lengths[1] > 2_000_000 / 16


def test_archives(spark, long_docs):
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    got = warc.read_archives(warc.write_archives(pages, shared_path(spark, "warc"))).collect()
    assert len(got) == 4 and not any(r.problem for r in got) and max(r.payload_bytes for r in got) > 2_000_000
