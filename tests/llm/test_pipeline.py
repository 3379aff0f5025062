import collections

from pyspark.sql import functions as F

import corpus_pipeline as P
from newsloom import shared
from newsloom.llm import decontaminate, mixing, near_dedup, quality_rules, secret_scan
from newsloom.llm.common import table

from .conftest import SF


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages_step_by_step(spark):
    """run() gives the rows that the operators give one after another, each tested against brute force."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    quality = quality_rules.quality_rules(docs, quality_rules.trusted_of(table(spark, SF, "labels")))
    kept = {r.doc_id for r in quality.where("kept").collect()}
    docs = spark.createDataFrame([r for r in docs.collect() if r.doc_id in kept], docs.schema)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    docs = spark.createDataFrame([r for r in docs.collect() if classes[r.doc_id] == r.doc_id], docs.schema)
    leaky = {r.doc_id for r in decontaminate.marked(docs, table(spark, SF, "benchmark")).where("size(leaks) > 0").collect()}
    docs = spark.createDataFrame([r for r in docs.collect() if r.doc_id not in leaky], docs.schema)
    assert leaky and len(set(classes.values())) < len(classes) and len(kept) < 200
    docs = spark.createDataFrame(secret_scan.redact(docs).collect(), docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mixing_plan(docs).collect()}
    want = collections.Counter({tuple(r): copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})
    got = P.run(spark, SF)
    assert got.columns == columns and rows_of(got) == want


def test_stages_take_empty_tables(spark, no_docs):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as what the operators compute, at any place, come through every stage but the last two's text as they are."""
    docs = table(spark, SF, "documents").limit(60)
    names = ["score", "kept", "n_words", "base_failed", "leaks", "base", "all", "row", "_m", "fresh", "size", "copies", "target", "_row", "_copy", "root", "node", "id", "key"]
    wide = docs.select("doc_id", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names], "text", "lang", "source", "n_chars")
    want = {r.doc_id: r for r in wide.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, wide, SF)
        assert out.schema.simpleString() == wide.schema.simpleString(), name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == want[r.doc_id][n] for n in names), name
            assert name == "secret scan" or r == want[r.doc_id], name


def test_intermediate_tables_are_removed(spark):
    before = len(shared._written)
    P.run(spark, SF)
    assert len(shared._written) == before + len(P.STAGES)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
