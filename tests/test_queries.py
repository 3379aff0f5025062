"""Each registered query with a SQL twin against DuckDB on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from newsloom.plans import registry, views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(entry.oracle_sql()[name]).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = df.select(*columns).collect()
    assert sorted(map(repr, map(rounded, map(tuple, got)))) == sorted(map(repr, map(rounded, want)))


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["link", "title", "published"] and rows.count() > 0


@pytest.mark.parametrize("name", ["balanced_feed", "visible_colours"])
def test_queries_without_a_twin_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_articles_cut_nothing(spark):
    """Title and description are the text."""
    rows = {r.pos: r for r in views.articles(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in views.load(spark, SF, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").collect()}
    assert max(map(len, texts.values())) > 10_000
    assert {k: r.title + ("\n" + r.description if "\n" in texts[k] else "") for k, r in rows.items()} == texts


def test_no_twin_reads_a_subset():
    for name, sql in registry.oracle_sql().items():
        assert not re.search(r"WHERE (pos|\w+key|home|away|doc_id) % \d+ = 0", sql), name


def twin_rows(spark, name, sf):
    """Rows of a query and of its twin over the tables of a folder."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf if (sf / f'{t}.parquet').exists() else SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(sf))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want))


def halves(tmp_path):
    """Orders whose thousands are halves, above even and odd numbers."""
    rows = "SELECT i AS o_orderkey, i AS o_custkey, ['O', 'F', 'P'][i % 3 + 1] AS o_orderstatus, 1000.0::DOUBLE * i + 500 AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range(60) t(i)"
    duckdb.connect().sql(f"COPY ({rows}) TO '{tmp_path}/orders.parquet'")
    return tmp_path


def test_schedule_rounds_halves_as_its_twin(spark, tmp_path):
    got, want = twin_rows(spark, "schedule", halves(tmp_path))
    assert got == want and len(got) == 60


def test_scoreboard_rounds_halves_as_its_twin(spark, tmp_path):
    got, want = twin_rows(spark, "scoreboard", halves(tmp_path))
    assert got == want and len(got) == 60


def test_pair_score_leaves_no_pair_out(spark):
    """Pairs that share three tokens come out however little alike they are."""
    got = entry.queries()["pair_score"](spark, SF)
    assert got.where("dice < 0.55").count() > 0 and got.where("shared < 3").count() == 0
