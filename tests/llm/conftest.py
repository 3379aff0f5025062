import re

import pytest

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty texts, ties, repeated rows and a clashing column."""
    long = "lorem ipsum dolor sit amet " * 3000
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (2, "a b c d e f g", "x"), (None, None, None), (None, "a b", None), (3, "", "y"), (4, " \n\t ", "y"), (5, long, "z"), (6, long + "end", "z"), (7, "é😀 ß", None)]
    return spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, size string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
