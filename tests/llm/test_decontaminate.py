import random

import pyarrow as pa
import pytest

from newsloom.llm import decontaminate as D

from .conftest import SF


def fold(text):
    return bytes(D.fold(text))


def least_edits(item, text):
    """Edit distance of the item to the nearest piece of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(random, text, edits):
    s = list(text)
    for _ in range(edits):
        at, kind = random.randrange(len(s)), random.randrange(3)
        if kind == 0:
            s[at] = random.choice("xyz")
        elif kind == 1:
            s.insert(at, random.choice("xyz"))
        else:
            del s[at]
    return "".join(s)


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()][:8]


def test_against_full_tables(items, documents):
    random_ = random.Random(11)
    index, hosts = D.Index(items), [r.text[:400] for r in documents.limit(24).collect()]
    texts = []
    for i, host in enumerate(hosts):
        item = items[i % len(items)][1]
        k = int(index.edits[i % len(items)])
        cut = random_.randrange(len(host))
        texts.append(host[:cut] + " " + edited(random_, item, random_.choice([0, 1, k // 2, k, k + 1, 2 * k, 4 * k])) + " " + host[cut:])
    found = D.find_leaks(pa.array(texts), index)
    for text, leaks in zip(texts, found, strict=True):
        near = {item_id: least_edits(fold(t), fold(text)) for item_id, t in items}
        got = {leak["item_id"]: leak for leak in leaks}
        assert set(got) == {i for (i, _), k in zip(items, index.edits, strict=True) if near[i] <= k}
        for i, leak in got.items():
            assert leak["edits"] == near[i]
            piece = text[leak["start"] : leak["end"]]
            assert least_edits(fold(dict(items)[i]), fold(piece)) == near[i] and abs(len(fold(piece)) - len(fold(dict(items)[i]))) <= near[i]


def test_table_against_exact_search(spark, documents):
    items = [(r.item_id, fold(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {(r.doc_id, i) for r in documents.collect() for i, t in items if t in fold(r.text)}
    seen = []
    for block, group in ((D.BLOCK_BYTES, D.GROUP_BYTES), (2000, 50_000)):
        rows = D.marked(documents, spark.read.parquet(f"{SF}/benchmark.parquet"), block, group).collect()
        seen.append({(r.doc_id, leak.item_id, leak.start, leak.end, leak.edits) for r in rows for leak in r.leaks})
        assert exact and exact <= {x[:2] for x in seen[-1]}
    assert seen[0] == seen[1]


def test_common_qgrams_lose_nothing(monkeypatch):
    """With hardly any q-gram left and runs of few hits the matches are the same."""
    random_ = random.Random(3)
    shared = " ".join(random_.choice(("alpha", "beta", "gamma")) for _ in range(20))
    items = [(i, f"{shared} item {i} {shared}") for i in range(12)] + [(99, "aaaaaaaaaaaaaaaaaaaaaaaa")]
    texts = [f"before {edited(random_, t, 4)} after" for _, t in items] * 2 + ["aaaaaaaaaaaaaaaaaaaaaaaa" * 3, "", shared]
    want = D.find_leaks(pa.array(texts), D.Index(items))
    assert all(any(x["item_id"] == i for x in leaks) for (i, _), leaks in zip(items[:12], want))  # 4 edits are too many for the last
    for common, hits in ((0, 1 << 22), (5, 7), (1 << 40, 1)):
        monkeypatch.setattr(D, "COMMON", common)
        monkeypatch.setattr(D, "HITS", hits)
        assert D.find_leaks(pa.array(texts), D.Index(items)) == want


def test_short_items_and_repeats():
    found = D.find_leaks(pa.array(["cat cat dog cat", "a whole sentence here, a whole sentence here"]), D.Index([(1, "cat"), (2, "a whole sentence here")]))
    assert [(x["start"], x["end"]) for x in found[0]] == [(0, 3), (4, 7), (12, 15)]
    assert [(x["start"], x["end"]) for x in found[1]] == [(0, 21), (23, 44)]


def test_held_out_recall(items, documents):
    """Items planted with edits within the budget are all found, and texts without them stay clean."""
    random_ = random.Random(17)
    index = D.Index(items)
    hosts = [r.text[:300] for r in documents.limit(60).collect()]
    clean = D.find_leaks(pa.array(hosts), index)
    planted = []
    for i, host in enumerate(hosts):
        n = i % len(items)
        planted.append(host + " " + edited(random_, items[n][1], random_.randrange(int(index.edits[n]) + 1)) + " " + host)
    found = D.find_leaks(pa.array(planted), index)
    assert all(any(x["item_id"] == items[i % len(items)][0] for x in leaks) for i, leaks in enumerate(found))
    assert sum(len(x) for x in clean) <= 2


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(None, "a b c d e f g"), (2, None), (3, ""), (4, "É😀"), (5, "é😀"), (5, "é😀"), (6, "A  b\tc D E F G"), (7, "lorem ipsum dolor sit amet lorem ipsum dolor")], "item_id long, text string")
    got = {(str(r.doc_id), r.text and r.text[:3]): [x.item_id for x in r.leaks] for r in D.marked(edge_docs.withColumnRenamed("size", "leaks"), bench).collect()}
    assert got["1", "a b"] == [None, 6] or got["1", "a b"] == [None]
    assert got["7", "é😀 "] == [5, 5] and got["None", None] == [] and got["3", ""] == []
    assert 7 in got["5", "lor"]
    assert D.marked(no_docs, bench).count() == 0 and D.clean(edge_docs, bench.limit(0)).count() == 10
    assert D.clean(edge_docs, bench).columns == edge_docs.columns
