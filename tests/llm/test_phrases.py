import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import phrases as P
from newsloom.llm import tries

from .conftest import SF


def plain(rows, least, share=80, top=2000):
    """Everything by counting in plain Python. rows: lang, text."""
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if len(k) > 2 and c >= least}
    longer = {}
    for (lang, *w), c in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, *w[i : i + m])
                longer[key] = max(longer.get(key, 0), c)
    out = collections.defaultdict(list)
    for (lang, *w), a in often.items():
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * longer.get((lang, *w), 0) < share * a:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_query_against_counting(spark, documents):
    got = P.op13_phrases(spark, SF)
    assert got.columns == COLUMNS and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    want = plain([(r.lang, r.text) for r in documents.collect()], 30)
    assert rows_of(got) == want and len(want) >= 50


@pytest.mark.parametrize(("shard", "block", "keys"), [(1 << 19, 1 << 22, 1 << 21), (40, 7, 50)])
def test_shards_and_blocks(spark, documents, monkeypatch, shard, block, keys):
    """Small words, many shards of tries, blocks of words and keys sent on early give the same."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P.summed, "__defaults__", (keys,))
    rng = np.random.default_rng(5)
    words = ["a", "B", "é😀", "x-y", "de", "LA"]
    texts = ["".join(rng.choice(words) + str(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "])) for _ in range(rng.integers(0, 60))) for _ in range(120)]
    rows = [(str(rng.choice(["en", "fr", "und", ""])) if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(P.collocations(docs, least=4, shard=shard, top=50)) == plain(rows, 4, top=50)
    if shard == 40:
        frequent = P.phrase_counts(docs, 4, shard)[1].where("size > 1")
        assert frequent.count() > 3 * shard


@settings(max_examples=60, deadline=None)
@given(st.sets(st.lists(st.integers(0, 3) | st.sampled_from([255, 256, 70_000, 1 << 30]), min_size=1, max_size=4).map(tuple), max_size=60), st.lists(st.integers(-1, 3) | st.sampled_from([256, 70_000]), max_size=80))
def test_tries(listed, text):
    listed = sorted(listed)
    rows = np.array([[*p, *[-1] * (4 - len(p))] for p in listed], np.int64).reshape(-1, 4)
    trie, order = tries.built(rows)
    trie = tries.Trie.unpacked(trie.packed())
    inner = {p[:k] for p in listed for k in range(1, len(p) + 1)}
    for k, at, state in tries.walked(trie, np.array(text, np.int64)):
        assert at.tolist() == [i for i in range(len(text) - k + 1) if tuple(text[i : i + k]) in inner]
        for i, s in zip(at.tolist(), state.tolist(), strict=True):
            which = trie.accept[s]
            assert (which >= 0) == (tuple(text[i : i + k]) in listed) and (which < 0 or listed[order[which]] == tuple(text[i : i + k]))


def test_many_phrases_fit_a_small_trie():
    rng = np.random.default_rng(2)
    rows = np.unique(rng.zipf(1.3, (40_000, 4)).clip(0, 50_000), axis=0)
    trie, order = tries.built(rows)
    *_, (k, at, state) = tries.walked(trie, np.concatenate([rows[order], np.full((len(rows), 1), -1)], axis=1).ravel())
    found = dict(zip(at.tolist(), trie.accept[state].tolist(), strict=True))
    assert all(found[5 * i] == i for i in range(len(rows))) and len(trie.base) < 3 * (trie.check >= 0).sum() + 5000


def test_exact_where_products_pass_64_bits(spark):
    big = 10**13
    rows = [("x", "a", 1, 3 * big), ("x", "b", 1, 3 * big + 1), ("x", "c", 1, big), ("x", "a b", 2, 2 * big), ("x", "b c", 2, big), ("x", "a b c", 3, big)]
    frequent = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in P.scored(frequent).collect()}
    floor = lambda a, x, y: 2000000 * a // (x + y)
    assert got == {"a b": (2 * big, 3 * big, 3 * big + 1, floor(2 * big, 3 * big, 3 * big + 1)), "a b c": (big, 3 * big, big, floor(big, 3 * big, big))}


def test_edges(spark, edge_docs, no_docs):
    with_lang = lambda d: d.withColumns({"lang": F.lit(None).cast("string"), "f": F.lit("x"), "word": F.lit(1), "ids": F.lit(2)})
    rows = [(None, r.text) for r in edge_docs.collect()]
    assert rows_of(P.collocations(with_lang(edge_docs))) == plain(rows, 30) != []
    assert P.collocations(with_lang(no_docs)).count() == 0 and P.collocations(with_lang(edge_docs).where("doc_id = 3")).count() == 0


def test_long_texts(spark):
    text = " ".join(f"w{i * i % 997}" for i in range(300_000)) + ". " + "x" * 2_000_000
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    assert rows_of(P.collocations(docs)) == plain([("en", text)], 30)


def test_windows_of_many_shards(spark, monkeypatch):
    """A shard has all windows of its pairs of words, however few fit it; each goes to one shard only."""
    monkeypatch.setattr(P, "WINDOWS", 100)
    rng = np.random.default_rng(8)
    rows = [(str(rng.choice(["en", "fr"])), " ".join(rng.choice(["a", "b", "c", "d.", "e"], rng.integers(0, 80)))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(P.collocations(docs, least=4, shard=50, top=400)) == plain(rows, 4, top=400)
    ids = np.array([5, 7, 5, 7, -1, 5, 7, 1, 2, -1], np.int32)
    pairs, rest, counts = next(P.summed([P.windows_of(ids), P.windows_of(ids)]))
    assert counts.sum() == 12 and sorted(counts.tolist()) == [2, 2, 2, 2, 2, 2] and len(set(zip(pairs.tolist(), rest.tolist(), strict=True))) == 6
    listed, stay = P.candidates(pairs, rest, counts, 4)
    assert sorted(map(tuple, listed.tolist())) == [(5, 7, -1, -1)] and stay.sum() == 3


def test_numbered_texts_stay_in_their_task(spark, monkeypatch):
    """Texts become windows where they are read, some bytes at a time: no numbered text is written and read again as one large cell."""
    kinds, stored = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, kind: kinds.append(kind) or stored(df, kind))
    monkeypatch.setattr(P, "TEXTS", 40)
    rows = [("en" if i % 3 else "fr", "A b, c d e " * (i % 5) + "a b") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert rows_of(P.collocations(docs, least=4)) == plain(rows, 4) != []
    assert kinds == ["words", "vocabulary", "counted", "frequent"]
