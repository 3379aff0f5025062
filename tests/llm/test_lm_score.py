import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import lm_score as L

from .conftest import words

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, held, strengths=L.STRENGTHS):
    toks = [[w.translate(LOWER) for w in words(t)] + [None] for _, t in rows]
    c, b, d = collections.Counter(), collections.Counter(), collections.Counter()
    texts = 0
    for tokens, out in zip(toks, held, strict=True):
        if not out:
            texts += 1
            c.update(tokens)
            b.update(zip(["<s>", *tokens], tokens))
            d.update(zip(["<s>", *tokens], tokens, tokens[1:]))
    n, v = sum(c.values()), len(c)
    result = []
    for tokens, out in zip(toks, held, strict=True):
        base = score = 0
        low, high = strengths
        for i, w in enumerate(tokens):
            p = (c[w] + 1) / (n + v + 1)
            base += math.log10(p)
            h = tokens[i - 1] if i else "<s>"
            p = (b[h, w] + low * p) / ((c[h] if i else texts) + low)
            if i:
                g = tokens[i - 2] if i > 1 else "<s>"
                p = (d[g, h, w] + high * p) / (b[g, h] + high)
            score += math.log10(p)
        result.append((out, len(tokens), sum(c[w] > 0 for w in tokens), n, base, score))
    return result


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("block", "fan"), [(1 << 20, L.FAN), (20_000, L.FAN), (20_000, 4), (20_000, 2)])
def test_against_brute_force(documents, block, fan):
    """With few blocks and many, whose lists meet at once and by up to five levels."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = L.lm_scores(documents, L.held_out_by(F.col("doc_id")), block_bytes=block, range_bytes=block, fan=fan).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    close([tuple(r) for r in got], [(i, *x) for (i, _), x in zip(rows, brute(rows, held), strict=True)])


def test_probabilities_add_up(spark):
    """After every state the probabilities of all that may follow, an unknown word among it, add up to one."""
    learned = ["a b a", "b c a b", "a b c", "b"]
    words_of = ["a", "b", "c", "zzz"]
    prefixes = ["", "a", "a b", "b c", "c c", "zzz", "a zzz", "b c a b"]
    rows = [(i, t) for i, t in enumerate(learned)]
    rows += [(100 * (i + 1) + j, f"{p} {w}".strip()) for i, p in enumerate(prefixes) for j, w in enumerate(["", *words_of])]
    # the probability of going on with a word: that of the text without its end, which is asked for with what may follow it
    got = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    held = [True] * len(rows)
    held[: len(learned)] = [False] * len(learned)
    want = [x[5] for x in brute(rows, held)]
    assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-9)


def test_normalised():
    """The automaton's weights after a state add up to one over the words of the root and one unknown."""
    words_, grams = np.array([5, 3, 2, 4, 0]), np.array([2, 1, 0, 1, 0, 3, 1, 0, 1])  # counts of words, the last unknown, and of grams
    size = {"texts": 4, "tokens": 14, "types": 4}
    model = L.Automaton(words_, grams, size, (7.0, 3.0))
    assert (10.0 ** model.root).sum() == pytest.approx(1)
    # state: the pair in place 0 (count 2) of the word in place 0 (count 5); bigrams 1..4 and triples 5..8 would be its arcs
    model.grams = np.array([2, 1, 2, 1, 1, 0, 1, 0, 1, 0, 0])
    total = 0
    for w in range(5):
        _, weight = model.read(np.array([0, 0, w]), np.array([0, 0, 1 + w]), np.array([0, 0, 6 + w]), np.array([0]))
        total += 10 ** weight[2]
    assert total == pytest.approx(1)


def test_lists_come_back_as_they_were():
    random = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 100, 1001):
        for top in (16, 1 << 20, 1 << 50, (1 << 63) - 1):
            keys = np.unique(random.integers(0, top, n, dtype=np.uint64))
            counts = random.integers(0, 1 << 40, len(keys))
            a, b = L.unpack(*L.pack(keys, counts))
            assert (a == keys).all() and (b == counts).all()
    far = np.array([5, (1 << 64) - 1], np.uint64)
    assert (L.unpack(*L.pack(far, np.zeros(2, int)))[0] == far).all()


def test_words_are_counted_in_parts(documents, monkeypatch):
    docs = documents.select("text", F.lit(True).alias("train"))
    want = L.corpus_size(docs, 3)
    assert want["texts"] == 200 and want["tokens"] == sum(len(words(r.text)) + 1 for r in documents.collect())
    monkeypatch.setattr(L, "WORDS", 500)
    monkeypatch.setattr(L.T.batches_of, "__defaults__", (16, 4 << 20, "text"))
    assert L.corpus_size(docs, 3) == want


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(1, "same words " * 50)] * 400, "doc_id long, text string").repartition(4)
    got = L.lm_scores(docs, F.lit(False), block_bytes=20_000).groupBy("score", "n_known").count().collect()
    assert len(got) == 1 and got[0]["count"] == 400


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    got = L.lm_scores(edge_docs, L.held_out_by(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    fix = lambda x: (-1 if x[0] is None else x[0], *x[1:])
    close([fix(tuple(r)) for r in got], [fix((i, *x)) for (i, _), x in zip(rows, brute(rows, held), strict=True)])
    assert L.lm_scores(no_docs, F.lit(False)).count() == 0
