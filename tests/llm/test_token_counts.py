from pathlib import Path

from newsloom.llm import token_counts as K

from .conftest import SF


def test_against_brute_force(spark, documents):
    encode = K.encoder(Path(K.VOCABULARY).read_bytes()).encode_ordinary
    lengths = sorted(len(encode(r.text)) for r in documents.collect())
    sums = K.suffix_sums(K.histogram(documents)).cache()
    got = {r.length: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.truncated_tokens, r.total_tokens, r.total_docs) == (sum(min(x, n) for x in lengths), sum(lengths), len(lengths))
    limits = (1, 100, 512, 1000, 10**9)
    assert {r.limit: (r.docs_over, r.tokens_kept) for r in K.answers(sums, limits).collect()} == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    assert K.quantiles(sums, (0.25, 0.5, 1.0)) == {q: lengths[int(-(-len(lengths) * q // 1)) - 1] for q in (0.25, 0.5, 1.0)}
    assert K.op6_token_counts(spark, SF).count() == len(got)


def test_special_strings_are_text(spark):
    docs = spark.createDataFrame([("<|endoftext|>",), (" ",), (None,)], "text string")
    assert sorted(r.length for r in K.lengths(docs).collect())[0] == 0 and K.lengths(docs).count() == 3


def test_edges(edge_docs, no_docs):
    sums = K.suffix_sums(K.histogram(edge_docs))
    assert sums.agg({"n_docs": "sum"}).first()[0] == 10
    none = K.suffix_sums(K.histogram(no_docs))
    assert none.count() == 0 and K.quantiles(none, (0.5,)) == {0.5: None}
    assert [tuple(r) for r in K.answers(none, (5,)).collect()] == [(5, 0, 0)]
