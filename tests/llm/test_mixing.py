import hashlib
import math

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing as M

from .conftest import words


def water_fill(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Shares by weight; what is above a cap is dealt to the others again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_against_brute_force(documents):
    rows = documents.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    target = water_fill(sizes)
    got = {r.doc_id: r for r in M.mixing_plan(documents).collect()}
    wanted, spread = sum(target.values()), 0
    for r in rows:
        x, rate = got[r.doc_id], target[r.source] / sizes[r.source]
        assert (x["size"], x.source_size) == (len(words(r.text)), sizes[r.source]) and math.isclose(x.target, target[r.source], rel_tol=1e-12)
        u = int(hashlib.md5(f"{r.doc_id}:17".encode()).hexdigest()[:13], 16) / 2**52
        assert x.copies == int(rate) + (u < rate % 1) <= 2
        spread += x["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    taken = sum(x["size"] * x.copies for x in got.values())
    assert abs(taken - wanted) < 3 * spread**0.5


def test_large_sources_meet_their_targets(spark):
    """Of thousands of documents a source, however uneven, the taken words are within three deviations of the target, and near it."""
    rows = [(i, "w " * (1 + i * i % 97 + 900 * (i % 211 == 0)), f"s{i % 3}") for i in range(9000)]
    plan = M.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source", "target").agg({"*": "count"}).collect():
        mine = [x for x in plan.where(plan.source == r.source).collect()]
        f = r.target / mine[0].source_size % 1
        miss, spread = abs(sum(x["size"] * x.copies for x in mine) - r.target), sum(x["size"] ** 2 for x in mine) ** 0.5 * (f * (1 - f)) ** 0.5
        assert miss <= 3 * spread and miss <= 0.08 * r.target


def test_mix_emits_the_copies(documents):
    plan = M.mixing_plan(documents).collect()
    mixed = M.mix(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, M.mix(documents).collect()))


def test_edges(edge_docs, no_docs):
    plan = M.mixing_plan(edge_docs).collect()
    assert len(plan) == 10 and {r["size"] for r in plan if r.text is None} == {0}
    assert all(r.target == 0 for r in plan if r.source == "y") and all(r.target <= 2 * r.source_size for r in plan)
    assert {r["size"] for r in M.mix(edge_docs).collect()} == {"mine"}
    assert M.mixing_plan(no_docs).count() == 0 and M.mix(no_docs).count() == 0


def test_many_sources_need_no_broadcast(documents, monkeypatch):
    want = sorted((r.doc_id, r.copies) for r in M.mixing_plan(documents).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    assert sorted((r.doc_id, r.copies) for r in M.mixing_plan(documents).collect()) == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_columns_named_like_temporary_ones(documents, monkeypatch, broadcast):
    """Extra columns of any name come through, and change nothing."""
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    names = ["_h", "_rate", "_s", "_k", "_salt", "__h", "_RATE2", "ord", "rate", "weight", "cap", "_row", "_copy"]
    more = documents.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    got = M.mixing_plan(more)
    assert got.columns == more.columns + ["source_size", "target", "size", "copies"]
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, M.mixing_plan(documents).select(*columns).collect()))
    assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in names)
    assert all(r[c] == f"{c}{r.doc_id}" for r in M.mix(more).collect() for c in names)
