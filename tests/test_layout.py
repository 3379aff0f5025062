"""What the layout promises: the rest of the library doesn't need the training-data part."""

import random
import re
from pathlib import Path
from types import SimpleNamespace

import pytest

from newsloom import shared
from newsloom.operators.components import components

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_llm_part():
    own = [p for p in (ROOT / "newsloom").rglob("*.py") if "llm" not in p.parts] + [p for p in (ROOT / "tests").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in own if re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M)]


def test_scratch_removes_what_it_wrote(spark):
    at = lambda path: Path(path.removeprefix("file://"))
    outer = shared.stored(spark.range(3), "outer")
    with shared.scratch(spark):
        shared.stored(spark.range(3), "inner")
        inner = at(shared._written[-1])
        assert inner.exists()
    assert not inner.exists() and outer.count() == 3


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(session(master))
        assert shared.shared_dir(session(master, "hdfs:/there")) == "hdfs:/there"
    assert shared.shared_dir(session("local[*]")).startswith("file://")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    random.seed(3)
    for links in ([], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 90)], [(random.randrange(80), random.randrange(80)) for _ in range(60)]):
        parent = {x: x for pair in links for x in pair}
        for a, b in links:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: find(parent, x) for x in linked}
