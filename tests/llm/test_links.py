import os
import random

import pytest

from ledgerlens.llm import components
from ledgerlens.llm.components import Components, link_groups, record_key


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(1)
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    yield [(i, i + 1) for i in range(120)] + [(500, i) for i in range(501, 540)]
    p = list(range(150))
    rng.shuffle(p)
    yield list(zip(p, p[1:])) + [(900, 901), (901, 902), (1000, 1000)]


@pytest.mark.parametrize("n", range(3))
@pytest.mark.parametrize(("bfs_rounds", "hot"), [(16, False), (2, True)])
def test_against_union_find(spark, stage, monkeypatch, n, bfs_rounds, hot):
    if hot:  # every key with more than one row is looked up by broadcast
        monkeypatch.setattr(components, "LEAST", 1)
    pairs = list(graphs())[n]
    df = spark.createDataFrame([(f"k{a:05d}", f" k{b:05d}\t", 0.5) for a, b in pairs], "l string, r string, record_key double")
    got = {r.record_key: r.group_key for r in link_groups(df, "l", "r", stage, bfs_rounds).collect()}
    assert got == {f"k{a:05d}": f"k{b:05d}" for a, b in brute(pairs).items()}


def test_keys(spark):
    h = "AB" * 32
    df = spark.createDataFrame([(f" {h} ",), ("1Abc\t",), ("  ",), (None,)], "k string")
    assert [r[0] for r in df.select(record_key(df.k)).collect()] == [h.lower(), "1Abc", None, None]


def test_nulls_and_empty(spark, stage):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", " "), ("d", "d"), ("e", "f"), ("f", "e"), ("e", "f")], "l string, r string")
    assert {tuple(r) for r in link_groups(df, "l", "r", stage).collect()} == {("d", "d"), ("e", "e"), ("f", "e")}
    assert link_groups(df.where("false"), "l", "r", stage).count() == 0
    assert Components(stage).labels(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_propagation_labels_all_that_is_left(spark, stage):
    """The given pairs: several rounds run until no edge is left, in more than one task."""
    pairs = spark.read.parquet("/root/testdata/sf0.01/match_pairs.parquet")
    keys = pairs.select(*[record_key(pairs[c]).alias(c) for c in ("left_key", "right_key")]).dropna()
    edges = keys.selectExpr("xxhash64(left_key) as u", "xxhash64(right_key) as v")
    c = Components(stage)
    got = {r.v: r.root for r in c.labels(edges).collect()}
    want = brute([(r.u, r.v) for r in edges.collect() if r.u != r.v])
    groups = lambda m: {frozenset(v for v in m if m[v] == root) for root in set(m.values())}
    assert c.rounds >= 2 and groups(got) == groups(want)
