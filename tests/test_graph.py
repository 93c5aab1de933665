"""Closures against a plain search."""

import random
import time

import pytest

from lectern.operators import graph as G
from lectern.sources.stores import checkpoint_dir


def plain(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = {}
    for start in up:
        depth, front = 1, up[start]
        while front:
            new = {n for n in front if (start, n) not in out}
            out |= {(start, n): depth for n in new}
            front, depth = {m for n in new for m in up.get(n, ())}, depth + 1
    return out


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpoint_dir(spark)


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(18))] + [(None, 1), (2, None)]
    df = spark.createDataFrame(edges, "child int, parent int")
    want = plain(edges)
    assert {(r.node, r.ancestor): r.depth for r in G.closure(df).collect()} == want
    assert {r.node for r in G.cycles(df).collect()} == {a for a, b in want if a == b}
    seeds = spark.createDataFrame([(0,), (5,)], "node int")
    assert {r.node for r in G.reach(seeds, df.toDF("a", "b")).collect()} == {0, 5} | {b for a, b in want if a in (0, 5)}


def test_long_chain(spark):
    n = 300
    df = spark.range(n).selectExpr("id as child", "id + 1 as parent")
    began = time.time()
    got = G.closure(df)
    assert got.count() == n * (n + 1) // 2 and got.agg({"depth": "max"}).first()[0] == n
    assert time.time() - began < 120
    assert G.closure(df.limit(0)).count() == 0


def test_joins_find_pairs_once(spark, monkeypatch):
    """On a tree the rounds' joins make just the pairs that are not edges, none again."""
    df = spark.range(2, 128).selectExpr("id as child", "id div 2 as parent")
    found, union = [], type(df).unionByName

    def spy(self, other, *a, **k):
        found.append(other.count())
        return union(self, other, *a, **k)

    monkeypatch.setattr(type(df), "unionByName", spy)
    assert sum(found) == 0 and G.closure(df).count() == sum(n.bit_length() - 1 for n in range(2, 128)) == sum(found) + 126


def test_reach_sends_nothing_to_the_driver(spark, monkeypatch):
    df, plans = spark.range(2, 64).selectExpr("id div 2 as a", "id as b"), []
    checkpoint = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a: plans.append(self._jdf.queryExecution().executedPlan().toString()) or checkpoint(self, *a))
    assert G.reach(spark.range(1, 2).toDF("node"), df).count() == 63
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
