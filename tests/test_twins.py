"""Betweenness on graphs in which many nodes have the same neighbours."""

import numpy as np
import pytest

from logsight.operators import graph
from tests.test_values import brute_betweenness

SCHEMA = "source_id string, target_id string"


def crowded():
    rng = np.random.default_rng(3)
    links = [(f"h{a}", f"h{b}") for a, b in rng.integers(0, 9, (12, 2))]
    links += [(f"u{i}", f"h{(i + k) % 5}") for i in range(120) for k in range(1 + i % 2)]  # leaves, and pairs of hubs
    links += [(f"l{i}", f"r{k}") for i in range(4) for k in range(3)]  # all to all, apart from the rest
    return [*links, ("x", "y"), ("z", "z"), ("h1", "z"), ("w", "w")]


def test_equal_nodes_are_searched_once(spark, monkeypatch):
    links = crowded()
    rows = []

    def counted(df, *more):
        out = settled(df, *more)
        rows.append(out.count())
        return out

    settled = graph.settled
    monkeypatch.setattr(graph, "settled", counted)
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(links, SCHEMA)).collect()}
    assert got == pytest.approx(brute_betweenness(links))
    assert max(rows) < 1000  # 140 nodes: searches from each to each have thousands of rows a depth


def test_pivots_among_equal_nodes(spark):
    df = spark.createDataFrame(crowded(), SCHEMA)
    n = graph.vertices(df).count()
    every = {r.node: r.betweenness for r in graph.betweenness(df, pivots=n).collect()}
    some = {r.node: r.betweenness for r in graph.betweenness(df, pivots=n - 30, block=20).collect()}
    assert every == pytest.approx(brute_betweenness(crowded()))
    # pivots don't see what lies between others only, so the sums differ, but by the share of the sources at most
    top = max(every, key=every.get)
    assert some[top] == pytest.approx(every[top], rel=0.5)


def test_a_hash_only_proposes(spark, monkeypatch):
    monkeypatch.setattr(graph.F, "xxhash64", lambda *c: graph.F.lit(1).cast("long"))
    links = crowded()
    both = graph.undirected(spark.createDataFrame(links, SCHEMA)).where("u <> v")
    near = {}
    for u, v in both.collect():
        near.setdefault(u, set()).add(v)
    twin = {r.node: r.twin for r in graph.twins(both).collect()}
    assert twin.keys() == near.keys()
    assert all(near[a] == near[b] for a, b in twin.items())
