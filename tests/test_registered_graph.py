"""Rows of the registered graph queries without SQL, against plain Python on the same edges."""

from collections import Counter, defaultdict

import pytest

from logsight.plans.base import graph_edges
from logsight.plans.catalogue import QUERIES
from tests.test_values import brute_betweenness


@pytest.fixture(scope="module")
def edges(spark, sf_dir):
    return [tuple(r) for r in graph_edges(spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def near(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def test_shortest_path(spark, sf_dir, near):
    depth, parent, order = {"u7": 0}, {}, ["u7"]
    for x in order:
        for y in near[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                order.append(y)
    for y, d in depth.items():
        parent[y] = min((x for x in near[y] if depth[x] == d - 1), default=None)
    path = [max(n for n, d in depth.items() if 0 < d <= 3)]
    while path[0] != "u7":
        path.insert(0, parent[path[0]])
    assert [r.node for r in QUERIES["h3_shortest_path"](spark, sf_dir).orderBy("step").collect()] == path


def test_communities(spark, sf_dir, near):
    labels = {n: n for n in near}
    for _ in range(4):
        votes = {n: Counter(labels[m] for m in near[n] if m != n) + Counter([labels[n]]) for n in near}
        labels = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    assert {r.node: r.community for r in QUERIES["h6_communities"](spark, sf_dir).collect()} == labels


def test_central(spark, sf_dir, edges):
    expected = {n: (round(b, 6), round(min(1.0, 1.5 * b), 6)) for n, b in brute_betweenness(edges).items() if b > 0.01}
    found = {r.node: (r.betweenness, r.risk_score) for r in QUERIES["h12_central"](spark, sf_dir).collect()}
    assert expected and found.keys() == expected.keys()
    assert all(found[n] == pytest.approx(expected[n], abs=2e-6) for n in found)
