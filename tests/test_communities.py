"""Communities by modularity against a plain Louvain and against label propagation."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logsight.operators import graph
from logsight.plans.base import graph_rows


def plain_modularity(edges, label):
    m = sum(w for *_, w in edges)
    total, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        inside += w * (label[a] == label[b])
    return inside / m - sum((t / (2 * m)) ** 2 for t in total.values())


def plain_louvain(edges):
    """Node by node, level by level."""
    label = {x: x for a, b, _ in edges for x in (a, b)}
    level = edges
    while True:
        nodes = sorted({x for a, b, _ in level for x in (a, b)})
        near, k, own = defaultdict(lambda: defaultdict(float)), defaultdict(float), {x: x for x in nodes}
        for a, b, w in level:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        total, two_m, moved = dict(k), sum(k.values()), True
        any_move = False
        while moved:
            moved = False
            for x in nodes:
                total[own[x]] -= k[x]
                into = defaultdict(float)
                into[own[x]] += 0
                for y, w in near[x].items():
                    into[own[y]] += w
                best = max(sorted(into), key=lambda c: into[c] - k[x] * total[c] / two_m)
                if into[best] - k[x] * total[best] / two_m > into[own[x]] - k[x] * total[own[x]] / two_m + 1e-12:
                    own[x], moved, any_move = best, True, True
                total[own[x]] += k[x]
        if not any_move:
            return label
        label = {x: own[c] for x, c in label.items()}
        summed = defaultdict(float)
        for a, b, w in level:
            summed[tuple(sorted((own[a], own[b])))] += w
        level = [(a, b, w) for (a, b), w in summed.items()]


def graphs():
    rng = random.Random(12)
    clubs = [(f"n{c}{i}", f"n{c}{j}", 1.0) for c in range(4) for i in range(7) for j in range(i) if rng.random() < 0.8]
    clubs += [(f"n{c}0", f"n{(c + 1) % 4}1", 1.0) for c in range(4)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 30:02d}", 1.0) for i in range(30)]
    weighed = [(f"w{rng.randrange(40):02d}", f"w{rng.randrange(40):02d}", float(rng.randint(1, 5))) for _ in range(120)]
    return {"clubs": clubs, "ring": ring, "weighed": weighed, "pair": [("a", "b", 1.0)], "self": [("a", "a", 2.0), ("a", "b", 1.0), ("c", "d", 1.0)]}


@pytest.mark.parametrize("name", ["clubs", "ring", "weighed", "self"])
def test_near_a_plain_louvain(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "source_id string, target_id string, weight double").repartition(3)
    found = {r.node: r.community for r in graph.communities_by_modularity(df).collect()}
    assert set(found) == {x for a, b, _ in edges for x in (a, b)}
    assert all(c == min(n for n, d in found.items() if d == c) for c in found.values())
    assert plain_modularity(edges, found) >= plain_modularity(edges, plain_louvain(edges)) - 0.02
    if name == "clubs":
        assert len(set(found.values())) == 4
        assert {r.node: r.community for r in graph.communities_by_modularity(df.repartition(5)).collect()} == found


def test_not_below_label_propagation(spark, sf_dir):
    edges = graph_rows(spark, sf_dir).groupBy("source_id", "target_id").agg(F.count("*").alias("weight"))
    rows = [tuple(r) for r in edges.collect()]
    own = {r.node: r.community for r in graph.communities_by_modularity(edges).collect()}
    spread = {r.node: r.community for r in graph.communities(edges).collect()}
    assert set(own) == set(spread) and plain_modularity(rows, own) >= plain_modularity(rows, spread)
    assert plain_modularity(rows, own) >= plain_modularity(rows, plain_louvain(rows)) - 0.02


def test_a_round_tells_the_modularity_before_it(spark):
    edges = [(a, b, w) for a, b, w in graphs()["weighed"]]
    both = [(a, b, w) for a, b, w in edges if a != b] + [(b, a, w) for a, b, w in edges if a != b] + [(a, b, 2 * w) for a, b, w in edges if a == b]
    links = spark.createDataFrame(both, "u string, v string, w double").groupBy("u", "v").agg(F.sum("w").alias("w"))
    label = {x: f"w{int(x[1:]) % 7:02d}" for a, b, _ in edges for x in (a, b)}
    degrees = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("own"))
    labels = degrees.join(spark.createDataFrame(list(label.items()), "node string, community string"), "node")
    whole = sum(w for *_, w in both)
    rows = graph._moved(links, labels, 1, whole).collect()
    assert sorted(r.node for r in rows) == sorted(label) and all(r.community == label[r.node] for r in rows)
    assert sum(r.inside for r in rows) / whole - sum(r.met for r in rows) / whole**2 == pytest.approx(plain_modularity(edges, label), abs=1e-12)
    assert any(r.next != r.community for r in rows)


def test_a_round_is_one_written_table_and_few_jobs(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "settled", lambda df, label="step", by=None, put=graph.settled: written.append(label) or put(df, label, by))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        graph.communities_by_modularity(spark.createDataFrame(graphs()["clubs"], "source_id string, target_id string, weight double"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs, rounds = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")), written.count("moves")
    assert rounds > 3 and written.count("louvain") == 0 and jobs < 18 * rounds
