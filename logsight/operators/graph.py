"""Entity graph: edges, neighbourhoods, ranks, communities.

Iterations keep vertices and edges in DataFrames and write each few rounds to
the checkpoint folder, so lineage stays short; only counts come to the driver.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logsight.functions.identity import RELATIONS
from logsight.operators.lineage import settled

def infer_edges(events: DataFrame, typed: str = "typed") -> DataFrame:
    """Edges of all pairs of an event's typed entities (kind, uuid); processes link in order (H1)."""
    each = events.select("timestamp_ns", F.posexplode(typed).alias("i", "a"), F.col(typed).alias("all"))
    pairs = each.select("timestamp_ns", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    source, target, relation = None, None, None
    kinds = lambda x, y: (F.col("a.kind") == x) & (F.col("b.kind") == y)
    for (x, y), name in [*RELATIONS.items(), (("process", "process"), "spawned_by")]:
        for left, right, cond in (("a", "b", kinds(x, y)), ("b", "a", kinds(y, x))):
            if x == y and left == "b":
                continue
            put = lambda old, new, c=cond: F.when(c, new) if old is None else old.when(c, new)
            source, target, relation = put(source, F.col(f"{left}.uuid")), put(target, F.col(f"{right}.uuid")), put(relation, F.lit(name))
    return pairs.select(source.alias("source_id"), target.alias("target_id"), relation.alias("rel_type"), "timestamp_ns").where("rel_type IS NOT NULL")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbours both ways."""
    out = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    return out.union(edges.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))).distinct()


def neighbours(edges: DataFrame, start: str, depth: int, relations: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth) within `depth` steps of start, start left out (H2)."""
    links = undirected(edges.where(F.col("rel_type").isin(*relations)) if relations else edges)
    seen = links.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(links, front["node"] == links["u"]).select(F.col("v").alias("node")).distinct()
        front = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start: str, end: str) -> list[str]:
    """Nodes from start to end, undirected; ties go to the smallest node; empty without a path (H3)."""
    if start == end:
        return [start]
    links = settled(undirected(edges))
    levels = [links.sparkSession.createDataFrame([(start, None)], "node string, parent string")]
    while True:  # ends with the path, or when no new node is reached
        step = levels[-1].join(links, F.col("node") == F.col("u")).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        # a neighbour is one step nearer, as near, or one step farther
        for near in levels[-2:]:
            step = step.join(near.select("node"), "node", "left_anti")
        levels.append(settled(step))
        if levels[-1].isEmpty():
            return []
        if not levels[-1].where(F.col("node") == end).isEmpty():
            path = [end]
            for level in levels[:0:-1]:  # one row a step back
                path.insert(0, level.where(F.col("node") == path[0]).first()["parent"])
            return path


def ego(edges: DataFrame, centre: str, depth: int) -> DataFrame:
    """Edges among the nodes within `depth` of the centre (H4)."""
    nodes = neighbours(edges, centre, depth).select("node").union(edges.sparkSession.createDataFrame([(centre,)], "node string"))
    return edges.join(nodes.withColumnRenamed("node", "source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("node", "target_id"), "target_id", "left_semi")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("node")).union(edges.select(F.col("target_id").alias("node"))).distinct()


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, settle: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """Directed ranks with each parallel edge counted, by power iteration; dangling mass is spread evenly (H5).

    Ends when all ranks together change by less than `tolerance` in `settle`
    rounds, which write the ranks and compare, or after `rounds`.
    """
    nodes = settled(vertices(edges))
    n = nodes.count()
    out = edges.groupBy(F.col("source_id").alias("node")).agg(F.count("*").alias("out"))
    links = settled(edges.groupBy(F.col("source_id").alias("node"), "target_id").agg(F.count("*").alias("w")).join(out, "node"))
    ends = nodes.join(out, "node", "left_anti")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    done = None
    for i in range(rounds):
        lost = ranks.join(ends, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = links.join(ranks, "node").groupBy(F.col("target_id").alias("node")).agg(F.sum(F.col("rank") * F.col("w") / F.col("out")).alias("got"))
        ranks = nodes.join(got, "node", "left").join(F.broadcast(lost)).select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if (i + 1) % settle == 0:
            before, ranks = done, settled(ranks)
            done = ranks
            if before is not None and before.withColumnRenamed("rank", "old").join(ranks, "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                break
    return ranks


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by label propagation: each node takes its neighbours' commonest label, ties to the smallest (H6)."""
    links = settled(undirected(edges).where("u <> v"))
    labels = vertices(edges).select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = links.join(labels, links["v"] == labels["node"]).groupBy("u", "community").agg(F.count("*").alias("n"))
        # the own label counts once, which keeps pairs from swapping labels for ever
        votes = votes.union(labels.select(F.col("node").alias("u"), "community", F.lit(1).cast("long").alias("n"))).groupBy("u", "community").agg(F.sum("n").alias("n"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        new = settled(best.select("node", F.col("b.community").alias("community")))
        moved = new.join(labels.withColumnRenamed("community", "old"), "node").where("community <> old")
        labels = new
        if moved.isEmpty():
            break
    return labels


def _moved(links: DataFrame, labels: DataFrame, number: int, whole: float, tolerance: float = 1e-12) -> DataFrame:
    """One round of moves of half of the nodes, chosen by a hash.

    labels: (node, community, k, own), with the node's degree and what it has with
    itself. Adds `next`, its community after the round, and of the communities
    before it `inside`, the node's links that stay in its community, and `met`, its
    degree times its community's.

    A node goes where the links into a community, less what its degree would meet
    there by chance, gain most over staying; ties go to the smallest community. Of
    two lone nodes that want each other, the larger one moves.
    """
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    placed = labels.join(totals, "community")
    near = links.where("u <> v").join(placed.select(F.col("node").alias("v"), "community", "total", "members"), "v")
    # dealt by node once: what follows is done where the node's links are
    into = near.select("u", "community", "total", "members", "w").repartition("u").groupBy("u", "community").agg(F.sum("w").alias("into"), F.max("total").alias("total"), F.max("members").alias("members"))
    home = placed.select(F.col("node").alias("u"), F.col("community").alias("home"), "k", "own", F.col("total").alias("home_total"), F.col("members").alias("home_members"))
    at_home = F.col("community") == F.col("home")
    gain = lambda into, total: F.round(into - F.col("k") * total / F.lit(whole), 9)
    # a lone node doesn't follow a lone node of a larger community
    allowed = ~at_home & ~((F.col("members") == 1) & (F.col("home_members") == 1) & (F.col("community") > F.col("home")))
    offer = F.struct((-gain(F.col("into"), F.col("total"))).alias("minus"), "community")
    best = home.join(into, "u", "left").groupBy(*home.columns).agg(F.min(F.when(allowed, offer)).alias("best"), F.coalesce(F.max(F.when(at_home, F.col("into"))), F.lit(0.0)).alias("stays"))
    turn = F.pmod(F.xxhash64("u", F.lit(number)), F.lit(2)) == 0
    goes = turn & (-F.col("best.minus") > gain(F.col("stays"), F.col("home_total") - F.col("k")) + tolerance)
    return best.select(
        F.col("u").alias("node"), F.col("home").alias("community"), "k", "own", F.when(goes, F.col("best.community")).otherwise(F.col("home")).alias("next"),
        (F.col("stays") + F.col("own")).alias("inside"), (F.col("k") * F.col("home_total")).alias("met"),
    )


def _summed(df: DataFrame, label: str, *names: str) -> tuple[DataFrame, list[float]]:
    """The rows settled, and the sums of columns, taken while the rows are written."""
    seen = Observation()
    rows = settled(df.observe(seen, *(F.sum(n).alias(n) for n in names)), label)
    got = seen.get
    return rows, [got[n] or 0.0 for n in names]


def communities_by_modularity(edges: DataFrame, rounds: int = 24, patience: int = 4, least: float = 1e-4) -> DataFrame:
    """Communities by modularity (H6): local moves with a gain test, then communities become nodes, level by level.

    edges: source_id, target_id and, if there is one, weight; directions are left
    out and weights of a pair add up. A round moves half of the nodes at once and
    its labels count only if the modularity grows; after `patience` rounds without
    growth, or `rounds`, the communities are folded into nodes whose links carry
    the sums, until a level brings less than `least`. Each round is one written
    table, which also tells the modularity that the round before has reached; only
    these sums come to the driver. A community is named by its smallest node.
    """
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    pairs = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    once = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), (2 * F.col("w")).alias("w"))))
    links = settled(pairs.select(F.inline(once.otherwise(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "w"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "w"))))), "links")
    found = settled(vertices(edges).select("node", F.col("node").alias("community")), "communities")
    reached, number = None, 0
    while True:
        own = F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0))
        labels, (whole,) = _summed(links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), own.alias("own")).withColumn("community", F.col("node")), "level", "k")
        start = best = kept = None
        idle = 0
        for i in range(rounds + 1):
            step, (inside, met) = _summed(_moved(links, labels, number + 1, whole or 1.0), "moves", "inside", "met")
            now = inside / whole - met / (whole * whole) if whole else 0.0
            if kept is None:
                start, kept, best = now, labels, now
            else:
                kept, best, idle = (labels, now, 0) if now > best + 1e-9 else (kept, best, idle + 1)
            if i == rounds or idle >= patience:
                break
            number += 1
            labels = step.select("node", F.col("next").alias("community"), "k", "own")
        reached = start if reached is None else reached
        if best - start < least and best <= reached + least:
            break
        reached = best
        names = kept.groupBy("community").agg(F.min("node").alias("name"))
        kept = settled(kept.join(names, "community").select("node", F.col("name").alias("community")), "level")
        found = settled(found.withColumnRenamed("community", "part").join(kept.select(F.col("node").alias("part"), "community"), "part", "left").select("node", F.coalesce("community", "part").alias("community")), "communities")
        a, b = (kept.select(F.col("node").alias(c), F.col("community").alias(f"_{c}")) for c in ("u", "v"))
        links = settled(links.join(a, "u").join(b, "v").groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.sum("w").alias("w")), "links")
    names = found.groupBy("community").agg(F.min("node").alias("name"))
    return found.join(names, "community").select("node", F.col("name").alias("community"))


def _degree(edges: DataFrame, own: str, other: str, name: str) -> DataFrame:
    counted = edges.groupBy(F.col(own).alias("node")).agg(F.countDistinct(other).alias(name))
    return vertices(edges).join(counted, "node", "left").select("node", F.coalesce(name, F.lit(0)).alias(name))


def fan_out(edges: DataFrame) -> DataFrame:
    """Distinct targets of each vertex (H7)."""
    return _degree(edges, "source_id", "target_id", "fan_out")


def fan_in(edges: DataFrame) -> DataFrame:
    """Distinct sources of each vertex (H8)."""
    return _degree(edges, "target_id", "source_id", "fan_in")


def ego_size(edges: DataFrame) -> DataFrame:
    """Distinct neighbours either way."""
    return undirected(edges).where("u <> v").groupBy(F.col("u").alias("node")).agg(F.count("*").alias("neighbours"))


def twins(links: DataFrame) -> DataFrame:
    """(node, twin): the smallest node with exactly the same neighbours, itself if there is no other.

    A hash of the neighbours only proposes; a node stays with its twin if every
    link of the one is a link of the other.
    """
    signs = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("sign"))
    named = signs.join(signs.groupBy("n", "sign").agg(F.min("node").alias("twin")), ["n", "sign"]).select("node", "n", "twin")
    asked = links.join(named.where("node <> twin"), F.col("u") == F.col("node")).select("node", "n", "twin", "v")
    shared = asked.join(links.select(F.col("u").alias("twin"), "v"), ["twin", "v"]).groupBy("node", "n").agg(F.count("*").alias("shared"))
    sure = shared.where("shared = n").select("node", F.lit(True).alias("sure"))
    return named.join(sure, "node", "left").select("node", F.when(F.col("sure"), F.col("twin")).otherwise(F.col("node")).alias("twin"))


def betweenness(edges: DataFrame, pivots: int | None = None, block: int = 4096) -> DataFrame:
    """Betweenness, undirected and normalised, by sums over sources; `pivots` sources by a hash, if asked (H9).

    Nodes with the same neighbours are searched from, and met, as one: each
    search then counts paths and shares by how many there are, which changes no
    result. Sources are taken in blocks. Rows are (source, node) of such classes:
    a round of joins finds the next depth of all searches of a block with the
    number of shortest paths, and as many rounds back give each node its share.
    Nothing but counts comes to the driver.
    """
    links = settled(undirected(edges).where("u <> v"))
    nodes = settled(vertices(edges))
    n = nodes.count()
    taken = min(n, pivots or n)
    chosen = settled(nodes.orderBy(F.xxhash64("node"), "node").limit(taken)) if taken < n else nodes
    named = settled(twins(links), "twins")
    per = named.join(chosen.withColumn("asked", F.lit(1)), "node", "left").groupBy("twin").agg(F.count("*").alias("size"), F.sum(F.coalesce("asked", F.lit(0))).alias("times"))
    degrees = links.groupBy(F.col("u").alias("twin")).agg(F.count("*").alias("degree"))
    classes = settled(per.join(degrees, "twin"), "twins")
    ends = classes.select("twin", "size")
    between = links.join(ends, F.col("u") == F.col("twin")).select("u", "v", "size").join(ends.select("twin"), F.col("v") == F.col("twin"), "left_semi")
    between = settled(between, "links")
    # the others of a source's class are two steps away, by way of each neighbour, and nothing lies behind them
    sources = classes.where("times > 0").select(F.col("twin").alias("node"), "times", ((F.col("size") - 1) / F.col("degree")).alias("others"))
    blocks = max(1, -(-sources.count() // block))
    parts = [_dependencies(between, sources.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i)) for i in range(blocks)]
    summed = functools.reduce(DataFrame.union, parts).groupBy(F.col("node").alias("twin")).agg(F.sum("part").alias("part"))
    scale = 0.0 if n < 3 else 1.0 / ((n - 1) * (n - 2)) * (n / max(1, taken))
    each = named.join(summed, "twin").select("node", "part")
    return nodes.join(each, "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, part): the share of one node of each class in the shortest paths from the sources.

    links: (u, v, size), size nodes like u. sources: (node, times, others), the
    number of sources of the class, and what its other nodes add to a neighbour.
    """
    own = sources.select(F.col("node").alias("source"), "times", "others")
    levels = [settled(sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    while True:
        many = F.col("size") if len(levels) > 1 else F.lit(1)
        step = levels[-1].join(links, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum(F.col("paths") * many).alias("paths"))
        # a neighbour is one step nearer, as near, or one step farther
        for near in levels[-2:]:
            step = step.join(near.select("source", "node"), ["source", "node"], "left_anti")
        step = settled(step)
        if step.isEmpty():
            break
        levels.append(step)
    out, credit = [], levels[-1].withColumn("credit", F.lit(0.0))
    for depth in range(len(levels) - 1, 0, -1):
        credit = credit.join(own, "source").withColumn("credit", F.col("credit") + (F.col("others") if depth == 1 else F.lit(0.0)))
        out.append(credit.groupBy("node").agg(F.sum(F.col("credit") * F.col("times")).alias("part")))
        if depth == 1:  # nobody asks for the sources' own share
            break
        back = credit.join(links, F.col("node") == F.col("u")).select("source", F.col("v").alias("node"), (F.col("size") * (1 + F.col("credit")) / F.col("paths")).alias("each"))
        got = back.join(levels[depth - 1], ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("each") * F.col("paths")).alias("credit"))
        credit = settled(levels[depth - 1].join(got, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("credit", F.lit(0.0)).alias("credit")))
    return functools.reduce(DataFrame.union, out) if out else sources.select("node", F.lit(0.0).alias("part"))


def crossings(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends lie in different communities."""
    a = labels.select(F.col("node").alias("source_id"), F.col("community").alias("source_community"))
    b = labels.select(F.col("node").alias("target_id"), F.col("community").alias("target_community"))
    return edges.join(a, "source_id").join(b, "target_id").where("source_community <> target_community").withColumn("risk_score", F.lit(0.6))


def central(scores: DataFrame, limit: float = 0.3) -> DataFrame:
    """Vertices of high betweenness."""
    return scores.where(F.col("betweenness") > limit).withColumn("risk_score", F.least(F.lit(1.0), 1.5 * F.col("betweenness")))


def fan_out_alerts(baseline: DataFrame) -> DataFrame:
    """Snapshots above their vertex's baseline."""
    return baseline.where("anomaly").withColumn("risk_score", F.least(F.lit(1.0), F.col("fan_out") / F.col("threshold")))


def reconciled(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Counts of edges and vertices of an edge table and its copy."""
    count = lambda df, s: df.agg(F.count("*").alias(f"{s}_edges")).join(vertices(df).agg(F.count("*").alias(f"{s}_vertices")))
    return count(source, "source").join(count(copy, "copy")).withColumn("equal", (F.col("source_edges") == F.col("copy_edges")) & (F.col("source_vertices") == F.col("copy_vertices")))
