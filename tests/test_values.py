"""Queries and operators that SQL doesn't cover, against plain Python on small rows."""

import ipaddress
import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsight.functions import identity, text
from logsight.operators import alerts, correlate, detectors, graph, templates, ueba, windows
from logsight.plans import batch
from logsight.plans.base import lines
from logsight.plans.catalogue import QUERIES

MINUTE = 60_000_000_000


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(12)
    times = np.sort(rng.integers(0, 300 * MINUTE, 600)) + 10**18
    rows = [(i, int(t), f"s{rng.integers(2)}", f"u{rng.integers(3)}", int(rng.integers(5)) if i % 9 else None, float(rng.random()), [f"r{rng.integers(3)}", f"r{rng.integers(3)}"]) for i, t in enumerate(times)]
    rows[100:104] = [(i, rows[100][1], *rows[i][2:]) for i in range(100, 104)]  # one time
    return rows, spark.createDataFrame(rows, "event_id long, timestamp_ns long, source_type string, entity string, template_id int, f1 double, entity_refs array<string>")


def test_bytes_are_cut_before_characters(spark):
    for t, size, chars in (("é漢🙂" * 20, 50, 100), ("é漢🙂" * 20, 1000, 7), ("abc", 2, 5), ("a" + "é" * 40_000, 65_536, 32_768), ("漢" * 30_000, 65_536, 32_768)):
        raw = t.encode()
        got = spark.createDataFrame([(bytearray(raw),)], "b binary").select(text.decode(F.col("b"), size, chars)).first()[0]
        assert got == raw[:size].decode("utf-8", "replace")[:chars]


def test_ipv6_names(spark):
    given = ["::", "::1", "1::", "FE80::1:2", "2001:db8:0:0:1:2:3:4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:10.1.2.3", "1:2:3:4:5:6:7.8.9.1", " ::1 ", "1::2::3", ":::", "1:2:3", "12345::", "::g", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "::01.2.3.4", ":1", "1:", "1::2:3:4:5:6:7:8", "10.0.0.1", "10.0.0.256", "10.00.0.1", ""]
    got = {r.s: r.n for r in spark.createDataFrame([(s,) for s in given], "s string").select("s", identity.canonical("ip", F.col("s")).alias("n")).collect()}
    for s in given:
        try:
            address = ipaddress.ip_address(s.strip())
            wanted = str(address) if address.version == 4 else ":".join(f"{int(address):032x}"[i : i + 4] for i in range(0, 32, 4))
        except ValueError:
            wanted = None
        assert got[s] == wanted, s


def test_entity_refs_are_uuids_of_names(spark, sf_dir):
    m = F.col("message")
    lists = {"ip": text.ips(m), "user": text.users(m), "host": text.hosts(m), "domain": text.domains(m), "file": text.files(m), "process": text.processes(m)}
    for r in lines(spark, sf_dir).withColumn("message", F.concat(m, F.lit(" peer 2001:DB8::"))).limit(200).select(*(v.alias(k) for k, v in lists.items()), identity.entity_refs(*lists.values()).alias("refs")).collect():
        wanted = []
        for kind in lists:
            for v in r[kind]:
                name = ipaddress.ip_address(v).exploded if kind == "ip" else v.lower().rstrip(".") if kind in ("host", "domain") else v
                if kind == "user":
                    name = ":".join(reversed(v.lower().split("@"))) if "@" in v and not v.endswith("@") else v.lower().rstrip("@")
                if kind == "process" and v.isdigit() and any(p.endswith(":" + v) for p in r[kind]):
                    continue
                wanted.append(str(uuid.uuid5(uuid.UUID(identity.NAMESPACES[kind]), name)))
        assert r.refs == wanted
        assert any(v.startswith("2001") for v in r.ip)


def test_templates_merge_in_two_rounds(spark):
    rng = np.random.default_rng(3)
    said = [" ".join(["GET", *rng.choice(["a", "b"], 1), *rng.choice(["x", "y", "z"], 3), str(rng.integers(90))]) for _ in range(300)] + ["", "one", "user 7 left", "user bob left"]
    got = templates.mine(spark.createDataFrame([(s,) for s in said], "message string")).collect()
    masks = Counter(" ".join("<*>" if any(c.isdigit() for c in w) else w for w in s.split()) for s in said if s)
    assert {r.mask: r.n for r in got} == masks

    def groups(counts, width):
        parts = defaultdict(list)
        for m, n in counts.items():
            parts[(len(m.split()), *m.split()[:width])].append((m, n))
        return {m: t for p in parts.values() for m, t in templates.merge_masks(p).items()}

    first = groups(masks, 2)
    second = Counter()
    for m, t in first.items():
        second[t] += masks[m]
    merged = groups(second, 1)
    assert {r.mask: r.template for r in got} == {m: merged[t] for m, t in first.items()}
    for r in got:  # a template covers its mask
        assert all(a in (b, "<*>") for a, b in zip(r.template.split(), r.mask.split(), strict=True))


def brute_volume(rows, key, detector, least=0):
    """Event by event: the score after the last bucket that was closed before the event."""
    out, by = {}, defaultdict(list)
    for r in rows:
        by[key(r)].append(r)
    for own in by.values():
        counts = Counter(r[1] // MINUTE for r in own)
        met, known = sorted(counts), {}
        series = []
        for b, nxt in zip(met, [*met[1:], met[-1] + 1], strict=True):
            series += [(b, counts[b])] + [(b + 1 + i, 0) for i in range(min(nxt - b - 1, detector.season))]
        import pandas as pd

        scores = detector.step(detector.start(), pd.DataFrame({"n": [n for _, n in series]}))
        last = 0.0
        for (b, n), s in zip(series, scores, strict=True):
            if n:
                known[b] = last
            last = s
        newest = None
        for i, r in enumerate(sorted(own, key=lambda r: (r[1], r[0]))):
            out[(r[0], key(r))] = (known[newest] if newest is not None else 0.0) if i + 1 >= least else None
            newest = r[1] // MINUTE
    return out


def test_volumes_of_templates_and_entities(events):
    rows, df = events
    detector = detectors.HoltWinters(season=6)
    got = {r.event_id: r.score for r in detectors.template_volume(df.where("template_id IS NOT NULL"), detector, MINUTE, 20).collect()}
    wanted = brute_volume([r for r in rows if r[4] is not None], lambda r: (r[2], r[4]), detector, 20)
    assert {i: s and round(s, 9) for i, s in got.items()} == {i: s and round(s, 9) for (i, _), s in wanted.items()}
    each = [(*r[:6], ref) for r in rows for ref in dict.fromkeys(r[6])]
    best = defaultdict(float)
    for (i, _), s in brute_volume(each, lambda r: (r[2], r[6]), detector).items():
        best[i] = max(best[i], s)
    assert {r.event_id: round(r.score, 9) for r in detectors.entity_volume(df, detector, MINUTE).collect()} == {i: round(best[i], 9) for i in best}
    assert any(s for s in best.values())


def test_content_scores_by_mass_of_the_window_before(events):
    rows, df = events
    forest = detectors.Forest(("f1",), trees=5, height=3, window=50)
    got = {r.event_id: r.score for r in detectors.forest_scores(df, "source_type", forest).collect()}
    dims, cuts = forest.nodes()
    for source in ("s0", "s1"):
        own = [r for r in rows if r[2] == source]
        leaf = []
        for r in own:
            at = []
            for t in range(5):
                node = 0
                for _ in range(3):
                    node = 2 * node + (2 if r[5] >= cuts[t, node] else 1)
                at.append(node)
            leaf.append(at)
        for i, r in enumerate(own):
            w = i // 50
            before = leaf[(w - 1) * 50 : w * 50] if w else []
            mass = sum(x[t] == leaf[i][t] for x in before for t in range(5))
            assert got[r[0]] == pytest.approx(1 - mass / 250 if w else 0.0)


def test_pattern_novelty_event_by_event(events):
    rows, df = events
    got = {r.event_id: r.pattern_novelty for r in ueba.pattern_novelty_exact(df, top=3).collect()}
    weights = defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        own, t = weights[r[3]], r[4]
        wanted = 0.0 if t is None else 1.0 if t not in own else 1 - own[t] / max(own.values())
        assert got[r[0]] == pytest.approx(wanted)
        if t is not None:
            for k in own:
                own[k] *= 0.95
            own[t] = own.get(t, 0.0) + 0.05
            weights[r[3]] = dict(sorted(own.items(), key=lambda x: -x[1])[:3])


def test_folded_alerts(spark):
    rng = np.random.default_rng(7)
    rows = [(f"a{i:04d}", f"k{rng.integers(3)}" if i % 50 else None, int(t)) for i, t in enumerate(np.cumsum(rng.integers(0, 700, 800)) - 50_000)]
    got = {r.alert_id: (r.anchor_ns, r.dedup_count) for r in alerts.anchored(spark.createDataFrame(rows, "alert_id string, k string, timestamp_ns long"), ["k"], 1000).collect()}
    state = {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        anchor, n = state.get(k, (None, 0))
        state[k] = (anchor, n + 1) if anchor is not None and abs(t - anchor) <= 1000 else (t, 1)
        assert got[i] == state[k]
    assert len(got) == len(rows)


def test_ranks_and_late_flags_over_parts(events):
    rows, df = events
    got = {r.event_id: r["rank"] for r in windows.ranked(df, ["source_type"], bucket_ns=7 * MINUTE).collect()}
    for source in ("s0", "s1"):
        assert [got[r[0]] for r in sorted((r for r in rows if r[2] == source), key=lambda r: (r[1], r[0]))] == list(range(1, sum(r[2] == source for r in rows) + 1))
    late = {r.event_id: r.late for r in windows.late_flags(df.withColumn("arrival", F.col("event_id") * 37 % 101), ["source_type"], "arrival", 50 * MINUTE, 10).collect()}
    newest = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[0] * 37 % 101, r[0])):
        newest[r[2]] = max(newest[r[2]], r[1])
        assert late[r[0]] == (r[1] < newest[r[2]] - 50 * MINUTE)
    assert any(late.values())


def test_built_in_rules_fire_once_their_counts_are_met(spark):
    said = [("Failed password for x", 5), ("Accepted a password", 1)]
    rows = [(i, "e", "user", "syslog", i * 10**9, m) for i, m in enumerate(m for m, n in said for _ in range(n))]
    df = spark.createDataFrame(rows, "event_id long, entity string, entity_type string, source_type string, timestamp_ns long, message string")
    found = correlate.correlate(df, correlate.RULES[0], contributing=True).collect()
    assert [(r.event_id, r.n_events, sorted(r.contributing_events)) for r in found] == [(5, 6, [0, 1, 2, 3, 4, 5])]
    assert correlate.correlate(df.where("event_id <> 2"), correlate.RULES[0]).count() == 0


def brute_betweenness(links):
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    nodes = sorted({x for e in links for x in e})
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        depth, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        credit = defaultdict(float)
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    credit[x] += paths[x] / paths[y] * (1 + credit[y])
            if y != s:
                total[y] += credit[y]
    n = len(nodes)
    return {x: v / ((n - 1) * (n - 2)) for x, v in total.items()}


def test_betweenness_in_blocks(spark):
    rng = np.random.default_rng(9)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 25, (45, 2))] + [("p", "q"), ("q", "r")]
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(links, "source_id string, target_id string"), block=12).collect()}
    assert got == pytest.approx(brute_betweenness(links))


def test_ranks_settle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "source_id string, target_id string")
    got = {r.node: r["rank"] for r in graph.pagerank(e).collect()}
    rank = dict.fromkeys("abcd", 0.25)
    for _ in range(300):
        rank = {"a": 0.0375 + 0.85 * (rank["c"] + rank["d"]), "b": 0.0375 + 0.85 * rank["a"], "c": 0.0375 + 0.85 * rank["b"], "d": 0.0375}
    assert got == pytest.approx(rank, abs=1e-6)


def test_batch_scores_and_alerts(spark, sf_dir):
    """The blend of six scores, row by row; an alert of every family, once."""
    got = QUERIES["a19_detectors_only"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/events.parquet").count() == len({r.event_id for r in got})
    assert all(math.isfinite(r.anomaly_score) for r in got) and any(r.volume for r in got) and any(r.sequence for r in got)
    rows = batch.normalised(lines(spark, sf_dir).select("event_id", "timestamp_ns", "source_type", "message"))
    found = batch.anomalies(rows, 3600 * 10**9, 30, 24, 10).collect()
    past = defaultdict(lambda: defaultdict(list))
    for r in sorted(found, key=lambda r: (r.timestamp_ns, r.event_id)):
        zs = []
        for name in batch.DETECTORS:
            x, own = r[name], past[r.source_type][name]
            zs.append(None if x is None else x if len(own) < 2 else (x - np.mean(own)) / max(np.std(own, ddof=1), 1e-10))
            if x is not None:
                own.append(x)
        pairs = [(z, w) for z, w in zip(zs, (0.30, 0.25, 0.20, 0.25, 0.15, 0.15), strict=True) if z is not None]
        agree = sum(z > 1 for z, _ in pairs)
        score = sum(z * w for z, w in pairs) / sum(w for _, w in pairs) * (2.0 if agree >= 4 else 1.5 if agree >= 3 else 1.0)
        if all(abs(z - 1) > 1e-6 for z, _ in pairs) and all(abs(z) < 1e4 for z, _ in pairs):
            assert r.anomaly_score == pytest.approx(score, rel=1e-5, abs=1e-5)
    folded = QUERIES["a18_analyse"](spark, sf_dir).collect()
    assert {"sigma", "ioc", "graph"} <= {k.split(":")[0] for k in (r.dedup_key for r in folded)} <= {"ml", "sigma", "correlation", "ioc", "ueba", "graph"} and all(r.dedup_count >= 1 for r in folded)
    assert len({(r.dedup_key, r.anchor_ns) for r in folded}) == len(folded)


def test_long_paths_are_found(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(53)]
    e = spark.createDataFrame(chain, "source_id string, target_id string").coalesce(1)
    assert graph.shortest_path(e, "c000", "c053") == [f"c{i:03d}" for i in range(54)]
    assert graph.shortest_path(e.limit(5), "c000", "x") == []
