"""Streaming forms of the stateful operators.

A step is a function (state, frame) -> (state, results) over one key's new rows
in order; the state is a small dict that JSON can hold, kept in the state store by
`with_state`. What grows with a key's rows or texts is a list or map of typed
entries (`windows_met`, `mined`). Keys expire by event time. The batch operators compute the same results, which the tests
compare. Progress and restarts are left to checkpoints (S7).
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter, deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logsight.functions.text import template_of
from logsight.operators.correlate import kill_chain_fold
from logsight.operators.detectors import Cusum, Forest, HoltWinters, TailThreshold
from logsight.operators.templates import WILD

Step = Callable[[dict | None, pd.DataFrame], tuple[dict, pd.DataFrame]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiring(StatefulProcessor):
    """Leaves a key's state in the store for idle_ns of event time after its last row, or for good without idle_ns.

    One timer a key: a row that comes later puts it off. When the watermark
    reaches it, what `forget` names is cleared.
    """

    def __init__(self, order: list[str], idle_ns: int | None):
        self.order, self.idle_ns = order, idle_ns

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.idle_ns is not None:
            self.timer = handle.getValueState("timer", "at long")

    def in_order(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        if self.idle_ns is not None and len(frame):
            # in milliseconds, rounded up
            at = -(-(int(frame[self.order[0]].iloc[-1]) + self.idle_ns) // 1_000_000)
            old = self.timer.get()[0] if self.timer.exists() else None
            if old is None or at > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(at)
                self.timer.update((at,))
        return frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class _Folding(_Expiring):
    def __init__(self, step: Step, order: list[str], idle_ns: int | None = None):
        super().__init__(order, idle_ns)
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin(handle)
        self.state = handle.getValueState("state", "json string")

    def forget(self) -> None:
        self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = self.in_order(rows)
        old = json.loads(self.state.get()[0]) if self.state.exists() else None
        new, out = self.step(old, frame)
        self.state.update((json.dumps(new),))
        yield out


class _Windows(_Expiring):
    """The flagged rows of the last span_ns as a list in the state store, each row an entry of its own."""

    def __init__(self, span_ns: int, least: dict[str, int], order: list[str], idle_ns: int | None):
        super().__init__(order, idle_ns)
        self.span_ns, self.least = span_ns, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin(handle)
        self.recent = handle.getListState("recent", "timestamp_ns long, flag string")

    def forget(self) -> None:
        self.recent.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = self.in_order(rows)
        held = deque(sorted(self.recent.get()))
        counts = Counter(flag for _, flag in held)
        fired = []
        for row in frame.itertuples():
            if isinstance(row.flag, str):
                held.append((int(row.timestamp_ns), row.flag))
                counts[row.flag] += 1
            while held and held[0][0] < row.timestamp_ns - self.span_ns:
                counts[held.popleft()[1]] -= 1
            if all(counts[k] >= n for k, n in self.least.items()):
                fired.append((row.entity, row.event_id, row.timestamp_ns, sum(counts[k] for k in self.least)))
        if held:
            self.recent.put(list(held))
        else:
            self.recent.clear()
        yield pd.DataFrame(fired, columns=["entity", "event_id", "timestamp_ns", "n_events"])


class _Miner(_Expiring):
    """Templates of one token count and first tokens, a map in the state store from id to template."""

    def __init__(self, share: float, order: list[str], idle_ns: int | None):
        super().__init__(order, idle_ns)
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin(handle)
        self.known = handle.getMapState("templates", "template_id long", "place int, template string, n long, first_ns long, last_ns long")

    def forget(self) -> None:
        self.known.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = self.in_order(rows)
        found = sorted([*v, k[0]] for k, v in self.known.iterator())  # place, template, n, first, last, id
        tokens = [f[1].split(" ") for f in found]
        out, changed = [], set()
        for row in frame.itertuples():
            own = row.mask.split(" ")
            for i, t in enumerate(tokens):
                if sum(a == b for a, b in zip(t, own, strict=True)) >= self.share * len(own):
                    break
            else:
                i = len(found)
                # the id comes from the mask that began the template, and stays when the template widens
                number = int.from_bytes(hashlib.blake2b(row.mask.encode(), digest_size=8).digest(), "little", signed=True)
                found.append([i, row.mask, 0, int(row.timestamp_ns), 0, number])
                tokens.append(own)
            if tokens[i] != own:
                tokens[i] = [a if a == b else WILD for a, b in zip(tokens[i], own, strict=True)]
            f = found[i]
            f[1], f[2], f[4] = " ".join(tokens[i]), f[2] + 1, max(f[4], int(row.timestamp_ns))
            changed.add(i)
            out.append((row.event_id, row.timestamp_ns, f[5], f[1], f[2]))
        for i in changed:
            self.known.updateValue((found[i][5],), tuple(found[i][:5]))
        yield pd.DataFrame(out, columns=["event_id", "timestamp_ns", "template_id", "template", "n"])


class _Markov(_Expiring):
    """Counts of template pairs as maps in the state store (S3 for W5); a batch reads and writes only the pairs that it meets."""

    def __init__(self, keys: list[str], epsilon: float, warm_up: int, order: list[str], idle_ns: int | None):
        super().__init__(order, idle_ns)
        self.keys, self.epsilon, self.warm_up = keys, epsilon, warm_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.begin(handle)
        self.pairs = handle.getMapState("pairs", "prev long, cur long", "n long")
        self.totals = handle.getMapState("totals", "prev long", "n long")
        self.last = handle.getValueState("last", "prev long, learned long, met long")

    def forget(self) -> None:
        for state in (self.pairs, self.totals, self.last):
            state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = self.in_order(rows)
        prev, learned, met = self.last.get() if self.last.exists() else (None, 0, 0)
        pairs: dict[tuple[int, int], int] = {}
        totals: dict[int, int] = {}
        scores = np.zeros(len(frame))
        for i, cur in enumerate(frame["template_id"].tolist()):
            if prev is not None:
                if (prev, cur) not in pairs:
                    pairs[prev, cur] = self.pairs.getValue((prev, cur))[0] if self.pairs.containsKey((prev, cur)) else 0
                if prev not in totals:
                    totals[prev] = self.totals.getValue((prev,))[0] if self.totals.containsKey((prev,)) else 0
                pair, total = pairs[prev, cur], totals[prev]
                if learned >= self.warm_up and met > 0:
                    if total == 0:
                        scores[i] = 1.0 if met > 1 else 0.0
                    else:
                        low = total + self.epsilon * met
                        scores[i] = min(1.0, max(0.0, np.log((pair + self.epsilon) / low) / np.log(self.epsilon / low)))
                met += total == 0
                pairs[prev, cur], totals[prev] = pair + 1, total + 1
            prev, learned = cur, learned + 1
        for (a, b), n in pairs.items():
            self.pairs.updateValue((a, b), (n,))
        for a, n in totals.items():
            self.totals.updateValue((a,), (n,))
        self.last.update((prev, learned, met))
        yield frame[[*self.keys, "event_id"]].assign(score=scores)


def _run(rows: DataFrame, keys: list[str], processor: _Expiring, schema: str, slack: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if processor.idle_ns is None:
        return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "None")
    timed = rows.withColumn("event_time", F.timestamp_micros(F.expr(f"{processor.order[0]} div 1000"))).withWatermark("event_time", slack)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "EventTime")


def with_state(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, idle_ns: int | None = None, slack: str = "30 seconds") -> DataFrame:
    """Run a step over each key's rows with state in RocksDB.

    With idle_ns, rows pass in event time: those behind the watermark, the newest
    time of earlier batches less the slack, are left out (S1; Spark takes a new
    watermark for late rows one batch later than for timers), and a key that
    has been silent for idle_ns leaves the store. That changes no result when the
    step forgets within idle_ns by itself: the window of S6, the span of S5, 64
    half-lives of S4. order begins with the time in nanoseconds.
    """
    return _run(rows, keys, _Folding(step, order, idle_ns), schema, slack)


def windows_met(rows: DataFrame, keys: list[str], span_ns: int, least: dict[str, int], idle_ns: int | None = None, slack: str = "30 seconds") -> DataFrame:
    """Rows at which every condition has enough rows in the window.

    rows: entity, event_id, timestamp_ns, flag (the condition's name, or null).
    """
    return _run(rows, keys, _Windows(span_ns, least, ["timestamp_ns", "event_id"], idle_ns), "entity string, event_id long, timestamp_ns long, n_events long", slack)


def mined(lines: DataFrame, text: str = "message", share: float = 0.4, depth: int = 2, idle_ns: int | None = None, slack: str = "30 seconds") -> DataFrame:
    """event_id, timestamp_ns, template_id, template and its lines so far, for each line as it comes.

    A tree of fixed depth: lines go by their number of tokens and first `depth`
    tokens, masked, to a list of templates in order of birth, and join the first
    one with at least `share` equal tokens, which widens; else they begin one.
    Within a batch lines pass in order of (time, id). Ids depend on the mask that
    began a template alone, so restarts keep them.
    """
    masked = lines.withColumn("mask", template_of(F.col(text))).where("mask <> ''")
    tokens = F.split("mask", " ")
    keyed = masked.select("event_id", "timestamp_ns", "mask", F.size(tokens).alias("size"), F.array_join(F.slice(tokens, 1, depth), " ").alias("head"))
    return _run(keyed, ["size", "head"], _Miner(share, ["timestamp_ns", "event_id"], idle_ns), "event_id long, timestamp_ns long, template_id long, template string, n long", slack)


def risk_step(half_life_ns: int) -> Step:
    """Decayed risk from (sum, time of it); late rows are aged to that time."""

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"sum": 0.0, "at": int(frame["timestamp_ns"].iloc[0])}
        out = []
        for t, p in zip(frame["timestamp_ns"], frame["points"], strict=True):
            if t >= s["at"]:
                s = {"sum": s["sum"] * 0.5 ** ((t - s["at"]) / half_life_ns) + p, "at": int(t)}
            else:
                s["sum"] += p * 0.5 ** ((s["at"] - t) / half_life_ns)
            out.append(s["sum"])
        return s, frame[["entity_value", "alert_id", "timestamp_ns"]].assign(risk=out)

    return step


def dedup_step(window_ns: int) -> Step:
    """Anchor and count of the current window."""

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"anchor": None, "n": 0}
        anchors, counts = [], []
        for t in frame["timestamp_ns"]:
            same = s["anchor"] is not None and abs(t - s["anchor"]) <= window_ns
            s = {"anchor": s["anchor"] if same else int(t), "n": s["n"] + 1 if same else 1}
            anchors.append(s["anchor"])
            counts.append(s["n"])
        return s, frame[["dedup_key", "alert_id"]].assign(anchor_ns=anchors, dedup_count=counts)

    return step


def kill_chain_step(least: int, span_ns: int) -> Step:
    """First times of tactics and the fired mark."""

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        out, (first, fired) = kill_chain_fold(frame, least, span_ns, state=(state["first"], state["fired"]) if state else None)
        return {"first": {k: int(v) for k, v in first.items()}, "fired": fired}, out

    return step


def bucket_step(detector: Cusum | HoltWinters, bucket_ns: int, keys: list[str]) -> Step:
    """Counts of the open bucket and the detector's state; each event gets the score before it (S3)."""
    cap = detector.season if isinstance(detector, HoltWinters) else 100

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"bucket": None, "n": 0, "score": 0.0, "model": detector.start()}
        scores = np.zeros(len(frame))
        for i, t in enumerate(frame["timestamp_ns"]):
            scores[i] = s["score"]
            b = int(t) // bucket_ns
            if s["bucket"] is None:
                s["bucket"], s["n"] = b, 1
            elif b == s["bucket"]:
                s["n"] += 1
            elif b > s["bucket"]:
                closed = [s["n"]] + [0] * min(b - s["bucket"] - 1, cap)
                s["score"] = float(detector.step(s["model"], pd.DataFrame({"n": closed}))[-1])
                s["bucket"], s["n"] = b, 1
        return s, frame[[*keys, "event_id"]].assign(score=scores)

    return step


def tail_step(t: TailThreshold, key: str) -> Step:
    """First scores, then limits and excesses (S3)."""

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"first": [], "rank": 0, "model": None}
        flags = []
        for x in frame["score"]:
            s["rank"] += 1
            if s["model"] is None:
                s["first"].append(float(x))
                flags.append(False)
                if len(s["first"]) >= t.window:
                    s["model"], s["first"] = t.begin(np.array(s["first"])), []
            else:
                flags.append(bool(t.step(s["model"], float(x), s["rank"])))
        return s, frame[[key, "event_id"]].assign(anomaly=flags)

    return step


def markov(events: DataFrame, keys: list[str], epsilon: float = 1e-6, warm_up: int = 100, idle_ns: int | None = None, slack: str = "30 seconds") -> DataFrame:
    """The keys, event_id and score of each event with a template: how unlikely it is after the one before (S3 for W5)."""
    types = dict(events.dtypes)
    rows = events.where("template_id IS NOT NULL").select(*keys, "event_id", "timestamp_ns", F.col("template_id").cast("long").alias("template_id"))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", event_id {types['event_id']}, score double"
    return _run(rows, keys, _Markov(keys, epsilon, warm_up, ["timestamp_ns", "event_id"], idle_ns), schema, slack)


def z_step(value: str, keys: list[str]) -> Step:
    """Number, mean and squared deviations of what came before (S3 for W9); each row gets its distance from them."""

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"n": 0, "mean": 0.0, "squares": 0.0}
        out = np.full(len(frame), np.nan)
        for i, x in enumerate(frame[value]):
            if pd.isna(x):
                continue
            out[i] = x if s["n"] < 2 else (x - s["mean"]) / max((s["squares"] / (s["n"] - 1)) ** 0.5, 1e-10)
            n, away = s["n"] + 1, x - s["mean"]
            mean = s["mean"] + away / n
            s = {"n": n, "mean": float(mean), "squares": float(s["squares"] + away * (x - mean))}
        return s, frame[[*keys, "event_id"]].assign(z=out)

    return step


def template_volume_step(detector: HoltWinters, bucket_ns: int, least: int = 50) -> Step:
    """The volume score of a (source, template), null until `least` of its events (S3 for W7)."""
    inner = bucket_step(detector, bucket_ns, ["source_type", "template_id"])

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"rank": 0, "volume": None}
        volume, out = inner(s["volume"], frame)
        known = s["rank"] + 1 + np.arange(len(frame)) >= least
        return {"rank": s["rank"] + len(frame), "volume": volume}, out.assign(score=out["score"].where(known))

    return step


def forest_step(forest: Forest, key: str) -> Step:
    """Masses of the last whole window and of the open one; each row is scored by the last (S3 for W6).

    The state holds the leaves that have been met, trees times 2**height at most.
    """
    nodes, width = forest.nodes(), 2**forest.height
    offsets = np.arange(forest.trees) * width

    def dense(mass: dict[str, int]) -> np.ndarray:
        out = np.zeros(forest.trees * width, int)
        out[[int(k) for k in mass]] = list(mass.values())
        return out

    def sparse(mass: np.ndarray) -> dict[str, int]:
        return {str(i): int(mass[i]) for i in np.flatnonzero(mass)}

    def step(state: dict | None, frame: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
        s = state or {"windows": 0, "n": 0, "last": {}, "open": {}}
        windows, n, last, now = s["windows"], s["n"], dense(s["last"]), dense(s["open"])
        at = forest.leaves(frame[list(forest.features)].to_numpy(float), nodes) + offsets
        scores, i = np.zeros(len(frame)), 0
        while i < len(frame):
            part = at[i : i + forest.window - n]  # what the open window still takes
            if windows:
                scores[i : i + len(part)] = 1 - last[part].sum(axis=1) / (forest.trees * forest.window)
            np.add.at(now, part.ravel(), 1)
            i, n = i + len(part), n + len(part)
            if n == forest.window:
                windows, n, last, now = windows + 1, 0, now, np.zeros_like(now)
        return {"windows": windows, "n": n, "last": sparse(last), "open": sparse(now)}, frame[[key, "event_id"]].assign(score=scores)

    return step


def entity_volumes(events: DataFrame, detector: HoltWinters, bucket_ns: int, most: int = 32, idle_ns: int | None = None, slack: str = "30 seconds") -> DataFrame:
    """source_type, ref, event_id and the volume score of each of an event's first entities (S3 for W8).

    All entities of an event come in its own batch, so `largest` of each batch is the event's score.
    """
    types = dict(events.dtypes)
    each = events.select("event_id", "timestamp_ns", "source_type", F.explode(F.array_distinct(F.slice("entity_refs", 1, most))).alias("ref"))
    keys = ["source_type", "ref"]
    return with_state(each, keys, ["timestamp_ns", "event_id"], bucket_step(detector, bucket_ns, keys), f"source_type {types['source_type']}, ref {dict(each.dtypes)['ref']}, event_id {types['event_id']}, score double", idle_ns, slack)


def largest(batch: DataFrame) -> DataFrame:
    """event_id and its largest score, of a batch of `entity_volumes` (for foreachBatch)."""
    return batch.groupBy("event_id").agg(F.max("score").alias("score"))


def template_counts(lines: DataFrame) -> DataFrame:
    """Counts and times of templates, in update mode."""
    return lines.groupBy("template").agg(F.count("*").alias("event_count"), F.min("timestamp_ns").alias("first_seen_ns"), F.max("timestamp_ns").alias("last_seen_ns"))


def edge_counts(pairs: DataFrame) -> DataFrame:
    """Counts and times of edges, in update mode."""
    return pairs.groupBy("source_id", "target_id", "rel_type").agg(F.count("*").alias("event_count"), F.min("timestamp_ns").alias("first_seen"), F.max("timestamp_ns").alias("last_seen"))


def branches(events: DataFrame, on_all: Callable[[DataFrame, int], None], on_timely: Callable[[DataFrame, int], None], checkpoint: str, slack_ns: int = 30_000_000_000) -> StreamingQuery:
    """All events to one branch, those no more than the slack behind the newest so far to the other.

    The newest time is one number, kept beside the stream's checkpoint in a folder
    a batch; only the batch before is read, and a repeated batch sees the same
    number. For the branch alone, `with_state` with idle_ns does it by watermark.
    """
    spark: SparkSession = events.sparkSession
    place = f"{checkpoint}/newest"

    def each(batch: DataFrame, number: int) -> None:
        past = -1
        if number:
            past = spark.read.schema("newest long").json(f"{place}/{number - 1}").agg(F.coalesce(F.max("newest"), F.lit(-1))).first()[0]
        batch = batch.persist()
        on_all(batch, number)
        on_timely(batch.where(F.col("timestamp_ns") >= past - slack_ns), number)
        newest = batch.agg(F.greatest(F.coalesce(F.max("timestamp_ns"), F.lit(-1)), F.lit(past)).alias("newest"))
        newest.coalesce(1).write.mode("overwrite").json(f"{place}/{number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def run_once(result: DataFrame, name: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process what is there into a memory table; for tests and small results."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
