"""Best-fit packing of token sequences by linear grouping.

A document's ids are cut into pieces of at most `length`; only longer documents
are cut, and then the first piece is the one that may be shorter. The plan is
made from the number of pieces of each length, at most `length` numbers:

1. Pieces longer than `length * small` are sorted and cut into groups of equal
   cardinality; a group's pieces are rounded up to its longest.
2. Configurations (how many pieces of each group share a sequence) are chosen
   by a linear program over these few sizes, solved by column generation with
   a knapsack, and rounded down.
3. The actual lengths take the places of the rounded ones, longest first.
4. Large pieces left over by the rounding down are grouped and planned in the
   same way again, with finer groups as they are fewer, until a round places
   less than a fifth of them; then the configurations used by half a sequence or
   more are rounded up, as far as there are pieces for them.
5. What is left, and then the small ones, go best-fit, longest first, into the
   room left, or into new sequences.

The plan says, for runs of pieces in the order of length, which sequences and
offsets they get. Spark numbers the pieces by ranges of that order, so the many
of full length are spread, and each looks its place up by its number. Only the
counts (at most `length` rows) come to the driver. The plan that goes to the
tasks is a table of three numbers a run. A plan has a few runs for each length
and configuration: 3,500 for 100,000 pieces, and as many for 500 times that. It
grows with the logarithm of the number of pieces (each round of step 4 places a
fifth of what is left), at 24 bytes a run, and is made alike at every size.

Cases: null and empty texts are one piece of the end id; repeated rows are
packed one by one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm import tokens
from logsight.llm.common import global_prefix, materialize, small_batches

Pattern = tuple[int, ...]


def token_pieces(documents: DataFrame, length: int = 1024, tokenizer_path: str | None = None, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, ids: a row for each piece."""
    small_batches(documents.sparkSession)
    path = tokenizer_path or tokens.default_path()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path), np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoder.encode_many(batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate([own, end])
                at = 0
                for number in range(-(-len(ids) // length)):
                    stop = at + (len(ids) % length or length) if number == 0 else at + length
                    part = ids[at:stop]
                    row = (doc_id, number, at, stop - at, zlib.crc32(part.astype("<u4").tobytes()))
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
                    at = stop
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class _Knapsack:
    """The most valuable multiset of given sizes that fits, for changing values."""

    def __init__(self, sizes: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        left = np.arange(room + 1)[:, None] - sizes[None, :]
        self.fits, self.left = left >= 0, np.maximum(left, 0)
        self.depth = room // int(sizes.min())

    def best(self, worth: np.ndarray) -> tuple[float, np.ndarray]:
        most, picks = [np.zeros(self.room + 1)], []
        for _ in range(self.depth):  # one more piece in each level
            value = np.where(self.fits, most[-1][self.left] + worth, 0.0)
            pick = value.argmax(axis=1)
            most.append(value[np.arange(self.room + 1), pick])
            picks.append(np.where(most[-1] > most[-2] + 1e-12, pick, -1))
        counts, r = np.zeros(len(self.sizes)), self.room
        for pick in reversed(picks):
            if pick[r] >= 0:
                counts[pick[r]] += 1
                r -= int(self.sizes[pick[r]])
        return float(most[-1][self.room]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how many sequences) of a least-sequences linear program, by column generation.

    The amounts over the worth of the best further column bound the optimum from
    below, so it ends within `gap` of that, or when as many columns as there are
    sizes have come in without making the plan shorter.
    """
    basis = np.diag((room // sizes).astype(float))
    columns = [basis[:, i].copy() for i in range(len(sizes))]
    inverse = np.linalg.inv(basis)
    amounts = inverse @ demand
    knapsack = _Knapsack(sizes, room)
    least, idle = np.inf, 0
    while idle <= len(sizes):
        value, column = knapsack.best(inverse.sum(axis=0))
        if value <= 1 + gap:
            break
        now = float(amounts.sum())
        least, idle = (now, 0) if now < least - 1e-9 * now else (least, idle + 1)
        change = inverse @ column
        ratio = np.where(change > 1e-12, amounts / np.where(change > 1e-12, change, 1), np.inf)
        leaves = int(ratio.argmin())
        amounts = amounts - ratio[leaves] * change
        amounts[leaves] = ratio[leaves]
        columns[leaves] = column
        row = inverse[leaves] / change[leaves]
        inverse = inverse - np.outer(change, row)
        inverse[leaves] = row
    return list(zip(columns, amounts, strict=True))


class _Queue:
    """Pieces of one group as runs of (length, count), longest first."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []

    def size(self) -> int:
        return sum(n for _, n in self.runs)

    def take(self, n: int) -> list[list[int]]:
        out = []
        while n > 0:
            run = self.runs[0]
            m = min(n, run[1])
            out.append([run[0], m])
            run[1] -= m
            n -= m
            if not run[1]:
                self.runs.pop(0)
        return out


class _Open:
    """Sequences with room, by the room they have; best-fit takes the least that is enough."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.full: list[tuple[Pattern, int]] = []
        self.by_room: dict[int, list[list]] = {}
        self.rooms: list[int] = []

    def put(self, pattern: Pattern, n: int) -> None:
        room = self.length - sum(pattern)
        if not room:
            self.full.append((pattern, n))
            return
        if room not in self.by_room:
            self.by_room[room] = []
            bisect.insort(self.rooms, room)
        self.by_room[room].append([pattern, n])

    def put_slots(self, slots: list[list[list[int]]]) -> None:
        """Sequences whose k-th pieces are the runs of slots[k], as runs in which every slot has one length."""
        while slots[0]:
            m = min(s[0][1] for s in slots)
            self.put(tuple(s[0][0] for s in slots), m)
            for s in slots:
                s[0][1] -= m
                if not s[0][1]:
                    s.pop(0)

    def fill(self, x: int, n: int) -> None:
        """n pieces of length x, best-fit; in new sequences as many as fit when there is no room."""
        while n:
            i = bisect.bisect_left(self.rooms, x)
            if i == len(self.rooms):
                each = min(n, max(1, self.length // x))
                self.put((x,) * each, n // each)
                n %= each
                continue
            room = self.rooms[i]
            entry = self.by_room[room][-1]
            m = min(n, entry[1])
            entry[1] -= m
            if not entry[1]:
                self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms.pop(i)
            self.put((*entry[0], x), m)
            n -= m

    def patterns(self) -> list[tuple[Pattern, int]]:
        return self.full + [(p, n) for entries in self.by_room.values() for p, n in entries]


def _grouped(counts: dict[int, int], groups: int) -> list[_Queue]:
    """The pieces, longest first, in groups of equal cardinality (the last may have fewer)."""
    per = -(-sum(counts.values()) // groups)
    queues: list[_Queue] = []
    left = 0
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            if not left:
                queues.append(_Queue())
                left = per
            m = min(n, left)
            queues[-1].runs.append([x, m])
            n -= m
            left -= m
    return queues


def _left(queues: list[_Queue]) -> dict[int, int]:
    out: dict[int, int] = {}
    for q in queues:
        for x, n in q.runs:
            out[x] = out.get(x, 0) + n
    return out


def plan(counts: dict[int, int], length: int, small: float = 0.3, groups: int = 256) -> list[tuple[Pattern, int]]:
    """(lengths in a sequence, number of such sequences) that use up `counts` (pieces of each length)."""
    open_ = _Open(length)
    if counts.get(length):
        open_.put((length,), counts[length])
    rest = {x: n for x, n in counts.items() if n and small * length < x < length}
    while total := sum(rest.values()):
        queues = _grouped(rest, groups)
        found = configurations(np.array([q.runs[0][0] for q in queues]), np.array([float(q.size()) for q in queues]), length)
        for column, amount in found:
            if (n := int(amount + 1e-9)) > 0:
                open_.put_slots([queues[g].take(n) for g in np.flatnonzero(column) for _ in range(int(column[g]))])
        rest = _left(queues)
        if 5 * sum(rest.values()) <= 4 * total:
            continue
        for column, amount in sorted(found, key=lambda f: int(f[1] + 1e-9) - f[1]):
            has = all(queues[g].size() >= column[g] for g in np.flatnonzero(column))
            if amount - int(amount + 1e-9) >= 0.5 and has:
                open_.put_slots([queues[g].take(1) for g in np.flatnonzero(column) for _ in range(int(column[g]))])
        rest = _left(queues)
        break
    rest |= {x: n for x, n in counts.items() if n and x <= small * length and x < length}
    for x in sorted(rest, reverse=True):
        open_.fill(x, rest[x])
    return open_.patterns()


def places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go, by their rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for x in pattern:
            at = used.get(x, 0)
            rows.append((x, at, at + n, first, offset))
            used[x] = at + n
            offset += x
        first += n
    return rows


def pack(pieces: DataFrame, length: int = 1024, small: float = 0.3, groups: int = 256) -> DataFrame:
    """Add sequence_id and offset to the pieces of `token_pieces`."""
    spark = pieces.sparkSession
    kept = materialize(pieces.withColumn("one", F.lit(1)), "op6-pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    before, total = {}, 0
    for x in sorted(counts):
        before[x] = total
        total += counts[x]
    runs = places(plan(counts, length, small, groups))
    rows = sorted((before[x] + low, first, offset) for x, low, _, first, offset in runs)
    where = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 3))
    ranked = global_prefix(kept, [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], {"row": "one"}, "op6-order")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, firsts, offsets = where.value.T
        for batch in batches:
            row = batch.column("row").to_numpy()
            at = np.searchsorted(lows, row, "right") - 1
            found = [pa.array(firsts[at] + row - lows[at]), pa.array(offsets[at])]
            own = pa.Table.from_batches([batch]).drop(["row"]).to_batches() if batch.num_rows else []
            for b in own:
                yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, "sequence_id", "offset"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, F.col("row").cast("long")).mapInArrow(look_up, f"{own}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and the lengths of its pieces in order, from packed pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))
