"""Quartile bucket digests of whole texts.

Byte triplets are hashed into 256 buckets. A digest holds two bits a bucket,
the quartile of the bucket's count among all counts, with a byte for the
length and one for the spread of the quartiles; it is written as hex. The
difference of two digests adds the buckets' quartile steps (a step of three
counts double), the steps of length beyond one and the steps of spread, and is
bounded; likeness is 1 at no difference and 0 at `FAR` or more.

Documents are followed in descending doc_id order, those of one doc_id in a fixed
order of their texts' checksums. They are dealt into ranges of that order, and
each range meets its own successions in one task; where a range ends, its last
text and the first of the next range are joined, one row a range. Ids stay whole
numbers or decimal text throughout, never doubles.

Cases: null texts are as empty ones; texts of fewer than three bytes have no
triplet; repeated rows follow each other; null doc_ids come last; one document is
followed by itself; an empty table gives no rows. A range holds all rows of equal
id and text; the rows of one id (or without one) are dealt into several by their
texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsight.llm.common import materialize, partitions, small_batches

BUCKETS = 256
#: The difference from which two digests count as wholly unlike.
FAR = 480
_STEP = np.array([0, 1, 2, 6])


def digest(text: str | None) -> np.ndarray:
    """Length byte, spread byte, and a quartile (0 to 3) for each bucket."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(0, len(data) - 2), 1 << 20):
        part = data[i : i + (1 << 20) + 2].astype(np.uint32)
        triplet = part[:-2] | (part[1:-1] << np.uint32(8)) | (part[2:] << np.uint32(16))
        counts += np.bincount((triplet * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    levels = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = min(255, int(np.log1p(len(data)) / np.log(1.2)))
    spread = (q1 * 15 // max(q3, 1)) << 4 | (q2 * 15 // max(q3, 1))
    return np.concatenate([[size, spread], levels]).astype(np.uint8)


def written(d: np.ndarray) -> str:
    four = d[2:].reshape(-1, 4)
    return bytes([*d[:2], *(four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3])]).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for differences of FAR or more."""
    steps = int(_STEP[np.abs(a[2:].astype(int) - b[2:])].sum())
    steps += 4 * max(0, abs(int(a[0]) - int(b[0])) - 1)
    steps += abs((int(a[1]) >> 4) - (int(b[1]) >> 4)) + abs((int(a[1]) & 15) - (int(b[1]) & 15))
    return max(0.0, 1.0 - steps / FAR)


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_ROW = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "first_text string, last_id string, last_text string"


def _successions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order: a row for each document with its successor in the range, and one for the ends of the range."""
    at, first, held = None, None, None
    names = ["range", *_COLUMNS, "first_text", "last_id", "last_text"]

    def edge() -> pd.DataFrame:
        return pd.DataFrame([(at, *[None] * len(_COLUMNS), first, held[0], held[1])], columns=names, dtype=object)

    for frame in frames:
        out = []
        for where, doc_id, text in zip(frame["range"].tolist(), frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
            own = (doc_id, text or "", digest(text))
            if where != at:
                if held is not None:
                    yield edge()
                at, first = where, own[1]
            else:
                out.append((where, *_row(held, own), None, None, None))
            held = own
        if out:
            yield pd.DataFrame(out, columns=names)
    if held is not None:
        yield edge()


def _last_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last document of each range with the first text of the next one."""
    for frame in frames:
        if len(frame):
            rows = [_row((i, t, digest(t)), (None, n, digest(n))) for i, t, n in zip(frame["last_id"].tolist(), frame["last_text"].tolist(), frame["next_text"].tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=_COLUMNS)


def _row(one: tuple, following: tuple) -> tuple:
    doc_id, text, own = one
    half = len(text) // 2
    edited = text[: len(text) - half] + following[1][:half]
    other = digest(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, written(own), written(other), likeness(own, other), likeness(own, following[2])


def _bounds(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs (place, checksum) that cut the rows into ranges of about equal size; a place of very many rows is cut by checksums."""
    low = rows.agg(F.min("place")).first()[0]
    if low is None or n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beyond = (F.col("place").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double")
    cuts = rows.agg(F.percentile_approx(beyond, [i / n for i in range(1, n)], 100 * n)).first()[0]
    places, times = np.unique(np.array([low + int(c) for c in cuts], dtype=object), return_counts=True)
    pairs = [(min(p, 2**63 - 1), (1 << 32) * j // t) for p, t in zip(places.tolist(), times.tolist(), strict=True) for j in range(t)]
    return tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True))


def _range_of(bounds: tuple[np.ndarray, np.ndarray]):
    places, sums = bounds

    @F.pandas_udf("int")
    def range_of(place: pd.Series, checksum: pd.Series) -> pd.Series:
        p, c = place.to_numpy(np.int64), checksum.to_numpy(np.int64)
        out, end = np.searchsorted(places, p, "left"), np.searchsorted(places, p, "right")
        for k in np.unique(out[end > out]).tolist():
            own = np.flatnonzero((out == k) & (end > out))
            out[own] += np.searchsorted(sums[k : end[own[0]]], c[own], "right")
        return pd.Series(out.astype(np.int32))

    return range_of


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    spark = documents.sparkSession
    small_batches(spark)
    n = partitions(spark)
    # place: descending ids, null last; its checksum is beyond those of the least id, which has the same place
    place = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(2**63 - 1))
    bounds = _bounds(documents.select(place.alias("place")), n)
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) + F.when(F.col("doc_id").isNull(), F.lit(1 << 33)).otherwise(F.lit(0))
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", place.alias("place"), checksum.alias("checksum"))
    # a range holds whole checksums; those of null ids count from 2^33
    rows = rows.withColumn("range", _range_of(bounds)("place", F.col("checksum") % (1 << 33)) + F.when(F.col("checksum") >= 1 << 33, len(bounds[0]) + 1).otherwise(0))
    dealt = rows.repartitionById(2 * len(bounds[0]) + 2, F.col("range")).sortWithinPartitions("range", "place", "checksum", "text").select("range", "doc_id", "text")
    found = materialize(dealt.mapInPandas(_successions, f"range int, {_ROW}, {_EDGE}"), "op8-successions")
    ends = found.where("last_text IS NOT NULL").select("range", "first_text", "last_id", "last_text")
    order = ends.select("range").distinct()  # one row a range
    following = order.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy())).alias("next"))
    closed = ends.select("range", "last_id", "last_text").join(following, "range").join(ends.select(F.col("range").alias("next"), F.col("first_text").alias("next_text")), "next")
    last = closed.select("last_id", "last_text", "next_text").mapInPandas(_last_rows, _ROW)
    return found.where("last_text IS NULL").select(*_COLUMNS).union(last).withColumn("doc_id", F.col("doc_id").cast("long"))
