"""Removal of long repeated passages, found through recompression.

A window is `window` consecutive words of one document. Words covered by a
window whose words also start in a document with a smaller doc_id are removed.

1. Recompression (see `recompress`) names the symbols of each document; each
   window has one anchor, a border of symbols with the names of those round it.
2. Spark groups the anchors of all documents. Those of a single document end
   here, which is nearly all of them.
3. Windows whose anchor is shared are named by the symbols that they consist of,
   and once more by those of a second recompression that begins with independent
   values of the words: 128 bits that no collision of a word or a symbol passes.
   Each name counts once a document; Spark takes each name's smallest document
   and joins it back: that verifies the repeat.
4. Documents with covered windows are cut; all others keep their words.

Documents with equal words are handled first: all but the smallest doc_id lose
every word if they have a window at all, and take no part in 2 and 3.

Cases: a null or empty text has no words and is kept as such; texts shorter
than a window lose nothing; rows with a null doc_id are returned whole and are
nobody's source; rows that repeat a doc_id count as one document id (a passage
in both is not a repeat) and each gives a row, with the larger of the two cuts
if their words differ. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm import recompress, words
from logsight.llm.common import materialize, small_batches

#: Parts that each group of equal texts is dealt into.
SALTS = 16
_NONE = hashlib.sha256(b"").hexdigest()


def _chunks(texts: list[str | None], size: int = 400_000, other: bool = False) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, all their word values, number of the text of each word, first word of each text)."""
    held: list[tuple[int, np.ndarray]] = []
    n = 0
    for item in words.many_values(texts, other=other):
        held.append(item)
        n += len(item[1])
        if n >= size:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray]]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(v) for _, v in held])
    return [i for i, _ in held], np.concatenate([v for _, v in held]), np.repeat(np.arange(len(held)), lengths), np.cumsum(lengths) - lengths


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, keys, whole, sha = [], [], [], []
            for numbers, values, docs, first in _chunks(texts):
                anchors = recompress.window_anchors(recompress.symbols(values, docs, window), values, docs, window)
                for k, i in enumerate(numbers):
                    own = values[first[k] : first[k] + (n := int((first[k + 1] if k + 1 < len(first) else len(values)) - first[k]))]
                    n_words.append(n)
                    keys.append(np.unique(anchors[first[k] : first[k] + n - window + 1]).view(np.int64) if n >= window else np.zeros(0, np.int64))
                    whole.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sha.append(hashlib.sha256(b" ".join((texts[i] or "").encode().split())).hexdigest())
            # ids stay in Arrow: pandas would round them beside a null
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(whole, pa.binary()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "keys", "whole", "sha"])

    return scan


def _candidates(frame: pd.DataFrame, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, window start in its text, two hashes) of the windows whose anchor is shared, by text."""
    texts = frame["text"].tolist()
    for (numbers, values, docs, first), (_, others, _, _) in zip(_chunks(texts), _chunks(texts, other=True), strict=True):
        found = recompress.symbols(values, docs, window)
        anchors = recompress.window_anchors(found, values, docs, window).view(np.int64)
        ends = np.append(first[1:], len(values))
        at = [np.zeros(0, np.int64)]
        for k, i in enumerate(numbers):
            if ends[k] - first[k] >= window:
                own = anchors[first[k] : ends[k] - window + 1]
                at.append(np.flatnonzero(np.isin(own, np.asarray(frame["keys"].iloc[i]))) + first[k])
        at = np.concatenate(at)
        one, two = (recompress.passage_names(f, at, window).view(np.int64) for f in (found, recompress.symbols(others, docs, window)))
        yield np.asarray(numbers)[docs[at]], at - first[docs[at]], one, two


def _windows(window: int):
    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, _, one, two in _candidates(frame, window):
                order = np.lexsort((two, one, number))
                number, one, two = number[order], one[order], two[order]
                new = np.ones(len(one), bool)
                new[1:] = (number[1:] != number[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pd.DataFrame({"h1": one[new], "h2": two[new], "doc_id": frame["doc_id"].to_numpy()[number[new]]})

    return windows


def _among(one: np.ndarray, two: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which pairs (one, two) are among the pairs (h1, h2)."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    at, end = np.searchsorted(h1, one, "left"), np.searchsorted(h1, one, "right")
    found = np.zeros(len(one), bool)
    while (at < end).any():  # once, but for pairs that differ in the second only
        k = np.flatnonzero(at < end)
        found[k] |= h2[at[k]] == two[k]
        at[k] += 1
    return found


def _cut(window: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts: dict[int, np.ndarray] = {}
            for number, start, one, two in _candidates(frame, window):
                # rows of a text stand together
                edges = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)) if len(number) else [0]
                for a, b in itertools.pairwise(edges):
                    i = int(number[a])
                    starts[i] = start[a:b][_among(one[a:b], two[a:b], np.asarray(frame["h1"].iloc[i]), np.asarray(frame["h2"].iloc[i]))]
            removed, sha = [], []
            for i, text in enumerate(frame["text"]):
                parts = (text or "").encode().split()
                change = np.zeros(len(parts) + 1, np.int64)
                change[starts.get(i, np.zeros(0, np.int64))] += 1
                change[starts.get(i, np.zeros(0, np.int64)) + window] -= 1
                gone = np.cumsum(change)[:-1] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(parts, gone, strict=True) if not g])).hexdigest())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_removed": removed, "cut_sha": sha})

    return cut


def remove_repeats(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    scanned = materialize(texts.mapInArrow(_scan(window), "doc_id long, n_words long, keys array<long>, whole binary, sha string"), "op4-anchors")
    identified = scanned.where(F.col("doc_id").isNotNull())
    # groups of equal words, each for SALTS parts of its documents, so that a large group is spread
    groups = identified.groupBy("whole").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    first = groups.select("whole", "first_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = scanned.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    base = salted.join(first, ["whole", "salt"], "left").withColumn("first_doc", F.coalesce("first_doc", "doc_id")).drop("salt", "whole")
    base = materialize(base, "op4-firsts")
    origin = F.col("doc_id") == F.col("first_doc")

    # what is joined back is written first: then both sides are dealt anew, and Spark can split a key of very many rows
    keys = base.where(origin).select("doc_id", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"), "op4-shared")
    hits = keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    affected = materialize(texts.join(hits, "doc_id"), "op4-affected")
    found = materialize(affected.mapInPandas(_windows(window), "h1 long, h2 long, doc_id long"), "op4-windows")
    lowest = materialize(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "op4-lowest")
    covered = found.join(lowest, ["h1", "h2"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("c")).select("doc_id", "c.h1", "c.h2")
    # rows that repeat a doc_id with other words: the one with most to remove stands for both
    cuts = affected.join(covered, "doc_id").mapInPandas(_cut(window), "doc_id long, n_removed long, cut_sha string").groupBy("doc_id").agg(F.max(F.struct("n_removed", "cut_sha")).alias("c")).select("doc_id", "c.*")
    copy = ~origin & (F.col("n_words") >= window)
    return base.drop("keys").join(cuts, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NONE)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
