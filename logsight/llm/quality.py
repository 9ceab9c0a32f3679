"""Quality by votes of the nearest labelled documents in a latent semantic space.

1. Each whole text becomes a vector of `DIM` hashed counts: triplets of
   character classes, which see case, marks, digits and layout; words; and how
   often words, pairs of words and lines come again.
2. Document frequencies are counted over all documents.
3. A bounded sample of labelled rows (`sample` rows, by a hash, up to half of
   each label where there are as many) is collected; its weighted counts are
   factored (an eigendecomposition of the DIM x DIM products) to `rank` latent
   dimensions.
4. The labelled latent vectors, at most sample x rank numbers, go to all tasks.
   Every document's cosines with all of them are computed in blocks, and the
   labels of the `k` nearest are averaged, weighted by similarity. All that are
   as near as the k-th, to within `TIE`, vote.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out of learning. labels,
lang, source and doc_id are never inputs of a score.

Cases: null and empty texts are scored as the texts they are; rows without a
label, with null labels or null ids teach nothing; of the rows of one labelled id
the least text teaches, with each of its labels; without any labels every score is
0.5; repeated rows each give a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight.llm import words
from logsight.llm.common import small_batches

_CLASSES = 8
SHAPES = _CLASSES**3
WORDS = 1024
REPEATS = 40
#: Cosines this close are equal: they are computed in single precision.
TIE = 1e-6
DIM = SHAPES + WORDS + REPEATS
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'-"]] = 5
_CLASS[[ord(c) for c in "!?()\""]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7


def _share_terms(share: float, n: int) -> np.ndarray:
    """A share from 0 to 1 as n terms around its place, so that near shares have like terms."""
    at = share * (n - 1)
    return np.clip(1.5 - np.abs(np.arange(n) - at), 0, 1)


def features(text: str | None, values: np.ndarray) -> np.ndarray:
    """Counts of one whole text; each block scaled to length 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    shapes = np.zeros(SHAPES)
    for i in range(0, max(0, len(data) - 2), 1 << 20):
        c = _CLASS[data[i : i + (1 << 20) + 2]].astype(np.int32)
        shapes += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=SHAPES)
    bag = np.bincount((values % np.uint64(WORDS)).astype(np.int64), minlength=WORDS).astype(float)
    n = max(1, len(values))
    lines = raw.split(b"\n")
    again = [
        np.mean(values[1:] == values[:-1]) if len(values) > 1 else 0.0,
        1 - len(np.unique(values)) / n,
        1 - len(words.shingles(values, 3)) / max(1, len(values) - 2) if len(values) > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(len(values)) / 10),
    ]
    repeats = np.concatenate([_share_terms(float(x), REPEATS // 5) for x in again])
    blocks = [np.sqrt(shapes), np.sqrt(bag), repeats]
    return np.concatenate([b / max(np.linalg.norm(b), 1e-9) for b in blocks]).astype(np.float32)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(texts[i], v) for i, v in words.many_values(texts)], np.float32).reshape(len(texts), DIM)


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros(DIM, np.int64), 0
    for frame in frames:
        total += (_matrix(frame["text"].tolist()) > 0).sum(axis=0)
        n += len(frame)
    yield pd.DataFrame({"term": np.arange(-1, DIM), "n": np.concatenate([[n], total])})


def _sample_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"], "features": [r.tobytes() for r in _matrix(frame["text"].tolist())], "label": frame["label"]})


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


class Model:
    """Projection and labelled latent vectors; its size is bounded by the sample and rank."""

    def __init__(self, idf: np.ndarray, x: np.ndarray, labels: np.ndarray, rank: int, k: int, block_weights: tuple[float, float, float]):
        scale = np.concatenate([np.full(n, w) for n, w in zip((SHAPES, WORDS, REPEATS), block_weights, strict=True)])
        self.scale = (idf * scale).astype(np.float32)
        weighted = (x * self.scale).astype(np.float64)
        _, vectors = np.linalg.eigh(weighted.T @ weighted)
        self.axes = vectors[:, ::-1][:, :rank].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.k = min(k, len(labels))
        self.known = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.scale) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        near = self.latent(x) @ self.known.T
        top = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
        own = np.take_along_axis(near, top, axis=1)
        weight = np.maximum(own, 1e-3).astype(np.float64) ** 8
        out = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        least = own.min(axis=1) - TIE
        for i in np.flatnonzero((near >= least[:, None]).sum(axis=1) > self.k):  # more are as near as the k-th
            every = near[i] >= least[i]
            weight = np.maximum(near[i][every], 1e-3).astype(np.float64) ** 8
            out[i] = (weight * self.labels[every]).sum() / weight.sum()
        return np.clip(out, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, rank: int = 64, k: int = 15, block_weights: tuple[float, float, float] = (1.0, 0.4, 1.0)) -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out; document frequencies cover all documents."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long"), "text")
    usable = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by = F.xxhash64("doc_id")
    few, many = (usable.where(F.col("label") == v).distinct().orderBy(by, "doc_id").limit(n) for v, n in ((0.0, sample // 2), (1.0, sample - sample // 2)))
    chosen = few.union(many)
    # one text, the least, of a labelled id: at most `sample` rows come out
    once = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = once.join(F.broadcast(chosen), "doc_id").mapInPandas(_sample_features, "doc_id long, features binary, label double").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "label"])
    counts = texts.select("text").mapInPandas(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    df = counts.reindex(range(DIM), fill_value=0).to_numpy()
    idf = np.log((1 + counts[-1]) / (1 + df)) + 1
    x = np.frombuffer(b"".join(got["features"]), np.float32).reshape(-1, DIM)
    return Model(idf, x, got["label"].to_numpy(), rank, k, block_weights)


def classify(documents: DataFrame, model: Model | None, extra: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in `extra`, for every document."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text", *[c for c in extra if c not in ("doc_id", "text")])
    fields = [f for f in rows.schema.fields if f.name in ("doc_id", *extra)]
    spread = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = own.scores(_matrix(texts)) if own is not None and len(texts) else np.full(len(texts), 0.5)
            # the other columns stay in Arrow: pandas would round whole numbers beside a null
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(found, pa.float64())], names=[*(f.name for f in fields), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    scored = rows.mapInArrow(score, schema)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[c for c in extra if c != "doc_id"])
