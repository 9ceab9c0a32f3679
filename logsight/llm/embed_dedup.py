"""Near duplicates among embeddings: int8 tile products with error bounds, doubles where in doubt.

Rows are compared within equal, non-null labels. Equal vectors are collapsed
first. The distinct vectors of a label are dealt into blocks, and each pair of
blocks is one tile in one task. A tile multiplies the int8 forms; a vector's
quantisation error norm bounds how far the product can be from the cosine, so
only pairs that may reach the threshold are computed again in double precision.
A tile returns a row for each vector with links: the number of links and the
smallest vector of its group in the tile. Pairs never leave the task.

Cases: a vector that is null, empty, zero, or holds null or non-finite values
links with nothing, as do rows with a null label or a null id; vectors of
different lengths are not compared. Rows that repeat an id and a vector are
separate rows that link with each other. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm.common import connected_components, materialize

_TILE = "id long, links long, root long"


def _quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, norms of what they stand for, and norms of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the groups of a[i] and b[i]; a group's parent is its smallest index."""
    while True:
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(pa, pb)[apart], np.minimum(pa, pb)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def tile_links(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, side: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links of one tile. side: 0 and 1 for the two blocks, or all 0 for a block with itself."""
    order = np.argsort(ids, kind="stable")
    ids, counts, vectors, side = ids[order], counts[order], vectors[order], side[order]
    squares = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    q, scale, size, error = _quantise(vectors / squares[:, None])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    own = not len(right)
    right = left if own else right
    # products of int8 values are whole numbers, exact in float32 below 2**24 and in float64 beyond
    kind = np.float32 if vectors.shape[1] * 127 * 127 < 2**24 else np.float64
    qr = q[right].astype(kind).T
    links = np.zeros(len(ids), np.int64)
    parent = np.arange(len(ids))
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        near = (q[rows].astype(kind) @ qr) * scale[rows][:, None] * scale[right][None, :]
        slack = error[rows][:, None] + size[rows][:, None] * error[right][None, :] + 1e-6
        a, b = np.nonzero(near + slack >= threshold)
        a, b = rows[a], right[b]
        if own:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            sure = np.einsum("ij,ij->i", vectors[x], vectors[y]) / squares[x] / squares[y] >= threshold
            x, y = x[sure], y[sure]
            np.add.at(links, x, counts[y])
            np.add.at(links, y, counts[x])
            parent = _join(parent, x, y)
    got = links > 0
    return pd.DataFrame({"id": ids[got], "links": links[got], "root": ids[parent[got]]})


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block_rows: int = 4096
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; see the module for the cases."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid, rest = rows.where(good), rows.where(~good)

    distinct = materialize(
        valid.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")), "op1-distinct"
    )
    blocks = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = distinct.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "copies", "vector"
    )

    def in_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, np.float64) for v in pdf["vector"]])
        _, exponent = np.frexp(np.abs(x).max(axis=1))  # by a power of two, which changes no cosine and keeps squares in range
        x = np.ldexp(np.ldexp(x, -(exponent // 2)[:, None]), -(exponent - exponent // 2)[:, None])
        return tile_links(pdf["id"].to_numpy(), pdf["copies"].to_numpy(), x, pdf["side"].to_numpy(), threshold)

    found = materialize(tiles.groupBy("label", "dim", "i", "j").applyInPandas(in_tile, _TILE), "op1-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = (
        distinct.join(links, "id", "left")
        .join(components.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    out = valid.join(groups, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
