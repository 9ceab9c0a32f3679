"""Order-dependent folds of keys with very many rows, in segments that hand their state on (X1, and W13, K5, U5)."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.operators.lineage import settled
from logsight.operators.windows import ORDER, ranked

Fold = Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]]


def fold_by_key(rows: DataFrame, keys: Sequence[str], fold: Fold, schema: str, order: Sequence[str] = ORDER, segment: int = 100_000) -> DataFrame:
    """Run a fold over each key's rows in order; for states that no window expresses.

    fold: (rows in order, state or None) to (result rows, state). schema: the
    result's columns, among them the keys. A key's rows are numbered and cut into
    segments of `segment` rows; round i runs the i-th segments of all keys, each
    with the state that the round before has written, so a task holds a segment
    and a state, whatever a key has, and a lost executor costs one segment. There
    are as many rounds as the busiest key has segments. The state must be small
    and can be pickled. order: ends in a unique column, without nulls.
    """
    numbered = ranked(rows, keys, "_rank", time=order[0], order=order).withColumn("_segment", F.expr(f"(_rank - 1) div {segment}")).drop("_rank")
    kept = settled(numbered, "segments", by="_segment")
    last = kept.agg(F.max("_segment")).first()[0]
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema.fields]

    def run(pdf: pd.DataFrame, state: bytes | None) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), ignore_index=True)
        out, following = fold(pdf, None if state is None else pickle.loads(state))
        held = {k: pdf[k].iloc[0] for k in keys} | {"_state": pickle.dumps(following)}
        state_row = pd.DataFrame([[held.get(c) for c in (*names, "_state")]], columns=[*names, "_state"], dtype=object)
        return state_row if not len(out) else pd.concat([out[names].astype(object).assign(_state=None), state_row], ignore_index=True)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, None)

    def later(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, states["_state"].iloc[0]) if len(pdf) else pd.DataFrame({c: pd.Series([], dtype=object) for c in (*names, "_state")})

    found, state = [], None
    for i in range(0 if last is None else last + 1):
        part = kept.where(F.col("_segment") == i).drop("_segment")
        if state is None:
            done = part.groupBy(*keys).applyInPandas(first, f"{schema}, _state binary")
        else:
            done = part.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(later, f"{schema}, _state binary")
        done = settled(done, "folded")
        found.append(done.where("_state IS NULL").select(*names))
        state = done.where("_state IS NOT NULL").select(*keys, "_state")
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.union, found)
