"""Template mining as a Spark job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.functions.text import template_of
from logsight.operators.lineage import settled

WILD = "<*>"


def merge_masks(masks: list[tuple[str, int]], share: float = 0.4) -> dict[str, str]:
    """Greedy merging of masks of one token count and first token, commonest first.

    A mask joins the first template with at least `share` equal tokens; tokens
    that differ become <*>.
    """
    found: list[list[str]] = []
    place: dict[str, int] = {}
    for mask, _ in sorted(masks, key=lambda m: (-m[1], m[0])):
        tokens = mask.split(" ")
        for i, t in enumerate(found):
            if sum(a == b for a, b in zip(t, tokens, strict=True)) >= share * len(tokens):
                found[i] = [a if a == b else WILD for a, b in zip(t, tokens, strict=True)]
                place[mask] = i
                break
        else:
            place[mask] = len(found)
            found.append(tokens)
    return {m: " ".join(found[i]) for m, i in place.items()}


def mine(lines: DataFrame, text: str = "message", share: float = 0.4) -> DataFrame:
    """(mask, template, n): masks counted first, then merged in two rounds.

    Counting collapses most lines. The masks of one token count and first two
    tokens are merged, then the few templates of one token count and first
    token. Both rounds are the same at every size. A task holds the distinct
    masks of one (count, first two tokens).
    """
    counted = lines.select(template_of(F.col(text)).alias("mask")).where("mask <> ''").groupBy("mask").agg(F.count("*").alias("n"))
    tokens = F.split("mask", " ")
    keyed = counted.select("mask", "n", F.size(tokens).alias("size"), F.element_at(tokens, 1).alias("head"), F.coalesce(F.try_element_at(tokens, F.lit(2)), F.lit("")).alias("second"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = merge_masks(list(zip(pdf["mask"], pdf["n"], strict=True)), share)
        return pdf[["size", "head", "mask", "n"]].assign(template=pdf["mask"].map(names))

    kind = "size int, head string, mask string, n long, template string"
    # the second round reads the first twice
    first = settled(keyed.groupBy("size", "head", "second").applyInPandas(merge, kind))
    few = first.groupBy("size", "head", F.col("template").alias("mask")).agg(F.sum("n").alias("n"))
    second = few.groupBy("size", "head").applyInPandas(merge, kind).select(F.col("mask").alias("part"), F.col("template").alias("merged"))
    return first.join(second, F.col("template") == F.col("part")).select("mask", F.col("merged").alias("template"), "n")


def with_templates(lines: DataFrame, mined: DataFrame, text: str = "message") -> DataFrame:
    """Each line with its template and a stable id of it."""
    names = mined.select("mask", "template", F.xxhash64("template").alias("template_id"))
    return lines.withColumn("mask", template_of(F.col(text))).join(names, "mask", "left").drop("mask")
