"""Contiguous shards of nearly equal bytes, from global prefix sums.

The documents are dealt into ranges of doc_id; the ranges' total bytes give
each range's start, and sums inside a range give each document's place in the
whole corpus's bytes. Shard k takes the documents whose middle byte lies in the
k-th of equal parts. The law is `bytes`; equal texts need not share a shard.

Cases: a null text has size 1; a null doc_id sorts first; repeated rows are
placed one by one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm.common import global_prefix


def byte_shards(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    narrow = documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit(1).alias("one")
    )
    return deal(narrow, n_shards)


def deal(sized: DataFrame, n_shards: int) -> DataFrame:
    """The rows of `byte_shards` from (doc_id, size, text_crc32, one); `one` is 1."""
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    placed = global_prefix(sized, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], {"before": "size", "row": "one"}, "op3-ranges")
    # whole numbers throughout: a decimal quotient is rounded, and a last small document would go to shard n_shards
    twice = [f"CAST({x} AS DECIMAL(38,0))" for x in ("2 * before + size", "2 * total")]
    cut = placed.join(F.broadcast(total)).withColumn("shard", F.expr(f"{twice[0]} * {n_shards} div {twice[1]}").cast("int"))
    # a shard's first row: one row a range and shard, so nothing large is gathered
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
