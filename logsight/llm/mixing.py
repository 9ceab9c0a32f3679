"""Mixing sources to target sizes by weighted fair queueing.

Sources in code point order (null last) weigh 3, 1, 2 and so on in turn. They
share `share` of all words by weight; a target stops at `epochs` times its
source's words and the rest is shared again by weight among the others. Within
a source the documents are shuffled by a hash of doc_id; the virtual finish
time of a document's e-th copy is the source's words up to its end divided by
the source's target. All copies are sorted by that time and the mix ends when
its words reach the budget.

Both running sums come from ranges with totals (`common.global_prefix`), so a
source with a third of all rows is spread like any other.

Cases: a null text has size 0 and is taken 0 times; a null source is a source;
repeated rows are taken one by one; ties go by source, hash and doc_id; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight.llm.common import global_prefix, materialize

WORD = r"[^\x20\x09-\x0D]+"


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """(source, rank, source_size, start, budget, target) from rows of (source, size); one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = totals.select(
        "source",
        "source_size",
        F.row_number().over(named).alias("rank"),
        (F.sum("source_size").over(named.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")).alias("start"),
        (F.sum("source_size").over(every) * share[0] / share[1]).alias("budget"),
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * epochs
    filled = Window.orderBy(limit / F.col("weight"), "rank")
    level = (F.col("budget") - F.sum(limit).over(filled.rowsBetween(Window.unboundedPreceding, 0)) + limit) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", level).withColumn("open", limit / F.col("weight") > F.col("level"))
    # the first source that its share doesn't fill sets the level of all open ones
    final = F.min(F.when(F.col("open"), F.struct((limit / F.col("weight")).alias("at"), "rank", "level"))).over(every)["level"]
    return levels.select("source", "rank", "source_size", "start", "budget", F.when(final.isNull() | (limit <= final * F.col("weight")), limit.cast("double")).otherwise(final * F.col("weight")).alias("target"))


def mix_sources(
    documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 7, extra: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns named in `extra`, for every document."""
    sized = materialize(
        documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *extra)
        .withColumn("key", shuffle_key(F.col("doc_id"), seed))
        .withColumn("one", F.lit(1)),
        "op7-sizes",
    )
    targets = materialize(source_targets(sized, weights, share, epochs), "op7-targets")
    named = sized.join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    ordered = global_prefix(named, [F.col("rank"), F.col("key"), F.col("doc_id"), F.col("size")], {"before": "size", "row": "one"}, "op7-sources")
    copies = ordered.where("size > 0 AND target > 0").select("row", "size", "rank", "key", "budget", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), ((F.col("before") - F.col("start") + F.col("size") + F.col("epoch") * F.col("source_size")) / F.col("target")).alias("time"))
    queued = global_prefix(copies, [F.col("time"), F.col("rank"), F.col("key"), F.col("row"), F.col("epoch")], {"words": "size"}, "op7-queue")
    taken = queued.where(F.col("words") + F.col("size") <= F.col("budget")).groupBy("row").agg(F.sum("size").alias("words_taken"))
    return ordered.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words_taken", F.lit(0)).cast("long").alias("taken"), *extra)
