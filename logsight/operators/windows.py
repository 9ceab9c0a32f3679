"""Window and running-statistics operators (W1, W2, W5, W9-W12, W15, W16, W18, W19) and event risk.

Rows of a key are ordered by (timestamp_ns, event_id), so ties have one order.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight.operators.aggregates import floor_to
from logsight.operators.lineage import settled

ORDER = ("timestamp_ns", "event_id")


def before(*keys: str, order: Sequence[str] = ORDER):
    """All earlier rows of the key."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sliding(keys: Sequence[str], span_ns: int):
    """Frame of the rows of the key within span_ns before the row, both ends included; for keys of few rows, see `within`."""
    return Window.partitionBy(*keys).orderBy("timestamp_ns").rangeBetween(-span_ns, 0)


def within(rows: DataFrame, keys: Sequence[str], span_ns: int, values: dict[str, tuple[str, Column]], time: str = "timestamp_ns") -> DataFrame:
    """Sums, maxima or minima over the rows of the key within span_ns before each row, both ends included.

    values: column name to ("sum", "max" or "min", expression). The result is
    that of a moving frame, without one: time is cut into blocks of the span, so
    a row's window is what its block has up to it, and what the block before has
    from the window's start on. Both are running values inside one block, from
    its begin and from its end, so the work is linear and no task holds more of
    a key than the different times of one block.
    """
    how = {n: {"sum": F.sum, "max": F.max, "min": F.min}[k] for n, (k, _) in values.items()}
    per = rows.groupBy(*keys, F.col(time).alias("_t")).agg(*(how[n](e).alias(n) for n, (_, e) in values.items()))
    none = [F.lit(None).cast(per.schema[n].dataType).alias(n) for n in values]
    asked = per.select(*keys, F.col("_t").alias("_own"), (F.col("_t") - span_ns).alias("_t"), F.lit(True).alias("_start"), *none)
    both = per.select(*keys, F.col("_t").alias("_own"), "_t", F.lit(False).alias("_start"), *values).union(asked).withColumn("_b", floor_to(F.col("_t"), span_ns))
    block = Window.partitionBy(*keys, "_b")
    up, down = block.orderBy("_t"), block.orderBy(F.col("_t").desc())  # rows of one time stand together
    parts = both.select(*keys, "_own", *(F.when(F.col("_start"), how[n](n).over(down)).otherwise(how[n](n).over(up)).alias(n) for n in values))
    return join_back(rows.withColumn("_own", F.col(time)), parts.groupBy(*keys, "_own").agg(*(how[n](n).alias(n) for n in values)), [*keys, "_own"]).drop("_own")


def running_total(rows: DataFrame, keys: Sequence[str], value: str, out: str, order: Sequence[str], time: str = "timestamp_ns", bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """Sum of the value over the key's rows up to each one, in order, which begins with the time; split by buckets of time."""
    cut = rows.withColumn("_b", floor_to(F.col(time), bucket_ns))
    per = cut.groupBy(*keys, "_b").agg(F.sum(value).alias("_n"))
    starts = per.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return join_back(cut.withColumn("_r", own), starts, [*keys, "_b"]).withColumn(out, F.col("_s") + F.col("_r")).drop("_b", "_s", "_r")


def minute_buckets(events: DataFrame, keys: Sequence[str], bucket_ns: int, cap: int) -> DataFrame:
    """Counts of each key and bucket; after each, at most `cap` empty buckets of the gap to the next.

    `seq` numbers the rows of a key as a detector would see them.
    """
    counted = events.groupBy(*keys, F.expr(f"timestamp_ns div {bucket_ns}").alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.coalesce(F.lead("bucket").over(w) - F.col("bucket") - 1, F.lit(0))
    filled = counted.withColumn("gap", F.least(gap, F.lit(cap)).cast("int")).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("gap"))))
    return filled.select(*keys, (F.col("bucket") + F.col("step")).alias("bucket"), F.when(F.col("step") == 0, F.col("n")).otherwise(0).alias("n"), F.row_number().over(Window.partitionBy(*keys).orderBy("bucket", "step")).alias("seq"))


def join_back(rows: DataFrame, one: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table with a row for each value of the columns; nulls are equal."""
    named = one.withColumnsRenamed({c: f"_j_{c}" for c in columns})
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in columns))
    return rows.join(named, same, how).drop(*(f"_j_{c}" for c in columns))


def ranked(rows: DataFrame, keys: Sequence[str], out: str = "rank", bucket_ns: int = 3_600_000_000_000, time: str = "timestamp_ns", order: Sequence[str] = ORDER) -> DataFrame:
    """The number of each row of a key from 1, in order of time.

    Rows are counted by bucket of time and the counts summed, so no window
    holds more than the rows of one bucket, or one row a bucket.
    """
    cut = rows.withColumn("_b", floor_to(F.col(time), bucket_ns))
    per = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    starts = per.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return join_back(cut.withColumn("_r", own), starts, [*keys, "_b"]).withColumn(out, F.col("_s") + F.col("_r")).drop("_b", "_s", "_r")


def previous(rows: DataFrame, keys: Sequence[str], value: str, out: str, order: Sequence[str] = ORDER, time: str = "timestamp_ns", bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """The value of the key's row before, in order, which begins with the time; null for the first.

    Each bucket of time begins with a row that holds the last value before it,
    so no window holds more than the rows of one bucket, or one row a bucket.
    """
    cut = rows.withColumn("_b", floor_to(F.col(time), bucket_ns))
    lasts = cut.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_l"))
    starts = lasts.select(*keys, "_b", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias(value), F.lit(False).alias("_row"))
    flow = cut.withColumn("_row", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    own = Window.partitionBy(*keys, "_b").orderBy("_row", *order)
    return flow.withColumn(out, F.lag(value).over(own)).where("_row").drop("_b", "_row")


def counts_before(rows: DataFrame, keys: Sequence[str], counts: dict[str, Sequence[str]], order: Sequence[str] = ORDER, time: str = "timestamp_ns", bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """For each name of `counts`, how many earlier rows of the key equal the row in the named columns.

    Each bucket of time begins with rows that hold what the buckets before have
    counted, for the values met in it. So all counts share one shuffle of the
    rows, by key and bucket, and no task holds more of a key than a bucket.
    """
    cut = rows.withColumn("_b", floor_to(F.col(time), bucket_ns))
    flow = cut.withColumns({"_of": F.lit(""), "_n": F.lit(1).cast("long")})
    for name, more in counts.items():
        earlier = F.sum("_n").over(Window.partitionBy(*keys, *more).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        starts = cut.groupBy(*keys, "_b", *more).agg(F.count("*").alias("_n")).withColumn("_n", earlier).where("_n > 0")
        flow = flow.unionByName(starts.withColumn("_of", F.lit(name)), allowMissingColumns=True)
    flow = flow.repartition(*keys, "_b")
    real = F.col("_of") == ""
    for name, more in counts.items():
        own = Window.partitionBy(*keys, "_b", *more).orderBy(real, *order).rowsBetween(Window.unboundedPreceding, -1)
        weight = F.when(real, F.lit(1)).when(F.col("_of") == name, F.col("_n")).otherwise(F.lit(0))
        flow = flow.withColumn(name, F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return flow.where(real).drop("_b", "_of", "_n")


def markov_scores(events: DataFrame, keys: Sequence[str], epsilon: float = 1e-6, warm_up: int = 100, bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """How unlikely each template is after the one before (W5); exact running counts, no state.

    P = (count(prev, cur) + e) / (count(prev) + e * V), V the number of previous templates met so far;
    score = ln P / ln(e / denominator), at most 1, and 0 for the first `warm_up` events of a key.
    Counts are split by buckets of time, and read the steps from a table, so that what gives the events runs no oftener.
    """
    steps = settled(previous(events.where(F.col("template_id").isNotNull()), keys, "template_id", "prev", bucket_ns=bucket_ns), "sequences")
    counted = counts_before(steps, keys, {"pair": ["prev", "template_id"], "total": ["prev"], "learned": []}, bucket_ns=bucket_ns)
    fresh = (F.col("prev").isNotNull() & (F.col("total") == 0)).cast("long")
    counted = running_total(counted.withColumn("fresh", fresh), keys, "fresh", "met", ORDER, bucket_ns=bucket_ns).withColumn("met", F.col("met") - F.col("fresh"))
    denominator = F.col("total") + F.lit(epsilon) * F.col("met")
    score = F.log((F.col("pair") + epsilon) / denominator) / F.log(F.lit(epsilon) / denominator)
    usable = F.col("prev").isNotNull() & (F.col("learned") >= warm_up) & (F.col("met") > 0)
    return counted.withColumn("score", F.when(usable & (F.col("total") == 0), F.when(F.col("met") > 1, 1.0).otherwise(0.0)).when(usable, F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))).otherwise(0.0)).select(*events.columns, "score")


def running_z(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(x - mean) / stdev over strictly earlier values of the key; the value itself until there are two."""
    w = before(*keys)
    n, mean, spread = F.count(value).over(w), F.avg(value).over(w), F.stddev_samp(value).over(w)
    return df.withColumn(out, F.when(n < 2, F.col(value)).otherwise((F.col(value) - mean) / F.greatest(spread, F.lit(1e-10))))


def running_z_by_bucket(df: DataFrame, keys: Sequence[str], value: str | Sequence[str], bucket_ns: int = 3_600_000_000_000, out: str | Sequence[str] = "z") -> DataFrame:
    """As `running_z`, for keys with very many rows: moments of whole buckets are summed first.

    Each bucket's count, mean and squared deviations merge pairwise into the
    state before it, so no window holds more than the rows of one bucket, or
    one row a bucket. Several values share the shuffles.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    rows = df.withColumn("_b", floor_to(F.col("timestamp_ns"), bucket_ns))
    moments = [m for i, v in enumerate(values) for m in (F.count(v).alias(f"_n{i}"), F.sum(v).alias(f"_s{i}"), F.avg(v).alias(f"_m{i}"), (F.var_pop(v) * F.count(v)).alias(f"_d{i}"))]
    starts = rows.groupBy(*keys, "_b").agg(*moments)
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n, each = range(len(values)), lambda f: {k: v for i in range(len(values)) for k, v in f(i).items()}
    c = F.col
    mean0 = lambda i: F.when(c(f"n0{i}") > 0, c(f"s0{i}") / c(f"n0{i}")).otherwise(0.0)
    starts = starts.withColumns(each(lambda i: {f"n0{i}": F.coalesce(F.sum(f"_n{i}").over(w), F.lit(0)), f"s0{i}": F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0.0))}))
    # squared deviations of the union: within buckets, and of the bucket's mean from the mean before it
    joined = lambda i: F.coalesce(c(f"_d{i}") + F.when(c(f"n0{i}") > 0, F.pow(c(f"_m{i}") - mean0(i), 2) * c(f"n0{i}") * c(f"_n{i}") / (c(f"n0{i}") + c(f"_n{i}"))).otherwise(0.0), F.lit(0.0))
    starts = starts.withColumns(each(lambda i: {f"_j{i}": joined(i)})).withColumns(each(lambda i: {f"d0{i}": F.coalesce(F.sum(f"_j{i}").over(w), F.lit(0.0))}))
    starts = starts.select(*keys, "_b", *(f"{x}{i}" for i in n for x in ("n0", "s0", "d0")))
    own = Window.partitionBy(*keys, "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    inside = each(lambda i: {f"n1{i}": F.count(values[i]).over(own), f"m1{i}": F.coalesce(F.avg(values[i]).over(own), F.lit(0.0)), f"d1{i}": F.coalesce(F.var_pop(values[i]).over(own) * F.count(values[i]).over(own), F.lit(0.0))})
    inner = join_back(rows.withColumns(inside), starts, [*keys, "_b"])

    def z(i: int) -> Column:
        n0, n1, m1 = c(f"n0{i}"), c(f"n1{i}"), c(f"m1{i}")
        both = n0 + n1
        mean = (c(f"s0{i}") + m1 * n1) / both
        dev = c(f"d0{i}") + c(f"d1{i}") + F.when((n0 > 0) & (n1 > 0), F.pow(m1 - mean0(i), 2) * n0 * n1 / both).otherwise(0.0)
        return F.when(both < 2, c(values[i])).otherwise((c(values[i]) - mean) / F.greatest(F.sqrt(dev / F.greatest(both - 1, F.lit(1))), F.lit(1e-10)))

    return inner.withColumns({outs[i]: z(i) for i in n}).drop("_b", *(f"{x}{i}" for i in n for x in ("n0", "s0", "d0", "n1", "m1", "d1")))


#: Weights of content, volume, change, sequence, template volume and entity volume.
BLEND = (0.30, 0.25, 0.20, 0.25, 0.15, 0.15)


def blended(scores: Sequence[Column], weights: Sequence[float] = BLEND) -> Column:
    """Weighted mean of the scores that are not null; 0 without any."""
    top, low = F.lit(0.0), F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        top = top + F.coalesce(s * w, F.lit(0.0))
        low = low + F.when(s.isNotNull(), w).otherwise(0.0)
    return F.when(low > 0, top / low).otherwise(0.0)


def amplified(score: Column, zs: Sequence[Column]) -> Column:
    """Twice the score if two thirds of the detectors agree, half as much again for one half."""
    n = len(zs)
    k = sum((F.when(z > 1, 1).otherwise(0) for z in zs), F.lit(0))
    return score * F.when(k >= max(2 * n // 3, 2), 2.0).when(k >= max(n // 2, 2), 1.5).otherwise(1.0)


def every_nth(events: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Marks each n-th event of a key."""
    return ranked(events, keys).withColumn("scored", F.col("rank") % n == 0).drop("rank")


def decayed_risk(entries: DataFrame, key: str, points: str, half_life_ns: int = 14_400_000_000_000) -> DataFrame:
    """Sum of all points so far, each halved every half-life.

    Inside a block of 64 half-lives the sum is a running sum of points scaled
    up from the block's start, which keeps the factors within doubles; what
    earlier blocks have left is carried into the next as one number.
    """
    block = 64 * half_life_ns
    rate = math.log(2) / half_life_ns
    rows = entries.withColumn("_b", floor_to(F.col("timestamp_ns"), block))
    up = F.col(points) * F.exp(rate * (F.col("timestamp_ns") - F.col("_b")))
    own = Window.partitionBy(key, "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_u", F.sum(up).over(own))
    ends = rows.groupBy(key, "_b").agg(F.sum(up).alias("_t"))
    # a block's sum is below 2**-64 of itself one block later, so the last block before is enough
    last = ends.select(key, (F.col("_b") + block).alias("_b"), (F.col("_t") * 2.0**-64).alias("_c"))
    joined = inside.join(last, [key, "_b"], "left")
    risk = (F.col("_u") + F.coalesce("_c", F.lit(0.0))) * F.exp(-rate * (F.col("timestamp_ns") - F.col("_b")))
    return joined.withColumn("risk", risk).drop("_b", "_u", "_c")


def first_crossing(risks: DataFrame, key: str, limit: float = 50.0) -> DataFrame:
    """The first row of each key whose risk reaches the limit."""
    return risks.where(F.col("risk") >= limit).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*ORDER))).where("_r = 1").drop("_r")


def late_flags(events: DataFrame, keys: Sequence[str], arrival: str, slack_ns: int = 30_000_000_000, stretch: int = 10_000, tie: str = "event_id") -> DataFrame:
    """Late: more than the slack behind the newest time met before in order of (arrival, tie) (W18). arrival: a whole number.

    The newest times of whole stretches of arrival are taken first, so no
    window holds more than the rows of one stretch, or one row a stretch.
    """
    cut = events.withColumn("_b", F.floor(F.col(arrival) / stretch))
    per = cut.groupBy(*keys, "_b").agg(F.max("timestamp_ns").alias("_m"))
    before_it = per.withColumn("_n", F.max("_m").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    own = F.max("timestamp_ns").over(Window.partitionBy(*keys, "_b").orderBy(arrival, tie).rowsBetween(Window.unboundedPreceding, 0))
    both = join_back(cut.withColumn("_o", own), before_it, [*keys, "_b"])
    return both.withColumn("late", F.col("timestamp_ns") < F.greatest("_o", "_n") - slack_ns).drop("_b", "_o", "_n")


def fan_out_baseline(snapshots: DataFrame, floor: float = 5.0, depth: int = 20, least: int = 3) -> DataFrame:
    """Mean plus three deviations of a vertex's last snapshots, null with fewer than `least`."""
    w = Window.partitionBy("vertex").orderBy("snapshot").rowsBetween(-depth, -1)
    limit = F.greatest(F.avg("fan_out").over(w) + 3 * F.stddev_samp("fan_out").over(w), F.lit(floor))
    return snapshots.withColumn("threshold", F.when(F.count("*").over(w) >= least, limit)).withColumn("anomaly", F.coalesce(F.col("fan_out") > F.col("threshold"), F.lit(False)))
