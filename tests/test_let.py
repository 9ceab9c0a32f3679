"""Values that stand in an expression several times are computed once."""

from pyspark.sql import functions as F

from logsight.functions import identity, text


def plan(spark, column):
    return spark.range(1).select(F.col("id").cast("string").alias("m")).select(column(F.col("m")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_template_is_masked_once(spark):
    found = plan(spark, lambda m: text.tagged(F.array(m), text.template_params(m, text.template_of(m))))
    assert found.count("8}-[0-9a-f]{4}-") == 1


def test_address_is_split_once(spark):
    assert plan(spark, identity.exploded_ipv6).count("[a-f]") <= 1 and len(plan(spark, identity.exploded_ipv6)) < 5000
