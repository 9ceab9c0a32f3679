"""Run headline queries and print one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores
(default 8). Each query runs once to warm up and once timed; its rows are
counted through the noop sink, so all columns are computed. `rows_per_s` are
rates at the given size; `rows_per_s_repeated` those of the stages over the
events repeated BENCH_REPEAT times (default 10), where fixed costs weigh little.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a4_syslog_header", "e3_mask", "e4_exact_templates", "e4_templates", "e6_extract_ips", "e10_extract_domains", "e11_processes", "e13_entity_refs", "n1_normalise",
    "k1_bruteforce", "r1_sigma", "r6_routing", "j1_timeline", "j3_ioc_match", "j6_hydrate", "j7_label_match", "q1_event_query", "q3_text_search",
    "g2_bucketed", "g6_tp_patterns", "g8_template_catalog", "g11_timeline", "g12_risk_history", "g14_attack_matrix",
    "w3_holt_winters", "w4_cusum", "w5_markov", "w9_znorm", "w13_evt", "w15_risk", "w17_dedup", "u2_time_of_day", "u6_composite", "h5_pagerank", "h7_fan_out", "a18_analyse",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pyspark.sql import functions as F

    from logsight.functions import identity, text
    from logsight.operators import templates
    from logsight.plans import batch
    from logsight.plans.base import lines
    from logsight.plans.catalogue import QUERIES

    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    rates = {n: round(rows / took[q]) for n, q in (("syslog_parse", "a4_syslog_header"), ("template_mining", "e4_templates"), ("entity_extraction", "e13_entity_refs"), ("full_normaliser", "n1_normalise"), ("full_pipeline", "a18_analyse"))}
    times = int(os.environ.get("BENCH_REPEAT", "10"))
    many = lines(spark, sf).select("event_id", "timestamp_ns", "source_type", "message").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("event_id", F.col("event_id") * times + F.col("k"))
    # another word in each repetition, so that mining meets new masks
    many = many.withColumn("message", F.concat("message", F.lit(" unit"), F.expr("chr(97 + k % 26)"), F.expr("chr(97 + k div 26)")))
    m = F.col("message")
    entities = identity.entity_refs(text.ips(m), text.users(m), text.hosts(m), text.domains(m), text.files(m), text.processes(m))
    stages = {
        "syslog_parse": lambda: many.select("event_id", *(v.alias(n) for n, v in text.syslog_header(m).items())),
        "template_mining": lambda: templates.mine(many),
        "entity_extraction": lambda: many.select("event_id", entities.alias("refs")),
        "full_normaliser": lambda: batch.normalised(many),
    }
    repeated = {}
    for name, stage in stages.items():
        start = time.time()
        stage().write.format("noop").mode("overwrite").save()
        repeated[name] = round(rows * times / (time.time() - start))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "rows": rows, "rows_per_s": rates, "rows_per_s_repeated": repeated}))


if __name__ == "__main__":
    main()
