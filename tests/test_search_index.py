"""The phrase index: stems by published examples, and searches against a walk over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from logsight.operators import aggregates, search_index

#: Examples of the published rules.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall "
    "hissing hiss fizzed fizz failing fail failed fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic "
    "differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal "
    "sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer "
    "airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt relation relat homologou homolog communism commun "
    "activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll yes ye yield yield a a is is x9ing x9ing"
).split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = {r.word: r.stem for r in search_index.with_stems(spark.createDataFrame([(w,) for w, _ in pairs], "word string")).collect()}
    assert got == dict(pairs)


WORDS = "failed failing fails password passwords user users the session opened opening Open x1 é".split()


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(2**60 + i, i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", "  --", "\n"])) for i in range(300)] + [(1, 1, None), (2, 2, "")]
    path = str(tmp_path_factory.mktemp("index") / "i")
    search_index.build(spark.createDataFrame(rows, "event_id long, timestamp_ns long, message string").repartition(3), path, buckets=16)
    return path, rows


@pytest.mark.parametrize("phrase", ["Failing passwords", "failed", "the user's", "open sessions open", "users users", "opened the É", "nothing here", "?!", "fail fail fail"])
def test_phrases_and_words(spark, indexed, phrase):
    path, rows = indexed
    stems = search_index.asked_stems(spark, phrase)
    known = {r.word: r.stem for r in search_index.with_stems(spark.createDataFrame([(w.lower(),) for w in WORDS], "word string")).collect()}
    own = {i: [known[w] for w in (t or "").lower().replace(".", " ").replace("-", " ").split()] for i, _, t in rows}
    runs = {i for i, s in own.items() if stems and any(s[k : k + len(stems)] == stems for k in range(len(s)))}
    every = {i for i, s in own.items() if stems and set(stems) <= set(s)}
    assert {r.event_id for r in search_index.phrase_hits(spark, path, phrase, buckets=16).collect()} == runs
    found = search_index.word_hits(spark, path, phrase, buckets=16).collect()
    assert {r.event_id for r in found} == every and len(found) == len(every)
    assert all(r.timestamp_ns == r.event_id - 2**60 for r in found)


def test_only_the_asked_folders_are_read(spark, indexed):
    path, _ = indexed
    hits = search_index.phrase_hits(spark, path, "failing", buckets=16)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "stem" in plan.split("PushedFilters")[1][:200]
    files = hits.sparkSession.read.parquet(path).where(F.col("stem") == "fail").select(F.input_file_name()).distinct().count()
    assert files < spark.read.parquet(path).select(F.input_file_name()).distinct().count()


def test_a_common_stem_has_files_of_bounded_rows(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id AS event_id", "id AS timestamp_ns", "concat('failed logins u', id) AS message")
    path = str(tmp_path / "i")
    search_index.build(rows, path, rows_a_file=500)
    index = spark.read.parquet(path)
    assert index.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 1000
    assert {r.stem: r["count"] for r in index.where("stem IN ('fail', 'login')").groupBy("stem").count().collect()} == {"fail": 6000, "login": 6000}
    assert search_index.phrase_hits(spark, path, "failing login").count() == 6000


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(1)
    values = [(f"k{i % 2}", i % 24, rng.lognormvariate(0, 2)) for i in range(60_000)] + [("one", 1, 5.0), ("none", 1, None)]
    df = spark.createDataFrame(values, "k string, hour int, value double")
    found = {r.k: r for r in aggregates.merged_percentiles(aggregates.latency_sketches(df, ["k", "hour"], "value"), ["k"]).collect()}
    for k in ("k0", "k1"):
        own = sorted(v for key, _, v in values if key == k)
        assert found[k].n == len(own)
        for q in (50, 95, 99):
            rank = sum(v <= found[k][f"p{q}"] for v in own) / len(own)
            assert abs(rank - q / 100) < 0.005
    assert found["one"].p50 == found["one"].p99 == 5.0
