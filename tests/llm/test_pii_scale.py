"""Spans of very long texts: the places are right, overlaps go as stated, and the time grows with the text, not its square."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsight.llm import pii

KIND = "struct<start:int,end:int,match:string>"


def greedy(spans):
    kept, end = [], 0
    for s in spans:
        if s[0] >= end:
            kept.append(s)
            end = s[1]
    return kept


@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=40), min_size=1, max_size=20))
@settings(max_examples=15, deadline=None)
def test_overlaps_go_to_the_leftmost(spark, lists):
    rows = [(i, [(a, a + n, "m") for a, n in sorted(x)]) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, f"id int, spans array<{KIND}>")
    got = {r.id: [tuple(s) for s in r.kept] for r in df.select("id", pii._apart(F.col("spans"), KIND).alias("kept")).collect()}
    assert got == {i: greedy(x) for i, x in rows}


@given(st.lists(st.integers(0, 9), max_size=70))
@settings(max_examples=20, deadline=None)
def test_running_sums(spark, numbers):
    row = spark.createDataFrame([(numbers,)], "x array<int>").select(pii._running(F.col("x"), lambda a, b: a + b).alias("s")).first()
    assert row.s == [sum(numbers[: i + 1]) for i in range(len(numbers))]


@pytest.mark.parametrize("unit", ["w{i}x{j} ", "4111 1111 1111 1111 a{i} b{j}, ", "GB82 WEST 1234 5698 7654 32 Please{i} {j} ", "+44 (20) 1234-5678 a{i}@b.co "])
def test_time_follows_the_length(spark, unit):
    def text(n):
        return "".join(unit.format(i=i % 977, j=i % 31) for i in range(n))

    took = []
    for n in (500, 10_000, 40_000):
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        start = time.time()
        found = pii.find_spans(df).select("pii").first().pii
        masked = pii.mask(df).first().text
        took.append(time.time() - start)
        assert len(found) == n * {"w": 0, "4": 1, "G": 1, "+": 2}[unit[0]]
        assert all(s.match == text(n)[s.start : s.end] for s in found[-3:])
        assert masked.count("<") == len(found)
    assert took[2] < 4 * took[1] + 20
