"""Byte shards by exact whole numbers, at sizes that no test table has."""

import pytest

from logsight.llm import shards


@pytest.mark.parametrize("sizes", [[10**10, 1], [10**10] * 3 + [1, 1, 1], [3 * 10**15, 5, 1]])
def test_small_last_documents_stay_in_the_last_shard(spark, sizes):
    rows = [(i, s, 0, 1) for i, s in enumerate(sizes)]
    got = {r.doc_id: r for r in shards.deal(spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long, one int"), 16).collect()}
    slots = {}
    for i, size in enumerate(sizes):
        shard = (2 * sum(sizes[:i]) + size) * 16 // (2 * sum(sizes))
        assert 0 <= shard < 16
        assert (got[i].shard, got[i].slot) == (shard, slots.setdefault(shard, 0))
        slots[shard] += 1
