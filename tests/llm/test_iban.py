"""Ibans with capitalised words, numbers and codes behind or before them."""

import pytest

from logsight.llm import pii

GB, DE, NO = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"
CASES = [
    (f"{GB} Please pay", [GB]), (f"{DE} BIC COBADEFFXXX", [DE]), (f"{GB} 12 EUR", [GB]), (f"to {NO} Oslo", [NO]), (f"{DE} {GB}", [DE, GB]),
    (f"{NO} 100 200 {DE}.", [NO, DE]), (f"AB12 CODE {DE} Thanks", [DE]), (GB, [GB]), (f"é漢🙂 ({DE}), x", [DE]), (f"{DE}x", []), (f"x{DE}", []), (f"{DE}1", []), (f"{GB[:-1]}3 Please", []), (f"{DE} " * 5, [DE] * 5), (f"AB12 CODE1 CODE2 CODE3 " * 2000 + DE, [DE]),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "doc_id long, text string")
    return {r.doc_id: r.pii for r in pii.find_spans(df).collect()}, {r.doc_id: r.text for r in pii.mask(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_ibans(found, i):
    text, expected = CASES[i]
    spans = [s for s in found[0][i] if s.kind == "iban"]
    assert [s.match for s in spans] == expected
    assert [text[s.start : s.end] for s in spans] == expected
    assert not any(x in found[1][i] for x in expected)
