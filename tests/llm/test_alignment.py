"""Alignment of two vocabularies against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsight.llm import alignment

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SCHEMA = "doc_id long, text string, block string, pairs int, n long"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def groups(libraries, text):
    """[(A ids, B ids)] by walking both tokenizations; None without tokens."""
    if not text:
        return None
    lib_a, lib_b = libraries
    own = alignment.aligner(*alignment.default_paths())
    a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
    full = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != full or b"".join(own.b_bytes[i] for i in b) != full:
        return None
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(own.a_bytes[a[i]])
            out[-1][0].append(a[i])
            i += 1
        else:
            y += len(own.b_bytes[b[j]])
            out[-1][1].append(b[j])
            j += 1
        if x == y:
            out.append(([], []))
    return out[:-1]


def written(found):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found).encode()


def brute(libraries, rows):
    each = [groups(libraries, t) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] if g else [] for g in each]
    df = Counter(p for own in links for p in set(own))
    top = Counter()
    for (x, _), n in df.items():
        top[x] = max(top[x], n)
    return [
        (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(df[p] == top[p[0]] for p in own), sum(df[p] for p in own), hashlib.sha256(written(g)).hexdigest())
        if g else (i, 0, 0, 0, 0, 0, 0, "")
        for (i, _), g, own in zip(rows, each, links)
    ]


def odd_rows(n=400):
    rng = random.Random(3)
    parts = ["a", "b", " ", " ", "  ", ".", "\n", "\t", "'s", "é", "漢字", "🙂", " ", "\x00", "<|endoftext|>", "<s>", "<0x41>", " the", "ing", "Foo", "123", "\r\n"]
    rows = [(10 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (None, None), (1, ""), (1, "▁ is not a space"), (2**62 + 1, "a b"), (-(2**63), "a b"), (2**62 + 1, "a b"), (3, "x" * 5000), (4, "漢" * 3000 + " end"), (5, " "), (6, "\n")]


def test_against_whole_texts(spark, sf_dir, libraries):
    rows = odd_rows() + [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()]
    wanted = brute(libraries, rows)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(r[1] > 0 for r in wanted) > 300 and any(r[7] == "" for r in wanted)


@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=120))
@settings(max_examples=150, deadline=None)
def test_units_join_to_whole_texts(text):
    own = alignment.aligner(*alignment.default_paths())
    lib = (own.a, own.b)
    units = own.numbers([text])[0]
    found = groups(lib, text)
    assert (found is not None) == (bool(text) and bool(own.valid[units].all()))
    if found is not None:
        assert b"".join(own.written[u] for u in units)[:-1] == written(found)


def test_forgetting_and_small_blocks(spark, libraries, monkeypatch):
    own = alignment.Aligner(*alignment.default_paths())
    monkeypatch.setattr(alignment, "CACHE_UNITS", 50)
    rows = odd_rows(60)
    block = alignment._Block(own)
    for i in range(0, len(rows), 7):
        block.add([r[0] for r in rows[i : i + 7]], [r[1] for r in rows[i : i + 7]])
    assert [d["groups_sha256"] for d in block.docs] == [r[7] for r in brute(libraries, rows)]


def test_coalesce_breaks_where_both_end():
    a, b = alignment.coalesce(np.array([1, 3, 2, 1]), np.array([2, 2, 1, 1, 1]))
    assert (a.tolist(), b.tolist()) == ([0, 0, 1, 2], [0, 0, 1, 1, 2])


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
