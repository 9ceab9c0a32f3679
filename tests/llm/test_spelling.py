"""Spelling variants against brute force, with subtrees of very few words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logsight.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CASES = "doc_id long, text string, word string, n long, node long"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least_count=5, ratio=5):
    n = Counter()
    for doc_id, text in rows:
        for m in RUN.finditer(text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("etnaois") for _ in range(rng.randint(5, 9))) for _ in range(120)] + ["Éclairée", "straßen", "a" * 40, "zz" + "é" * 60]
    out = []
    for doc in range(160):
        words = []
        for _ in range(120):
            w = rng.choice(base[: 1 + int(len(base) * rng.random() ** 2)])
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("etx×é") + w[i:], w[:i] + rng.choice("etÉ") + w[i + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        out.append((doc if doc else None, " ".join(words)))
    out.append((500, "chained " * 800 + "chainede " * 40 + "chainedex " * 6))
    return [*out, (2**62 + 1, out[3][1]), (-(2**63), out[4][1]), (7, None), (8, ""), (9, "12 !? ab"), (3, out[3][1]), (3, out[3][1])]


@pytest.mark.parametrize("limit", [7, 60, 20_000])
def test_variants_against_brute_force(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 50)
    wanted = brute(rows)
    assert len(wanted) > 300 and any(r[3] for r in wanted) and any(r[5] not in (r[0], r[3]) for r in wanted)
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], CASES)
    assert found(spelling.variants(docs, limit=limit)) == wanted


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], CASES)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "w", 1, 2), (2, "", "w", 1, 2)], CASES)).count() == 0


def test_each_pair_once(spark):
    """Equal vectors beyond the limit are cut into slices; words of more than CAP or WIDE letters take part."""
    rng = random.Random(2)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(200)} | {"q" * n for n in range(6, 70)} | {"q" * n + "w" for n in range(40, 60)}
    df = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    pairs = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(df, limit=10).collect()]
    ordered = sorted(words)
    assert sorted(pairs) == [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if one_edit(a, b)]


def test_near_rows_and_words():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    letters, lengths = spelling._letters(words)
    for i, a in enumerate(words):
        got = spelling.near(np.repeat(letters[i : i + 1], len(words), axis=0), np.full(len(words), lengths[i]), letters, lengths)
        assert got.tolist() == [one_edit(a, b) for b in words] == [spelling.near_words(a, b) for b in words]
