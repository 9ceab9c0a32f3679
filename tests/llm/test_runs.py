"""Equal windows that begin in a run of equal words have equal anchors, whatever comes before."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from logsight.llm import recompress, substring_dedup, words


@given(st.integers(0, 2**32), st.integers(17, 40), st.integers(13, 22), st.integers(33, 60), st.sampled_from([40, 44, 49, 50, 60]))
@settings(max_examples=400, deadline=None)
def test_runs_at_window_starts(seed, long, short, n, window):
    rest = words.mix(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64))
    run = words.mix(np.array([7], np.uint64))
    keys = []
    for size in (long, short):
        v = np.concatenate([np.repeat(run, size), rest])
        anchors = recompress.window_anchors(recompress.symbols(v, np.zeros(len(v), int), window), v, np.zeros(len(v), int), window)
        keys.append({bytes(v[i : i + window]): anchors[i] for i in range(len(v) - window + 1)})
        assert np.iinfo(np.uint64).max not in keys[-1].values()
    assert all(keys[0][w] == keys[1][w] for w in keys[0].keys() & keys[1].keys())


def test_a_repeat_behind_runs_is_removed(spark):
    """Passages of 33 words behind 30 and 17 equal words: one window of 50 words is shared."""
    rows = []
    for k in range(40):
        passage = " ".join(f"p{k}w{i}" for i in range(33))
        rows += [(2 * k, f"x{k} " * 30 + passage), (2 * k + 1, f"x{k} " * 17 + passage)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 50 * (i % 2) for i in range(80)}


@given(st.integers(0, 2**32), st.integers(1, 4), st.sampled_from([6, 20, 40, 44, 49, 50, 60]))
@settings(max_examples=100, deadline=None)
def test_passages_are_named_by_what_they_say(seed, letters, window):
    """Equal passages, and only they, have equal names and anchors, wherever they stand."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(150, 300))
    v = words.mix(rng.integers(0, letters, n).astype(np.uint64))
    v[n // 2 : n // 2 + 65] = v[5:70]
    docs = np.repeat([0, 1], [n // 2, n - n // 2])
    found = recompress.symbols(v, docs, window)
    at = np.array([i for i in range(n - window + 1) if docs[i] == docs[i + window - 1]])
    anchors = recompress.window_anchors(found, v, docs, window)[at]
    named = list(zip(recompress.passage_names(found, at, window).tolist(), recompress.passage_names(found, at, window, True).tolist(), anchors.tolist(), strict=True))
    by_words = {}
    for i, name in zip(at.tolist(), named, strict=True):
        assert by_words.setdefault(bytes(v[i : i + window]), name) == name
    assert len({x[:2] for x in by_words.values()}) == len(by_words)


def test_pairs_are_looked_up_by_both_hashes():
    one, two = np.array([1, 1, 1, 2, 3]), np.array([5, 6, 7, 5, 0])
    assert substring_dedup._among(one, two, np.array([3, 1, 1, 9]), np.array([1, 7, 5, 9])).tolist() == [True, False, True, False, False]


def test_names_of_few_bits_are_verified_by_the_second_ones():
    """Where the first names are cut to 16 bits and collide, the second ones tell the windows apart, and equal windows agree in both."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = [vocabulary[i] for i in rng.integers(0, 40, 300)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 40, 900)) for _ in range(12)] + [" ".join(["pre"] * k + passage) for k in range(3)]
    windows = {}
    values = dict(words.many_values(texts))
    keys = [np.unique(recompress.window_anchors(recompress.symbols(v, np.zeros(len(v), int), 50), v, np.zeros(len(v), int), 50)).view(np.int64) for v in values.values()]
    frame = pd.DataFrame({"text": texts, "keys": keys})
    cut, pairs = {}, {}
    for number, start, one, two in substring_dedup._candidates(frame, 50):
        for i, s, a, b in zip(number.tolist(), start.tolist(), one.tolist(), two.tolist(), strict=True):
            own = tuple(texts[i].split()[s : s + 50])
            assert windows.setdefault(own, (a, b)) == (a, b)
            cut.setdefault(a & 0xFFFF, set()).add(own)
            pairs.setdefault((a & 0xFFFF, b), set()).add(own)
    assert sum(len(x) > 1 for x in cut.values()) > 300
    assert all(len(x) == 1 for x in pairs.values())
