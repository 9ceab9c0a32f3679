"""Ids over the whole range of a long, beside nulls and without: every row comes back with its own id."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from logsight.llm import digests, embed_dedup, minhash_dedup, mixing, packing, pii, quality, shards, substring_dedup, token_files
from logsight.llm.common import materialize
from tests.llm.test_operators import brute_groups, tokenizer

FAR = [2**53 - 1, 2**53, 2**53 + 1, 2**53 + 3, *range(2**60 + 1, 2**60 + 12, 2), 2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, -(2**53) - 1, -7, 0, 1]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k):
    return " ".join(f"{'aeiou'[(i * k) % 5]}{'bcdfglm'[(i + k) % 7]}ord{(i * 7 + k * 3) % 23}" for i in range(70)) + "."


@pytest.fixture(scope="module", params=[False, True], ids=["all ids", "with null"])
def rows(request):
    out = [(i, prose(k) + (" same" if k % 2 else ""), "s", "en", 1) for k, i in enumerate(FAR)]
    out += [(i ^ 4, prose(k) + " same", "s", "en", 1) for k, i in enumerate(FAR) if k % 3 == 0 and (i ^ 4) not in FAR]
    return out + ([(None, prose(3), "s", "en", 1), (None, None, "s", "en", 1)] if request.param else [])


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n) for i, t, s, lang, n in rows], SCHEMA).repartition(2)


def ids(rows):
    return sorted(((r[0] for r in rows)), key=repr)


@pytest.mark.parametrize(
    "operator",
    [
        lambda s, d: token_files.read_token_documents(s, token_files.write_token_files(d)),
        lambda s, d: shards.byte_shards(d),
        lambda s, d: substring_dedup.remove_repeats(d),
        lambda s, d: minhash_dedup.near_duplicates(d),
        lambda s, d: mixing.mix_sources(d),
        lambda s, d: digests.edited_fingerprints(d),
        lambda s, d: pii.report(pii.find_spans(d)),
        lambda s, d: quality.classify(d, None),
        lambda s, d: packing.token_pieces(d),
        lambda s, d: packing.pack(packing.token_pieces(d)),
    ],
    ids="op2 op3 op4 op5 op7 op8 op9 op10 op6-pieces op6".split(),
)
def test_every_id_comes_back(spark, rows, docs, operator):
    assert ids(operator(spark, docs).select("doc_id").collect()) == ids(rows)


def test_links(rows, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    wanted = brute_groups([(i, t, s) for i, t, s, _, _ in rows if i is not None], 3, 85, 100)
    assert got == {(i, n, c) for i, (n, c) in wanted.items()}
    assert any(i != c for i, _, c in got)


def test_successions(rows, docs):
    got = {r.doc_id: r for r in digests.edited_fingerprints(docs).collect() if r.doc_id is not None}
    texts = {i: t for i, t, *_ in rows if i is not None}
    order = sorted(texts, reverse=True)
    tail = [t for i, t, *_ in rows if i is None]
    for k, i in enumerate(order[:-1] if tail else order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_token_values(spark, rows, docs):
    lib = tokenizer()
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_documents(spark, token_files.write_token_files(docs)).collect() if r.doc_id is not None)
    wanted = []
    for i, t, *_ in rows:
        if i is not None:
            own = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
            wanted.append((i, len(own), zlib.crc32(own.tobytes())))
    assert got == sorted(wanted)


def test_vectors(spark):
    vectors = [(i, [1.0, float(k % 3), 0.5], 1) for k, i in enumerate(FAR)] + [(None, [1.0, 0.0, 0.5], 1)]
    got = {r.vec_id: r.component_id for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: min(j for m, j in enumerate(FAR) if m % 3 == k % 3) for k, i in enumerate(FAR)} | {None: None}


def test_pipeline_stages(spark, sf_dir, rows, docs):
    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r[0] for r in step.collect()}
        step = materialize(stage(spark, step, sf_dir), "ids")
        assert {r[0] for r in step.collect()} <= before
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i is not None], "doc_id long, quality int")
    kept = quality.classify(docs, quality.fit(docs, labels), extra=corpus_pipeline.COLUMNS).where("predicted = 1")
    assert ids(kept.select("doc_id").collect()) == ids(rows)
    assert sorted(map(repr, (tuple(r) for r in kept.select(*corpus_pipeline.COLUMNS).collect()))) == sorted(map(repr, (tuple(r) for r in docs.collect())))


def test_sample_is_a_bound(spark):
    """A labelled id that many rows have teaches once."""
    rows = [(7, f"text {k}", "en", "s", 1) for k in range(500)] + [(i, prose(i), "en", "s", 1) for i in range(20)]
    labels = spark.createDataFrame([(7, 1), (7, 1), *((i, i % 2) for i in range(20))], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, SCHEMA), labels, sample=10)
    assert len(model.labels) <= 10


def test_vectors_of_extreme_scale(spark):
    df = spark.createDataFrame([(i, [1.0 * s, 2.0 * s], 1) for i, s in enumerate((1e-200, 1e200, 1.0, 5e-320))], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(df).where("vec_id < 3").collect()} <= {(2, 0), (3, 0)}


def test_mask_is_a_view(spark, docs, tmp_path):
    import pyarrow as pa

    manifest = token_files.write_token_files(docs, folder="file://" + str(tmp_path / "t"), length=64, per_batch=4)
    for row in manifest.collect():
        at = row.ids_file.removeprefix("file://")
        mapped = pa.memory_map(at)
        whole = np.frombuffer(mapped.read_buffer(mapped.size()), np.uint8)
        reader = pa.ipc.open_file(mapped)
        for i in range(row.n_sequences):
            for part in token_files.sequence_at(reader, i):
                assert len(part) == 64 and whole.ctypes.data <= part.ctypes.data < whole.ctypes.data + len(whole)


def test_many_rows_of_one_id_are_dealt(spark):
    rows = [(5, f"t{k}", "en", "s", 1) for k in range(300)] + [(None, f"n{k}", "en", "s", 1) for k in range(300)] + [(k, f"x{k}", "en", "s", 1) for k in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    places, sums = digests._bounds(df.selectExpr("coalesce(~doc_id, 9223372036854775807) AS place"), 12)
    assert len(places) == 11 and len(set(zip(places.tolist(), sums.tolist(), strict=True))) == 11 and (sums > 0).any()
    got = digests.edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in rows)
