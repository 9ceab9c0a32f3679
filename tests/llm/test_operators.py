"""The corpus operators against brute force, and the cases that their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsight.llm import digests, embed_dedup, minhash_dedup, mixing, packing, pii, quality, recompress, shards, substring_dedup, token_files, tokens, words
from logsight.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, one int, rep long, size long"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, 2, 3, 4) for i, t, s in rows], SCHEMA)


def odd_rows():
    passage = " ".join(f"p{i}" for i in range(70))
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "a"), (5, "one two", None), (6, LONG, "b"), (7, LONG, "b"),
        (8, "start " + passage + " end", "a"), (9, "other words here " + passage, "a"), (10, "é ü 漢字 🙂 " + passage[:40], "c"), (11, "one", "a"), (11, "one", "a"), (None, "no id", "a"), (12, "a b  c <|endoftext|> d\r\n", "c"),
        (13, "word " * 300, "c"), (14, "mail a@b.co ip 1.2.3.4 card 4111 1111 1111 1111 call +1 (555) 123-4567", "d"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def given_docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    own = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted(own.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in own.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


# words and recompression -----------------------------------------------------


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_word_values_follow_words(text):
    found = WORD.findall(text)
    values = words.values_of(text)
    assert len(values) == len(found)
    assert len(set(values.tolist())) == len(set(found))


def test_many_values_equal_single_ones():
    texts = ["a b", None, "", LONG[:5000], "x" * 9000 + " y", "  z  "]
    got = dict(words.many_values(texts, chunk=100))
    assert [got[i].tolist() for i in range(len(texts))] == [words.values_of(t).tolist() for t in texts]
    assert words.values_of("ABC Ä", True).tolist() == words.values_of("abc Ä", True).tolist()


@given(st.lists(st.sampled_from("abc"), min_size=80, max_size=400), st.integers(0, 300), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_equal_windows_have_equal_anchors(letters, cut, pad):
    values = words.mix(np.array([ord(c) for c in letters], np.uint64))
    other = np.concatenate([words.mix(np.arange(900, 900 + pad, dtype=np.uint64)), values[min(cut, len(values) - 60) :]])
    window = 50
    both = []
    for v in (values, other):
        anchors = recompress.window_anchors(recompress.symbols(v, np.zeros(len(v), int), window), v, np.zeros(len(v), int), window)
        both.append({bytes(v[i : i + window]): anchors[i] for i in range(len(v) - window + 1)})
    for w in both[0].keys() & both[1].keys():
        assert both[0][w] == both[1][w]
    assert not set(both[0].values()) & {np.iinfo(np.uint64).max}


# 1 ---------------------------------------------------------------------------


def pair_bounds(a, b):
    """(int8 product, bound on its distance from the cosine) of row pairs."""
    unit = [x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b)]
    (qa, sa, na, ea), (qb, sb, _, eb) = (embed_dedup._quantise(x) for x in unit)
    for i in range(len(a)):
        yield float(qa[i].astype(np.int64) @ qb[i].astype(np.int64) * sa[i] * sb[i]), float(ea[i] + na[i] * eb[i])


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(500, 64)), rng.normal(size=(500, 64)) * rng.random((500, 1)) * 100
    true = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    for (near, slack), t in zip(pair_bounds(a, b), true, strict=True):
        assert abs(near - t) <= slack + 1e-9


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(240):
        v = base[i % 30] + rng.normal(size=16) * (0.0 if i % 5 == 0 else 0.09)
        rows.append((i, [float(x) for x in v], i % 4 if i % 17 else None, "x", 1))
    rows += [(1000, None, 1, "x", 1), (1001, [0.0] * 16, 1, "x", 1), (1002, [float("nan")] * 16, 1, "x", 1), (1003, [None] * 16, 1, "x", 1), (1004, [1.0], 1, "x", 1), (None, [1.0] * 16, 1, "x", 1), (1005, [], 1, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, own int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(df, block_rows=16).collect()}
    good = {r[0]: (np.array(r[1], np.float32).astype(float), r[2]) for r in rows if r[0] is not None and r[0] < 1000 and r[2] is not None}
    links = defaultdict(set)
    for a, (x, la) in good.items():
        for b, (y, lb) in good.items():
            if a != b and la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    for i in got:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i].n_links == len(links[i])
        assert got[i].component_id == (None if i is None else min(seen))
        assert got[i].kept == (i is None or i == min(seen))
    assert len(got) == len(rows) and sum(map(len, links.values())) > 50
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# 2, 6 ------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@given(st.text(alphabet=st.sampled_from(list("ab Z9.,'!\n\t é漢　\xa0<|>")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_the_whole(text):
    assert tokens.encoder(tokens.default_path()).encode(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_given_texts_encode_as_the_whole(given_docs):
    own, lib = tokens.encoder(tokens.default_path()), tokenizer()
    for _, t in given_docs:
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    own, lib = tokens.PieceEncoder(tokens.default_path()), tokenizer()
    for i in range(20):
        t = " ".join(f"w{chr(97 + (i * j) % 26)}{'abc'[j % 3]}" for j in range(40))
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd):
    manifest = token_files.write_token_files(odd, length=64, per_batch=4)
    got = token_files.read_token_documents(spark, manifest).collect()
    expected, start, lib = [], 0, tokenizer()
    for i, t, _ in sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected
    one = manifest.orderBy("part").first()
    reader = token_files.open_file(one.ids_file)
    for i in (0, one.n_sequences - 1):
        ids, mask = token_files.sequence_at(reader, i)
        assert len(ids) == len(mask) == 64
    assert sum(r.n_ids for r in manifest.collect()) == start
    assert mask.sum() == (one.n_ids - 1) % 64 + 1


def test_token_files_of_nothing(spark, none):
    assert token_files.read_token_documents(spark, token_files.write_token_files(none)).count() == 0


@given(st.dictionaries(st.integers(1, 128), st.integers(1, 200), max_size=30))
@settings(max_examples=60, deadline=None)
def test_plans_use_every_piece_once(counts):
    patterns = packing.plan(counts, 128)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 128
        for x in pattern:
            used[x] += n
    assert used == Counter(counts)
    least = -(-sum(k * v for k, v in counts.items()) // 128)
    firsts = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    room = []
    for x in firsts:  # first-fit decreasing
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            room.append(128 - x)
    assert least <= sum(n for _, n in patterns) <= len(room) * 1.02 + 1


def test_linear_program_is_close_to_its_bound():
    sizes, demand = np.array([60, 45, 33]), np.array([100.0, 200.0, 300.0])
    total = sum(a for _, a in packing.configurations(sizes, demand, 100))
    for i in range(3):
        assert abs(sum(c[i] * a for c, a in packing.configurations(sizes, demand, 100)) - demand[i]) < 1e-6
    assert (sizes @ demand) / 100 <= total <= (sizes @ demand) / 100 * 1.15


def test_plans_of_many_pieces_are_close_to_the_bound():
    """Lengths of an uneven spread; the same plan shape at 1,000 and 10,000,000 pieces."""
    rng = np.random.default_rng(4)
    shares = Counter(np.minimum(1023, np.exp(rng.normal(5.8, 0.9, 1000)).astype(int) + 1).tolist())
    runs = []
    for times in (1, 100, 10_000):
        counts = {x: n * times + (x * x) % times for x, n in shares.items()}
        patterns = packing.plan(counts, 1024)
        least = -(-sum(x * n for x, n in counts.items()) // 1024)
        assert sum(n for _, n in patterns) <= least * 1.012 + 1
        runs.append(len(packing.places(patterns)))
    assert runs[2] < 4 * runs[1] + 1000


def test_packing_places(spark, odd):
    length, lib = 64, tokenizer()
    pieces = packing.token_pieces(odd, length, keep_ids=True)
    got = packing.pack(pieces, length).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    wanted = Counter(i for i, _, _ in odd_rows())
    for i, t, _ in odd_rows():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert len(own) == wanted[i] * -(-len(ids) // length)
        for r in own:
            assert r.length <= length and (r.piece == 0 or r.length == length)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for seq in {r.sequence_id for r in got}:
        own = sorted((r for r in got if r.sequence_id == seq), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= length
    n = len({r.sequence_id for r in got})
    assert n <= -(-sum(r.length for r in got) // length) + 2
    assert packing.sequences(packing.pack(pieces, length)).count() == n


def test_packing_of_nothing(none):
    assert packing.pack(packing.token_pieces(none)).count() == 0


# 3, 7 ------------------------------------------------------------------------


def test_shards_of_odd_rows(odd, none):
    got = shards.byte_shards(odd, 4).collect()
    assert len(got) == len(odd_rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.doc_id: (r.size, r.text_crc32) for r in got}[10][0] == len(odd_rows()[9][1].encode()) + 1
    assert shards.byte_shards(none).count() == 0


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix_sources(odd, extra=("lang",)).collect()
    assert len(got) == len(odd_rows()) and all(r.lang == "en" for r in got)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd, extra=("lang",)).collect()))
    assert mixing.mix_sources(none).count() == 0


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 500, "c": 40, None: 900}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weights = dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True))
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weights[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weights[s] for s in open_}
    assert {s: pytest.approx(t) for s, t in target.items()} == got


# 4, 5 ------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup_of_odd_rows(spark, none):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 11]
    rows += [(20, "word " * 90 + "tail", "x"), (21, "ab cd " * 60, "x"), (22, "x ab cd" + " ab cd" * 40, "x"), (19, "p3 " + " ".join(f"p{i}" for i in range(4, 60)), "x")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows, 50)
    assert got[7][1] == 60_000 and got[9][1] == 70
    with_null = substring_dedup.remove_repeats(documents(spark, odd_rows())).collect()
    assert len(with_null) == len(odd_rows())
    assert substring_dedup.remove_repeats(none).count() == 0


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_groups(rows, width, num, den):
    sets = {i: shingle_set(t, width) for i, t, _ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"t{i}" for i in range(3000)]
    rows = []
    for g in range(6):
        text = list(rng.choice(vocabulary, 160))
        for c in range(40):
            own = list(text)
            for _ in range(c % 9):  # some copies are linked only through others
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            if c % 3 == 0:
                text = own
            rows.append((10_000 + g * 1000 + c, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize(("width", "num", "m", "block"), [(3, 85, 8, 512), (5, 80, 10, 16)])
def test_near_duplicates_against_brute_force(spark, width, num, m, block):
    rows = near_rows() + [r for r in odd_rows() if r[0] is not None and r[0] != 11]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(documents(spark, rows), width, num, 100, m=m, block=block).collect()}
    assert got == brute_groups(rows, width, num, 100)
    assert len({c for _, c in got.values()}) < len(rows) - 100


def test_rows_that_repeat_an_id_are_one_node(spark):
    """Id 5 has three texts: it is linked with the near copies of each."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(5000)], 120)) for _ in range(4)]
    rows = [(5, texts[0], "s"), (5, texts[1], "s"), (5, texts[1], "s"), (5, texts[2], "s"), (2, texts[0] + " end", "s"), (9, "start " + texts[1], "s"), (7, texts[2] + " more", "s"), (8, texts[3], "s"), (1, texts[3] + " x", "s"), (6, None, "s"), (6, texts[3], "s")]
    got = minhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == {5: 2, 2: 2, 9: 2, 7: 2, 8: 1, 1: 1, 6: 1}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_parts_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "PART", 7)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(documents(spark, rows), block=9).collect()}
    assert got == brute_groups(rows, 3, 85, 100)


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash_dedup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r.doc_id: r.component_id for r in got}[11] == 4
    assert minhash_dedup.near_duplicates(none).count() == 0


# 8, 9, 10 --------------------------------------------------------------------


def test_fingerprints_follow_documents(spark, none):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 11]
    got = {r.doc_id: r for r in digests.edited_fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t, _), (j, n, _) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = digests.digest(t), digests.digest(edited), digests.digest(n)
        assert (r.fingerprint, r.edited_fingerprint) == (digests.written(a), digests.written(b))
        assert (r.near_edited, r.near_next) == (digests.likeness(a, b), digests.likeness(a, c))
    assert got[6].fingerprint == got[7].fingerprint
    assert digests.edited_fingerprints(none).count() == 0
    for rows in (odd_rows(), [(5, "a text", "s")], [(None, "x y", "s"), (None, "z", "s")]):
        assert digests.edited_fingerprints(documents(spark, rows)).count() == len(rows)


def plain_digest(text):
    """The digest of the docstring, triplet by triplet."""
    data, counts = (text or "").encode(), [0] * 256
    for i in range(len(data) - 2):
        counts[((data[i] + data[i + 1] * 256 + data[i + 2] * 65536) * 2654435761 % 2**32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k - 1] for k in (64, 128, 192))
    size = 0
    while 1.2 ** (size + 1) <= (len(data) + 1) * (1 + 1e-12):
        size += 1
    return min(255, size), q1 * 15 // max(q3, 1), q2 * 15 // max(q3, 1), [sum(c > q for q in (q1, q2, q3)) for c in counts]


def plain_likeness(a, b):
    steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[3], b[3], strict=True))
    steps += 4 * max(0, abs(a[0] - b[0]) - 1) + abs(a[1] - b[1]) + abs(a[2] - b[2])
    return max(0.0, 1 - steps / 480)


def test_digest_against_counting_one_by_one(given_docs):
    texts = [t for _, t in given_docs[:60]] + ["", None, "a", "ab", "abc", "é漢🙂" * 40, "x" * 3000]
    plain = [plain_digest(t) for t in texts]
    for t, p in zip(texts, plain, strict=True):
        levels = "".join(format(x, "02b") for x in p[3])
        assert digests.written(digests.digest(t)) == bytes([p[0], p[1] * 16 + p[2]]).hex() + format(int(levels, 2), "0128x")
    for i in range(len(texts) - 1):
        assert digests.likeness(digests.digest(texts[i]), digests.digest(texts[i + 1])) == plain_likeness(plain[i], plain[i + 1])


def test_likeness_is_bounded_and_tells_edits_from_others(given_docs):
    texts = [t for _, t in given_docs if t and len(t) > 400][:60]
    d = [digests.digest(t) for t in texts]
    for i in range(len(texts) - 1):
        half = len(texts[i]) // 2
        near = digests.likeness(d[i], digests.digest(texts[i][: len(texts[i]) - half] + texts[i + 1][:half]))
        assert 0 <= digests.likeness(d[i], d[i + 1]) <= 1 and digests.likeness(d[i], d[i]) == 1
        assert near > digests.likeness(d[i], d[i + 1]) or texts[i] == texts[i + 1]


def brute_spans(text):
    def luhn(s):
        t = 0
        for i, c in enumerate(reversed(s)):
            x = int(c) * (1 + i % 2)
            t += x - 9 * (x > 9)
        return t % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    spans = [(m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group())]
    return ",".join(s for _, _, s in sorted(spans))


def test_pii_against_patterns(spark, none, odd):
    rng = np.random.default_rng(2)
    parts = ["a@b.co", "x.y@z-1.org.uk", "a@b", "@", "a@b.c_d@e.fg", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 1234-5678", "+1", "++12 345 678 90", "é漢🙂", "GB82 WEST 1234 5698 7654 32", " ", "-", ".", "7", "a" * 50, "9" * 40]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 14))), "s") for i in range(400)] + [(1000, "a" * 200_000 + "@b." + "c." * 20_000 + "d", "s"), (1001, None, "s"), (1002, "", "s"), (1003, "1 " * 100_000, "s")]
    got = {r.doc_id: r for r in pii.report(pii.find_spans(documents(spark, rows))).collect()}
    for i, t, _ in rows:
        expected = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), (t, expected, got[i].spans)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(expected.count(k + ":") for k in ("email", "ip", "card", "phone"))
    assert any("iban" in r.spans for r in got.values())
    assert pii.report(pii.find_spans(none)).count() == 0
    assert len(pii.report(pii.find_spans(odd)).collect()) == len(odd_rows())


def test_masked_text_and_scores(spark):
    df = documents(spark, [(1, "write to me@x.org or call +1 555 123 4567 now", "s"), (2, None, "s")])
    found = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert [(s.kind, round(s.score, 2)) for s in found[1].pii] == [("email", 1.0), ("phone", 0.7)]
    far = documents(spark, [(3, "call " + "x" * 40 + " +1 555 123 4567, or GB82 WEST 1234 5698 7654 32; recall +1 555 123 4567", "s"), (4, "Bank: GB82 WEST 1234 5698 7654 32", "s"), (5, None, "s")])
    told = {r.doc_id: (r.spans.split(":")[0], r.scores) for r in pii.report(pii.find_spans(far)).collect()}
    assert told == {3: ("phone", "60,80,60"), 4: ("iban", "90"), 5: ("", "")}
    assert {r.doc_id: r.text for r in pii.mask(df).collect()} == {1: "write to <EMAIL> or call <PHONE> now", 2: None}


def test_quality_is_learned_and_held_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs, labels)).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # only rows that taught nothing
    seen = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, q in seen if q == 1], [s for s, q in seen if q == 0]
    assert len(good) >= 3 and len(bad) >= 3
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95


def test_held_out_labels_change_no_score(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    one, two = ({r.doc_id: r.score for r in quality.classify(docs, quality.fit(docs, x)).collect()} for x in (labels, turned))
    assert one == two


def test_votes_of_exact_neighbours():
    """Scores against cosines computed pair by pair, with many equal neighbours."""
    rng = np.random.default_rng(6)
    base = rng.random((12, quality.DIM)) * (rng.random((12, quality.DIM)) < 0.05)
    x = base[rng.integers(0, 12, 90)] + 0.3 * (rng.random((90, quality.DIM)) < 0.01) * (np.arange(90) % 2)[:, None]
    labels = rng.integers(0, 2, 60)
    model = quality.Model(np.ones(quality.DIM), x[:60].astype(np.float32), labels, 8, 7, (1.0, 0.4, 1.0))
    got = model.scores(x.astype(np.float32))
    known, asked = (model.latent(v.astype(np.float32)).astype(float) for v in (x[:60], x))
    for i in range(90):
        near = [sum(a * b for a, b in zip(asked[i], k, strict=True)) for k in known]
        at_least = sorted(near, reverse=True)[6] - 1e-6
        votes = [(max(s, 1e-3) ** 8, y) for s, y in zip(near, labels, strict=True) if s >= at_least]
        assert got[i] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=2e-3)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, None), (6, 0, 1), (None, 1, 1), (8, None, 0), (14, 1, 0), (9, 1, 0), (13, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    got = quality.classify(odd, model, extra=("lang", "text")).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.lang == "en" for r in got)
    assert [r.score for r in quality.classify(odd, quality.fit(odd, labels.limit(0))).collect()] == [0.5] * len(odd_rows())
    assert quality.classify(none, model).count() == 0
