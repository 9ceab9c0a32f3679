"""Alignment of the tokens of two vocabularies, and how often pairs of ids are linked.

Tokenizer A (byte level) and tokenizer B (pieces) both tile the bytes of a space
and the text. Where tokens of both end, a group ends; all pairs of an A and a B
token in a group are linked.

1. Texts are cut into units before plain spaces and line ends, where neither
   tokenizer has a token across. A worker keeps the units it has met (a bounded
   number), so each is encoded and aligned about once. Tokenizers whose parts
   don't allow that take whole texts as units.
2. New units are aligned together: all their tokens, A and B, are sorted by start
   (lexsort), the ends are accumulated by maximum, a group breaks where a start
   reaches the running maximum, and the overlaps within a group are expanded.
3. Documents stand in blocks of bounded bytes. A block holds its distinct id
   pairs with the number of its documents that link them, and each document's
   pairs as places among these.
4. Spark adds up the pairs of all blocks, finds each A id's highest count and
   joins the sums back, once a block and pair; a block's documents are then
   summed up from its own pairs. Nothing of the corpus goes through the driver.

Cases: null and empty texts, and texts of which the bytes of A or B tokens differ
from a space and the text, have no tokens: zeros and an empty groups_sha256; null
doc_ids and repeated rows are documents of their own; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm import tokens, words
from logsight.llm.common import materialize, small_batches

#: Bits of an id in a pair's key.
BITS = 24
#: Units that a worker remembers, and bytes of their texts; it starts anew beyond. Bounds on memory only.
CACHE_UNITS, CACHE_BYTES = 600_000, 64 << 20
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Bytes of text that are cut together.
CHUNK = 1 << 21


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def coalesce(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, of two tilings of the same bytes."""
    lengths = np.concatenate([a_lengths, b_lengths])
    ends = np.concatenate([np.cumsum(a_lengths), np.cumsum(b_lengths)])
    starts = ends - lengths
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group[: len(a_lengths)], group[len(a_lengths) :]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: i for i, c in tokens._byte_letters().items()}
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(n_a, n_b) >= 1 << BITS:
            raise ValueError("the vocabulary is too large")
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in map(self.a.id_to_token, range(n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        # no piece goes on over a space or holds a line end, and a space before the text is a piece of its own before line ends
        whole = any("▁" in p.lstrip("▁") or "\n" in p for p in plain)
        self.cut = tokens.can_be_cut(self.a) and not whole and self.b.encode("a", out_type=str)[0].startswith("▁") and self.b.encode("\n a\n") == [*self.b.encode(""), *self.b.encode("\n"), *self.b.encode("a"), *self.b.encode("\n")[1:]]
        self.a_names = [str(i).encode() for i in range(n_a)]
        self.b_names = [str(i).encode() for i in range(n_b)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.texts: list[bytes] = []
        self.written: list[bytes] = []
        self.n_bytes = self.n_pairs = 0
        self.valid = np.zeros(1024, bool)
        self.stats = np.zeros((1024, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pairs, self.times = np.zeros(4096, np.int64), np.zeros(4096, np.int64)

    def _encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units that begin with the space before a text, with a plain space or with a line end."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [ids if u[0] == " " else ids[1:] for u, ids in zip(units, b, strict=True)]

    def _learn(self, hashes: list[int], units: list[bytes]) -> None:
        for i in range(0, len(units), 20_000):
            self._learn_some(hashes[i : i + 20_000], units[i : i + 20_000])

    def _learn_some(self, hashes: list[int], units: list[bytes]) -> None:
        a, b = self._encode([u.decode("utf-8", "surrogatepass") for u in units])
        ok = np.fromiter((b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, u in zip(a, b, units, strict=True)), bool, len(units))
        for k in np.flatnonzero(~ok).tolist():
            a[k], b[k] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        a_len = np.fromiter(map(len, map(self.a_bytes.__getitem__, a_ids.tolist())), np.int64, len(a_ids))
        b_len = np.fromiter(map(len, map(self.b_bytes.__getitem__, b_ids.tolist())), np.int64, len(b_ids))
        a_group, b_group = coalesce(a_len, b_len)
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        unit_of_a = np.repeat(np.arange(len(units)), n_a)
        unit_of_group = np.zeros(n_groups, np.int64)
        unit_of_group[a_group] = unit_of_a
        # overlaps: the different ids of either side of a group, with their times
        a_key, a_times = _counted(a_group << BITS | a_ids)
        b_key, b_times = _counted(b_group << BITS | b_ids)
        in_b = np.bincount(b_key >> BITS, minlength=n_groups)
        first_b = np.cumsum(in_b) - in_b
        own = a_key >> BITS
        each = in_b[own]
        other = _runs(first_b[own], each)
        mask = (1 << BITS) - 1
        pair = np.repeat(a_key & mask, each) << BITS | b_key[other] & mask
        times = np.repeat(a_times, each) * b_times[other]
        unit = np.repeat(unit_of_group[own], each)
        order = np.lexsort((pair, unit))
        unit, pair, times = unit[order], pair[order], times[order]
        new = np.ones(len(unit), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        summed = np.add.reduceat(times, at) if len(at) else times
        n_pairs = np.bincount(unit[at], minlength=len(units))
        links = np.bincount(unit, weights=times, minlength=len(units)).astype(np.int64)
        # groups as text: each token with the mark behind it
        a_last = np.append(a_group[1:] != a_group[:-1], True) if len(a_group) else np.zeros(0, bool)
        b_last = np.append(b_group[1:] != b_group[:-1], True) if len(b_group) else np.zeros(0, bool)
        said = [self.a_names[i] + (b"|" if e else b",") for i, e in zip(a_ids.tolist(), a_last.tolist(), strict=True)]
        said += [self.b_names[i] + (b";" if e else b",") for i, e in zip(b_ids.tolist(), b_last.tolist(), strict=True)]
        place = np.lexsort((np.repeat([0, 1], [len(a_ids), len(b_ids)]), np.concatenate([a_group, b_group])))
        ordered = [said[i] for i in place.tolist()]
        upto = np.append(0, np.cumsum(n_a + n_b)).tolist()
        n, end = len(self.texts), len(self.texts) + len(units)
        for name in ("valid", "stats", "starts", "lengths"):
            setattr(self, name, tokens._with_room(getattr(self, name), end))
        self.valid[n:end] = ok
        self.stats[n:end] = np.column_stack([n_a, n_b, np.bincount(unit_of_group, minlength=len(units)), links])
        self.lengths[n:end], self.starts[n:end] = n_pairs, self.n_pairs + np.cumsum(n_pairs) - n_pairs
        for name, values in (("pairs", pair[at]), ("times", summed)):
            grown = tokens._with_room(getattr(self, name), self.n_pairs + len(values))
            grown[self.n_pairs : self.n_pairs + len(values)] = values
            setattr(self, name, grown)
        self.n_pairs += len(at)
        self.texts += units
        self.written += [b"".join(ordered[x:y]) for x, y in itertools.pairwise(upto)]
        self.n_bytes += sum(map(len, units)) + sum(map(len, self.written[n:]))
        self.known.update(zip(hashes, range(n, end), strict=True))

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the units of each text (with a space before it)."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(raw) + b" "
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(sizes + 1) - sizes - 1
        if self.cut:
            starts, ends = unit_spans(data, begins)
        else:
            starts, ends = begins, begins + sizes
        values = words.word_values(data, starts, ends)
        distinct, place, number = np.unique(values, return_index=True, return_inverse=True)
        listed = distinct.tolist()
        codes = list(map(self.known.get, listed))
        if None in codes:
            new = [k for k, c in enumerate(codes) if c is None]
            if len(self.known) + len(new) > CACHE_UNITS or self.n_bytes > CACHE_BYTES:
                self._forget()
                new = range(len(listed))
            at = place[new]
            self._learn([listed[k] for k in new], [joined[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            codes = list(map(self.known.get, listed))
        own = np.fromiter(codes, np.int64, len(codes))[number]
        at = place.tolist()
        if not all(self.texts[c] == joined[starts[p] : ends[p]] for c, p in zip(codes, at, strict=True)) or not _same(data, starts, ends, place[number]):
            raise RuntimeError("two units have one 64-bit value")
        upto = np.append(0, np.cumsum(np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=len(texts))))
        return [own[x:y] for x, y in itertools.pairwise(upto.tolist())]


def _same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span that it is said to equal."""
    lengths = ends - starts
    return bool((lengths == lengths[like]).all() and (data[_runs(starts, lengths)] == data[_runs(starts[like], lengths)]).all())


def unit_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units: cuts before single spaces and line ends between two other characters."""
    at = tokens.plain_cuts(data)
    cuts = np.zeros(len(data) + 1, bool)
    cuts[at] = True
    cuts[begins] = True
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    starts = np.flatnonzero(cuts[:-1])
    ends = np.append(starts[1:], len(data)) - np.append(first[starts[1:]], True)
    return starts, ends


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process."""
    return Aligner(a_path, b_path)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed bytes: the width, the length, the numbers."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = values.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[1:9], "little")
    return np.frombuffer(pa.decompress(packed[9:], size, codec="zstd", asbytes=True), f"<u{packed[0]}").astype(np.int64)


_DOC_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = f"block string, docs array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in _DOC.split(', '))}>>, pairs binary, df binary, sizes binary, places binary, times binary"
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])


class _Block:
    def __init__(self, own: Aligner):
        self.own, self.size = own, 0
        self.docs: list[dict] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_ids: list, texts: list[str | None]) -> None:
        own = self.own
        found = own.numbers([t or "" for t in texts])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), lengths)
        bad = np.bincount(doc, weights=~own.valid[flat], minlength=len(texts)) > 0
        bad |= np.fromiter((not t for t in texts), bool, len(texts))
        stats = np.column_stack([np.bincount(doc, weights=own.stats[flat, k], minlength=len(texts)) for k in range(4)]).astype(np.int64) if len(texts) else np.zeros((0, 4), np.int64)
        stats[bad] = 0
        for doc_id, units, wrong, row in zip(doc_ids, found, bad.tolist(), stats.tolist(), strict=True):
            sha = "" if wrong else hashlib.sha256(b"".join(map(own.written.__getitem__, units.tolist()))[:-1]).hexdigest()
            self.docs.append({"doc_id": doc_id, "n_a": row[0], "n_b": row[1], "n_groups": row[2], "n_links": row[3], "groups_sha256": sha})
        # each document's different units, then its different pairs
        good = ~bad[doc]
        key, n = _counted(doc[good] << 32 | flat[good])
        unit, doc = key & (1 << 32) - 1, key >> 32
        each = own.lengths[unit]
        at = _runs(own.starts[unit], each)
        pair, times, doc = own.pairs[at], own.times[at] * np.repeat(n, each), np.repeat(doc, each)
        order = np.lexsort((pair, doc))
        pair, times, doc = pair[order], times[order], doc[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.pairs.append(pair[at])
        self.times.append(np.add.reduceat(times, at) if len(at) else times)
        self.sizes.append(np.bincount(doc[at], minlength=len(texts)))
        self.size += sum(len(t or "") for t in texts)

    def row(self, name: str) -> pa.RecordBatch:
        pairs, places, df = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        columns = [_pack(pairs), _pack(df), _pack(np.concatenate(self.sizes)), _pack(places), _pack(np.concatenate(self.times))]
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([self.docs], pa.list_(_DOC_TYPE)), *(pa.array([c], pa.binary()) for c in columns)], names=["block", "docs", "pairs", "df", "sizes", "places", "times"]
        )


def _blocks(a_path: str, b_path: str):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, block = TaskContext.get().partitionId(), 0, _Block(aligner(a_path, b_path))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") < CHUNK):
                    size += len(texts[j] or "")
                    j += 1
                if block.docs and block.size + size > BLOCK:
                    yield block.row(f"{part}-{number}")
                    number, block = number + 1, _Block(block.own)
                block.add(ids[i:j], texts[i:j])
                i = j
        if block.docs:
            yield block.row(f"{part}-{number}")

    return blocks


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, df in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "df")), strict=True):
            own, n = _unpack(pairs), _unpack(df)
            for i in range(0, len(own), 50_000):
                part = own[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part)), pa.array(part), pa.array(n[i : i + 50_000])], names=["block", "pair", "df"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            docs = one.column("docs").flatten()
            pairs, sizes, places, times = (_unpack(one.column(c)[0].as_py()) for c in ("pairs", "sizes", "places", "times"))
            answers = one.column("answers").flatten()
            order = np.argsort(answers.field("pair").to_numpy(), kind="stable")
            if len(order) != len(pairs):
                raise RuntimeError("pairs of a block are missing")
            n, best = (answers.field(c).to_numpy(zero_copy_only=False)[order] for c in ("n", "best"))
            doc = np.repeat(np.arange(len(docs)), sizes)
            total, tops = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(total, doc, times * n[places])
            np.add.at(tops, doc, times * best[places])
            yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in _DOC_NAMES), pa.array(tops), pa.array(total)], names=[*_DOC_NAMES, "n_best", "count_sum"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id << BITS | B id), n (documents that link it), best (whether n is its A id's highest)."""
    shares = blocks.select("block", "pairs", "df").mapInArrow(_block_pairs, "block string, pair long, df long")
    counts = materialize(shares.groupBy("pair").agg(F.sum("df").alias("n")), "op12-counts")
    a_id = F.shiftright("pair", BITS)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("top"))
    return counts.withColumn("a_id", a_id).join(top, "a_id").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for every document."""
    small_batches(documents.sparkSession)
    own = default_paths()
    blocks = materialize(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(a_path or own[0], b_path or own[1]), _BLOCK), "op12-blocks")
    counts = materialize(pair_counts(blocks), "op12-pairs")
    shares = blocks.select("block", "pairs", "df").mapInArrow(_block_pairs, "block string, pair long, df long").select("block", "pair")
    answers = shares.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("answers"))
    joined = blocks.join(answers, "block", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<pair:long,n:long,best:boolean>>")))
    return joined.select("docs", "pairs", "sizes", "places", "times", "answers").mapInArrow(_sum_up, f"{_DOC}, n_best long, count_sum long")
