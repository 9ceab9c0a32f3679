"""Token ids of whole texts through the tokenizers library, inside Spark tasks.

Byte-level pre-tokens never reach over a single space or line end that stands
between two other characters, nor over a letter and a stop behind it, so a text
may be cut there and each piece encoded by itself. Pieces repeat very often; a worker keeps the ids of pieces it has met
(a bounded number) and sends only new ones to the library. Pieces are looked up
for many texts at once by a hash, and then compared byte by byte.

That holds for byte-level vocabularies without a normaliser. The parts of a
tokenizer are looked at when it is loaded; any other one encodes whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np

from logsight.llm import words

_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), *range(28, 33)]] = False
#: Last bytes of wider spaces in UTF-8, to be looked at with the bytes before them.
_WIDE_END = np.zeros(256, bool)
_WIDE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_WIDE_START = np.zeros(256, bool)
_WIDE_START[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[[ord(c) for c in ".,;:!?"]] = True
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN_SPACE = re.compile("(?<=[!-~]) (?=[!-~])")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces a worker remembers; it starts anew beyond. A bound on memory only.
CACHE_PIECES = 1_000_000
#: Bytes of text handled together. A bound on memory only.
CHUNK = 1 << 22


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def can_be_cut(tokenizer) -> bool:
    """Whether pieces may be encoded by themselves: byte-level pre-tokens, no normaliser, a plain merge model, no added token over a cut."""
    parts = json.loads(tokenizer.to_str())
    pre, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    added = not any(re.search(r"\s|[A-Za-z][.,;:!?]", t["content"]) or t["lstrip"] or t["rstrip"] for t in parts.get("added_tokens") or [])
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(level and model.get("type") == "BPE" and plain and added) and not any(parts.get(k) for k in ("normalizer", "truncation", "padding"))


def plain_cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces and line ends that stand between two characters other than white space."""
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_SOLID[data[at - 1]] & _SOLID[data[at + 1]]]
    doubt = np.flatnonzero(_WIDE_END[data[at - 1]] | _WIDE_START[data[at + 1]])
    for k in doubt.tolist():  # letters with such bytes are common in some languages, so each place is looked at
        i = int(at[k])
        before = data[max(0, i - 4) : i].tobytes().decode("utf-8", "ignore")[-1:]
        after = data[i + 1 : i + 5].tobytes().decode("utf-8", "ignore")[:1]
        if before in _WIDE or after in _WIDE:  # an empty one counts as a space: no cut
            at[k] = -1
    return at[at >= 0]


def piece_spans(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that begin at `begins` and end in one byte that belongs to none."""
    cuts = np.zeros(len(data) + 1, bool)
    cuts[plain_cuts(data)] = True
    cuts[1 : len(data)] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    cuts[begins] = True
    starts = np.flatnonzero(cuts[:-1])
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    ends = np.append(starts[1:], len(data)) - np.append(first[starts[1:]], True)
    return starts[ends > starts], ends[ends > starts]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = can_be_cut(self.tokenizer)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash of a piece: its number
        self.marks: dict[str, list[int]] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.begins, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0
        self.bytes, self.n_bytes = np.zeros(1 << 14, np.uint8), 0

    def _pre_token(self, s: str) -> list[int]:
        return [t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.letters))]

    def _mark(self, s: str) -> list[int]:
        found = self.marks.get(s)
        if found is None:
            if len(self.marks) > 100_000:
                self.marks.clear()
            found = self.marks[s] = self._pre_token(s)
        return found

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """A word of letters, or one followed by ASCII marks, is one or two pre-tokens, after a line end one more; the library cuts all others."""
        out: list = []
        odd: list[int] = []
        tokenize = self.model.tokenize
        for p in pieces:
            lead = p[0]
            body = p[1:] if lead == " " or lead == "\n" else p
            word = body if body.isalpha() else body.rstrip(_MARKS)
            if not word.isalpha():
                odd.append(len(out))
                out.append(None)
                continue
            if word.isascii():
                ids = [t.id for t in tokenize("\u0120" + word if lead == " " else word)]
            else:
                ids = self._pre_token(" " + word if lead == " " else word)
            if lead == "\n":
                ids = self._mark("\n") + ids
            out.append(ids if len(word) == len(body) else ids + self._mark(body[len(word) :]))
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch_fast([pieces[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            found = self._encode([p.decode("utf-8", "surrogatepass") for p in part])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            n, end = len(self.known), len(self.known) + len(part)
            for name in ("starts", "lengths", "begins", "sizes"):
                setattr(self, name, _with_room(getattr(self, name), end))
            self.lengths[n:end], self.starts[n:end] = lengths, self.n_ids + np.cumsum(lengths) - lengths
            self.sizes[n:end], self.begins[n:end] = sizes, self.n_bytes + np.cumsum(sizes) - sizes
            self.ids = _with_room(self.ids, self.n_ids + int(lengths.sum()))
            self.ids[self.n_ids : self.n_ids + int(lengths.sum())] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))
            self.bytes = _with_room(self.bytes, self.n_bytes + int(sizes.sum()))
            self.bytes[self.n_bytes : self.n_bytes + int(sizes.sum())] = np.frombuffer(b"".join(part), np.uint8)
            self.n_ids += int(lengths.sum())
            self.n_bytes += int(sizes.sum())
            self.known.update(zip(hashes[i : i + 20_000], range(n, end), strict=True))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(raw) + b" "
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(sizes + 1) - sizes - 1
        starts, ends = piece_spans(data, begins)
        values = words.word_values(data, starts, ends)
        distinct, place, number = np.unique(values, return_index=True, return_inverse=True)
        listed = distinct.tolist()
        codes = list(map(self.known.get, listed))
        if None in codes:
            new = [k for k, c in enumerate(codes) if c is None]
            if len(self.known) + len(new) > CACHE_PIECES:
                self._forget()
                new = range(len(listed))
            at = place[new]
            self._learn([listed[k] for k in new], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            codes = list(map(self.known.get, listed))
        own = np.fromiter(codes, np.int64, len(codes))[number]
        # a hash may stand for another piece: compare the bytes
        length = ends - starts
        same = self.sizes[own] == length
        if same.all():
            offset = np.repeat(starts - (np.cumsum(length) - length), length)
            at = np.arange(len(offset))
            known = self.bytes[at + np.repeat(self.begins[own] - (np.cumsum(length) - length), length)]
            same = data[at + offset] == known
        lengths = self.lengths[own]
        ids = self.ids[np.arange(int(lengths.sum())) + np.repeat(self.starts[own] - (np.cumsum(lengths) - lengths), lengths)]
        upto = np.append(0, np.cumsum(lengths))[np.append(np.searchsorted(starts, begins), len(starts))]
        return [ids[a:b] for a, b in itertools.pairwise(upto.tolist())] if same.all() else self._whole(texts)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts (null: none), as the library gives for the uncut texts."""
        if not self.cut:
            return self._whole([t or "" for t in texts])
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            part, size = [], 0
            while i < len(texts) and size < CHUNK:
                part.append(texts[i] or "")
                size += len(part[-1]) + 1
                i += 1
            if len(part) > 1 and len(part[-1]) > CHUNK:  # a very long text by itself
                part.pop()
                i -= 1
            if len(part) == 1:
                out.append(np.concatenate([ids for p in _parts(part[0]) for ids in self._many([p])]))
            else:
                out += self._many(part)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


def _with_room(array: np.ndarray, n: int) -> np.ndarray:
    while n > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


def _parts(text: str) -> list[str]:
    """A text cut before plain spaces, into parts of about CHUNK where it has such spaces."""
    out, begin = [], 0
    while len(text) - begin > CHUNK and (found := _PLAIN_SPACE.search(text, begin + CHUNK)):
        out.append(text[begin : found.start()])
        begin = found.start()
    return [*out, text[begin:]]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process."""
    return PieceEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
