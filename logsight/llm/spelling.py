"""Spelling variants of words: groups of near words found in a trie of letter counts.

1. Spark counts the words of all documents with its own expressions. A word is
   a maximal run of letters, in small letters; each run of a document in which
   a hash says so has lost one letter.
2. Each word has a vector of `LEVELS` counts, one for each group of letters.
   Arranged by successive counts the vectors form a trie. One insertion,
   deletion or replacement changes at most one count by +1 and one by -1, so a
   search that goes down the trie with a budget of one surplus and one deficit
   meets every near word.
3. The trie is cut into subtrees of at most `limit` words. Spark finds them four
   levels at a time: nodes with more words are opened further, and each word
   follows the branches that its budget reaches, in one direction only, so that
   a pair is met once. Words of equal vectors beyond `limit` are cut by a hash.
4. A task holds one subtree's words, sorted by vector, so that a node is a range
   of them. The words that reach it stream past, in parts where there are many;
   the search goes depth first and carries all words of a batch down a branch at
   once. Leaf words are verified letter by letter.
5. A word's form is its near word of largest count, if that is `ratio` times its
   own; roots are found by doubling the steps along forms.

Cases: null and empty texts have no runs; a null doc_id hashes as an empty text;
repeated rows count again; an empty table gives no rows. Counts above `CAP` of
one letter group are equal in the vector, which only makes the search wider;
words of more than `WIDE` letters are verified one by one. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.llm.common import discard, materialize, partitions

RUN = "[A-Za-zÀ-ÿ]{%d,}"
#: Letters of each level of the trie, frequent ones first; the last level holds all other letters.
GROUPS = ("e", "n", "t", "i", "a", "o", "r", "s", "h", "l", "du", "cmg", "pfbv", "wykjxqz")
LEVELS = len(GROUPS) + 1
#: Levels that are searched in one round of Spark.
STEP = 4
#: Largest count in a vector: four bits a level, so a vector is one long.
CAP = 15
#: Words of a node that are compared at once instead of going deeper.
LEAF = 24
#: Letters of the words that are verified many at a time.
WIDE = 48
#: Words that search one subtree in one part.
PART = 200_000
_GROUP = np.full(256, LEVELS - 1, np.int64)
for _level, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _level


def count_words(documents: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n: the words of all documents after the deletions."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN % least_letters), F.lit(0)))
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("at"), run.alias("run"))
    rows = rows.select("at", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capital, small)).otherwise(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("at", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = rows.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of each letter group, at most CAP, a row a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    at = np.repeat(np.arange(len(words)), lengths) * LEVELS + _GROUP[flat]
    return np.minimum(np.bincount(at, minlength=len(words) * LEVELS), CAP).reshape(-1, LEVELS)


def packed(counts: np.ndarray) -> np.ndarray:
    """Vectors as longs, the first level in the highest bits, so that a node is a prefix."""
    out = np.zeros(len(counts), np.int64)
    for level in range(LEVELS):
        out = out << 4 | counts[:, level]
    return out


def unpacked(values: np.ndarray) -> np.ndarray:
    return (values[:, None] >> (4 * np.arange(LEVELS - 1, -1, -1))) & CAP


def _moves(first: int, last: int) -> list[tuple[list[int], bool, bool]]:
    """(change of each level, takes a surplus, takes a deficit) for levels first to last - 1."""
    n, out = last - first, []
    for up in range(-1, n):
        for down in range(-1, n):
            if up == down and up >= 0:
                continue
            change = [0] * LEVELS
            if up >= 0:
                change[first + up] = 1
            if down >= 0:
                change[first + down] = -1
            out.append((change, up >= 0, down >= 0))
    return out


def _follow(first: int, last: int):
    """From each word at a node of depth `first`: the nodes of depth `last` that its budget reaches.

    A word at home stays at home in its own child, and visits only later
    children, as those before will visit it.
    """
    moves = _moves(first, last)
    shift = np.int64(4 * (LEVELS - last))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vec, node = frame["vec"].to_numpy(np.int64), frame["node"].to_numpy(np.int64)
            counts, home = unpacked(vec), frame["home"].to_numpy(bool)
            surplus, deficit = frame["surplus"].to_numpy(np.int8), frame["deficit"].to_numpy(np.int8)
            own = node << np.int64(4 * (last - first)) | (vec >> shift) & np.int64((1 << 4 * (last - first)) - 1)
            for change, up, down in moves:
                moved = counts[:, first:last] + np.array(change)[first:last]
                able = ((moved >= 0) & (moved <= CAP)).all(axis=1) & (surplus >= up) & (deficit >= down)
                step = np.int64(sum(c << 4 * (last - 1 - i) for i, c in enumerate(change[:last])))
                to = own + step
                stays = home & (not up and not down)
                take = able & (~home | stays | (to > own))
                if take.any():
                    yield frame[take].assign(node=to[take], home=stays[take], surplus=(surplus - up)[take], deficit=(deficit - down)[take])

    return follow


def near(matrix: np.ndarray, lengths: np.ndarray, other: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether the words of each row (letters padded with 0) differ by exactly one inserted, deleted or replaced letter."""
    swap = lengths < other_lengths
    long_ = np.where(swap[:, None], other, matrix)
    short = np.where(swap[:, None], matrix, other)
    n = np.minimum(lengths, other_lengths)
    same = lengths == other_lengths
    replaced = (matrix != other).sum(axis=1) == 1
    width = matrix.shape[1]
    outside = np.arange(width - 1)[None, :] >= n[:, None]
    lead = np.logical_and.accumulate((long_[:, :-1] == short[:, :-1]) & ~outside, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate(((long_[:, 1:] == short[:, :-1]) | outside)[:, ::-1], axis=1).sum(axis=1) - (width - 1 - n)
    return np.where(same, replaced, (np.abs(lengths - other_lengths) == 1) & (lead + tail >= n))


def near_words(a: str, b: str) -> bool:
    """The same of two words of any length."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    lead = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[lead + 1 :] == (b[lead:] if len(a) > len(b) else b[lead + 1 :])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    raw = b"".join(w[: WIDE + 1].encode("latin-1").ljust(WIDE + 2, b"\0") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), WIDE + 2), lengths


class Subtree:
    """The words of one subtree, sorted by vector: a node at a depth is a range of equal prefixes."""

    def __init__(self, words: list[str], n: np.ndarray, depth: int):
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1]) if len(words) else np.zeros(0, np.int64)
        self.words, self.n, self.depth = [words[i] for i in order], n[order], depth
        self.counts = counts[order].astype(np.int8)
        self.letters, self.lengths = _letters(self.words)

    def search(self, words: list[str], n: np.ndarray, home: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[pd.DataFrame]:
        """The near words of a batch: rows (word, n, near, near_n). Of two words at home here one finds the other."""
        self.q, self.q_n, self.q_home = words, n, home
        self.q_counts = vectors(words).astype(np.int8)
        self.q_letters, self.q_lengths = _letters(words)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        for _ in self._descend(0, len(self.words), self.depth, np.arange(len(words)), surplus.astype(np.int8), deficit.astype(np.int8)):
            if self.size > 300_000:
                yield from self._verified()
        yield from self._verified()

    def _descend(self, low: int, high: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[None]:
        if not len(who):
            return
        if high - low <= LEAF or level == LEVELS:
            for i in range(0, len(who), 4096):
                for j in range(low, high, 256):
                    self._compare(j, min(high, j + 256), level, who[i : i + 4096], surplus[i : i + 4096], deficit[i : i + 4096])
                    yield
            return
        column = self.counts[low:high, level]
        edges = np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), len(column))
        own = self.q_counts[who, level]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            more = column[a] - own  # letters that the words below have more of
            on = (more <= surplus) & (-more <= deficit)
            yield from self._descend(low + a, low + b, level + 1, who[on], (surplus - np.maximum(more, 0))[on], (deficit - np.maximum(-more, 0))[on])

    def _compare(self, low: int, high: int, level: int, who: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        more = np.zeros((len(who), high - low), np.int16)
        less = np.zeros_like(more)
        for k in range(level, LEVELS):
            d = self.counts[None, low:high, k] - self.q_counts[who, k][:, None]
            more += np.maximum(d, 0)
            less += np.maximum(-d, 0)
        close = np.abs(self.lengths[None, low:high] - self.q_lengths[who][:, None]) <= 1
        a, b = np.nonzero((more <= surplus[:, None]) & (less <= deficit[:, None]) & close)
        self.found.append((who[a], low + b))
        self.size += len(a)

    def _verified(self) -> Iterator[pd.DataFrame]:
        a, b = (np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.int64) for k in (0, 1))
        self.found, self.size = [], 0
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), 50_000):
            x, y = a[i : i + 50_000], b[i : i + 50_000]
            ok[i : i + 50_000] = near(self.q_letters[x], self.q_lengths[x], self.letters[y], self.lengths[y])
        for i in np.flatnonzero((self.q_lengths[a] > WIDE) | (self.lengths[b] > WIDE)):
            ok[i] = near_words(self.q[a[i]], self.words[b[i]])
        a, b = a[ok], b[ok]
        one, two = [self.q[i] for i in a.tolist()], [self.words[i] for i in b.tolist()]
        # both at home: each finds the other, the smaller one speaks
        once = ~self.q_home[a] | np.fromiter((x < y for x, y in zip(one, two, strict=True)), bool, len(one))
        if once.any():
            yield pd.DataFrame({"word": one, "n": self.q_n[a], "near": two, "near_n": self.n[b]})[once]


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by unit; in a unit the subtree's words (target) come first, then the words that search it."""
    unit, tree, held = None, None, []
    for frame in frames:
        for key, rows in frame.groupby("unit", sort=False):
            if key != unit:
                unit, tree, held = key, None, []
            targets = rows["target"].to_numpy(bool)
            if targets.any():
                held.append(rows[targets])
            asking = rows[~targets]
            if not len(asking):
                continue
            if tree is None:
                own = pd.concat(held)
                tree, held = Subtree(own["word"].tolist(), own["n"].to_numpy(np.int64), int(own["depth"].iloc[0])), []
            yield from tree.search(asking["word"].tolist(), asking["n"].to_numpy(np.int64), asking["home"].to_numpy(bool), asking["surplus"].to_numpy(), asking["deficit"].to_numpy())


def _add_vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(vec=packed(vectors(frame["word"].tolist())))


def near_pairs(words: DataFrame, limit: int = 20_000) -> DataFrame:
    """word, n, near, near_n: each pair of near words once. words: (word, n), a row a word."""
    spark = words.sparkSession
    state = "word string, n long, vec long, node long, home boolean, surplus int, deficit int"
    frontier = words.mapInPandas(_add_vectors, "word string, n long, vec long").select("*", F.lit(0).cast("long").alias("node"), F.lit(True).alias("home"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    depth, found = 0, None
    while depth < LEVELS:
        last = min(LEVELS, depth + STEP)
        reached = materialize(frontier.mapInPandas(_follow(depth, last), state), "op11-reached")
        # a node exists if a word is at home in it
        nodes = reached.groupBy("node").agg(F.sum(F.col("home").cast("long")).alias("size"), F.count("*").alias("asking")).where("size > 0")
        nodes = materialize(nodes, "op11-nodes")
        full = F.col("size") > (limit if last < LEVELS else 1 << 62)
        ready = reached.join(nodes.where(~full), "node").withColumn("depth", F.lit(last))
        found = ready if found is None else found.union(ready)
        frontier = reached.join(nodes.where(full).select("node"), "node").select("word", "n", "vec", "node", "home", "surplus", "deficit")
        depth = last
        if not nodes.where(full).limit(1).count():
            break
    # a unit: a subtree (or a slice of words of one vector) and a part of the words that search it
    slices, parts = F.ceil(F.col("size") / limit), F.ceil(F.col("asking") / PART)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = [F.concat_ws(" ", "depth", "node", "slice", "part").alias("unit"), "target", "word", "n", "home", "surplus", "deficit", "depth"]
    targets = found.where("home").select("*", F.lit(True).alias("target"), F.pmod(F.xxhash64("word"), slices).alias("slice"), every(parts).alias("part")).select(*columns)
    asking = found.select("*", F.lit(False).alias("target"), F.pmod(F.xxhash64("word", F.lit(1)), parts).alias("part"), every(slices).alias("slice")).select(*columns)
    dealt = targets.union(asking).repartition(partitions(spark), F.xxhash64("unit")).sortWithinPartitions("unit", F.col("target").desc())
    return dealt.mapInPandas(_search, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word with a form along forms to the last, in steps that double. Counts grow along forms, so there is no circle."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "op11-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "op11-roots")
        discard(at)
        at = step.select("word", "root")
        at._logsight_path = step._logsight_path
        if not step.where("moved").limit(1).count():
            return at


def variants(documents: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, limit: int = 20_000) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the documents."""
    words = materialize(count_words(documents, least_letters, least_count), "op11-words")
    pairs = materialize(near_pairs(words, limit), "op11-pairs")
    both = pairs.union(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    grouped = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    grouped = materialize(grouped.select("word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "op11-near")
    ends = roots(grouped.where("form IS NOT NULL"))
    out = words.join(grouped, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
