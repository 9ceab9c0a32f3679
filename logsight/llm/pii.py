r"""Personal data: patterns propose, checks confirm, words nearby weigh.

Kinds email, ip, card, phone, and iban, which this method adds. A pattern's
matches are taken leftmost and without overlap; a match that fails its check
(parts of at most 255, Luhn, 9 to 15 digits, mod 97) is dropped. An iban may
begin at each word of two capitals and two digits; of the ends of words within
34 signs the last that passes mod 97 is taken, so that capitalised words and
numbers behind it do not hide it. Each span has
a score: a base by kind, raised if one of the kind's words stands among the
`near` characters before it. Scores drop no span here: they come with the spans,
and `mask` takes a floor.

Everything is Spark SQL expressions. The places of the matches come from
cutting the text at the matches: the lengths of the cuts and matches before add
up, by doubling. What stands before a span, and what is kept in masking, is read
from blocks of the text. So the time grows with n log n in a text's length and
number of spans. Positions are code points, ends exclusive.

The patterns are written with possessive repeats, and where a match could begin
inside a run that has failed already, with a test that it begins the run or the
rest after a match (`\G`). They match what the plain patterns do, in linear
time on very long texts; runs of fewer than 12 digits, which fail as cards
wherever they begin, are passed over. The pattern of iban matches the first four signs and
has the run of at most 34 signs as its group, with one sign more if that goes
on the last word.

Cases: null and empty texts have no spans; a null doc_id is kept; repeated rows
each give a row; spans that begin together go in the order of KINDS. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _number_list(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x: x.cast("int"))


def luhn(digits: Column) -> Column:
    """True if a text of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    odd = lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)
    return F.aggregate(F.transform(F.reverse(_number_list(digits)), odd), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account code passes the mod-97 check: four signs moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4))
    step = lambda r, c: F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    guard: str  # a text without a match of this has none of the pattern either
    pattern: str
    score: float
    words: tuple[str, ...]

    def check(self, match: Column) -> Column:
        if self.name == "ip":
            return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
        if self.name == "card":
            return F.length(_digits(match)).between(12, 19) & luhn(_digits(match))
        if self.name == "phone":
            return F.length(_digits(match)).between(9, 15)
        if self.name == "iban":
            code = F.replace(match, F.lit(" "), F.lit(""))
            return F.length(code).between(15, 34) & ~F.rlike(code, F.lit("[a-z]")) & mod97(code)
        return F.lit(True)


#: The kinds in the order that breaks ties, with their patterns and nearby words.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, ("mail", "contact", "write", "address")),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.6, ("ip", "host", "server", "address", "login")),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9]){11,}+", 0.7, ("card", "visa", "credit", "payment", "number")),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank", "transfer")),
)
BASE = ("email", "ip", "card", "phone")
#: Code points of a block of text; it bounds the work for one span, no result.
_BLOCK = 256
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,match:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, combine) -> Column:
    """combine (of numbers from 0 on) over all elements up to each, by doubling.

    That takes n log n steps. A fold whose state holds a growing array would
    copy it in each step.
    """

    def doubled(sums: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        moved = F.concat(F.array_repeat(F.lit(0), step), F.slice(sums, F.lit(1), F.size(sums) - step))
        return F.zip_with(sums, moved, combine)

    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")
    # no round for fewer than two numbers
    return F.aggregate(F.slice(F.sequence(F.lit(0), rounds), F.lit(1), rounds), numbers, doubled)


def _apart(spans: Column, kind: str) -> Column:
    """Leftmost spans without overlap, from spans by start; only spans in a chain of overlaps are folded."""
    none = F.array().cast(f"array<{kind}>")

    def fold(chain: Column) -> Column:
        def add(kept: Column, s: Column) -> Column:
            return F.when(s["start"] >= F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)), F.concat(kept, F.array(s))).otherwise(kept)

        return F.when(F.size(chain) == 1, chain).otherwise(F.aggregate(chain, none, add))

    def chains(spans: Column, reached: Column) -> Column:
        # where no span before reaches beyond the start
        firsts = F.filter(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == 1) | (F.get(spans, i - 1)["start"] >= F.get(reached, i - 2)))
        return _let(firsts, lambda f: F.flatten(F.zip_with(f, F.slice(f, F.lit(2), F.size(f)), lambda i, j: fold(F.slice(spans, i, F.coalesce(j, F.size(spans) + 1) - i)))))

    def apart(spans: Column) -> Column:
        reached = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return F.when(F.size(spans) < 2, spans).otherwise(_let(reached, lambda r: chains(spans, r)))

    return _let(spans, apart)


def _ibans(text: Column, kind: Kind, heads: Column) -> Column:
    """Spans of ibans from those of their first four signs: the longest end that passes, then leftmost without overlap."""
    runs = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))

    def longest(head: Column, run: Column) -> Column:
        words = F.split(run, " ")
        ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
        match = F.get(F.filter(ends, kind.check), F.lit(0))
        return F.struct(head["start"].alias("start"), (head["start"] + F.length(match)).alias("end"), match.alias("match"))

    passed = F.filter(F.zip_with(heads, runs, longest), lambda s: s["match"].isNotNull())
    return _apart(passed, "struct<start:int,end:int,match:string>")


def _proposed(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of one kind that pass their check."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def placed(matches: Column) -> Column:
        cuts = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
        ends = _running(F.zip_with(cuts, matches, lambda c, m: F.length(c) + F.length(m)), lambda a, b: a + b)
        return F.zip_with(ends, matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")))

    spans = _let(matches, placed)
    spans = _ibans(text, kind, spans) if kind.name == "iban" else F.filter(spans, lambda s: kind.check(s["match"]))
    full = F.transform(spans, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind.name).alias("kind"), s["match"]))
    there = F.contains(text, F.lit(kind.guard)) if len(kind.guard) == 1 else F.rlike(text, F.lit(kind.guard))
    return F.when(there, full.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _blocks(text: Column) -> Column:
    """The text in blocks of `_BLOCK` code points, from which `_part` reads without passing over all that lies before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _part(blocks: Column, start: Column, size: Column) -> Column:
    """The `size` code points from `start` on; a size beyond the end gives all that is left."""
    first = F.floor(start / _BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, F.floor((start + size) / _BLOCK).cast("int") - first + 1), "")
    return F.substr(joined, start - first * _BLOCK + 1, size)


def _score(blocks: Column, span: Column, near: int) -> Column:
    size = F.least(span["start"], F.lit(near))
    before = F.lower(_part(blocks, span["start"] - size, size))

    def weigh(before: Column) -> Column:
        out = F.lit(0.0)
        for kind in KINDS:
            said = F.rlike(before, F.lit(r"\b(?:" + "|".join(kind.words) + ")"))
            out = F.when(span["kind"] == kind.name, F.lit(kind.score) + F.when(said, 0.1).otherwise(0.0)).otherwise(out)
        return out

    return _let(before, weigh)


def find_spans(documents: DataFrame, text_col: str = "text", near: int = 40) -> DataFrame:
    """Adds `pii`: an array of (start, end, kind, match, score) by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array_sort(F.concat(*(_proposed(text, k, i) for i, k in enumerate(KINDS))))

    def scored(spans: Column) -> Column:
        # blocks are made only for a text that has spans
        blocks = F.when(F.size(spans) > 0, _blocks(text))
        return _let(blocks, lambda b: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], _score(b, s, near).alias("score"))))

    return documents.withColumn("pii", _let(found, scored))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, and scores (hundredths, in the order of spans), from the output of `find_spans`."""
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("pii", lambda s: s["kind"])
    counts = [F.size(kinds).cast("long") - F.size(F.array_remove(kinds, k)).cast("long") for k in BASE]
    counts = [c.alias(f"n_{k}") for c, k in zip(counts, BASE, strict=True)]
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), scores.alias("scores"))


def mask(documents: DataFrame, text_col: str = "text", floor: float = 0.0) -> DataFrame:
    """The text with each span of at least `floor` replaced by its kind in angle brackets; overlapping spans: the earlier goes first."""
    found = find_spans(documents, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = _apart(F.filter("pii", lambda s: s["score"] >= floor), "struct<start:int,end:int,kind:string,match:string,score:double>")

    def joined(spans: Column, blocks: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        # the text before each span, from the end of the one before, and the rest
        kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.transform(spans, lambda s: s["start"]), lambda at, to: _part(blocks, at, F.coalesce(to, F.length(text)) - at))
        kinds = F.transform(spans, lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.array_join(F.zip_with(kept, kinds, lambda part, kind: F.concat(part, F.coalesce(kind, F.lit("")))), "")

    masked = _let(spans, lambda s: _let(_blocks(text), lambda b: joined(s, b)))
    return found.withColumn(text_col, F.when(F.size("pii") > 0, masked).otherwise(F.col(text_col)))
