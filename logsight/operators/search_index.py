"""Phrase search over a positional index of word stems (Q3).

`build` writes one row for each stem of each text with the places where it
stands, in folders by a hash of the stem and sorted by stem in each file, so a
search reads the folders and row groups of the asked stems only. A phrase is a
join of places: its words stand behind each other where the places less the
words' numbers agree. Stems follow Porter's rules; only the different words are
stemmed, by expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight.operators.lineage import settled

# Endings and what takes their place, of the second and third step, and endings of the fourth (beside "ion" after s or t).
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_CONSONANTS, _VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: More than none, exactly one, more than one change from vowels to consonants; a vowel; consonant, vowel, consonant.
SOME = f"^({_CONSONANTS})?{_VOWELS}{_CONSONANTS}"
ONE = f"{SOME}({_VOWELS})?$"
MORE = f"{SOME}{_VOWELS}{_CONSONANTS}"
VOWEL = f"^({_CONSONANTS})?[aeiouy]"
SHORT = f"^{_CONSONANTS}[aeiouy][^aeiouwxy]$"
#: Words that have stems.
PLAIN = "^[a-z]{3,}$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def _less(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - n)


def _replaced(w: Column, endings: dict[str, str], measure: str) -> Column:
    """The longest ending that the word has gives way, if what is left has the measure."""
    out = None
    for end in sorted(endings, key=len, reverse=True):
        left = _less(w, len(end))
        new = F.when(left.rlike(measure), F.concat(left, F.lit(endings[end]))).otherwise(w)
        out = F.when(w.endswith(end), new) if out is None else out.when(w.endswith(end), new)
    return out.otherwise(w)


def with_stems(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Adds each word's stem. Words of small letters; those of fewer than three or with other signs stay as they are."""
    w = F.col("_w")
    steps = [F.when(w.rlike("(ss|i)es$"), _less(w, 2)).when(w.rlike("[^s]s$"), _less(w, 1)).otherwise(w)]
    cut = F.when(w.endswith("ed"), _less(w, 2)).when(w.endswith("ing"), _less(w, 3))
    steps.append(F.when(w.endswith("eed"), F.when(_less(w, 3).rlike(SOME), _less(w, 1)).otherwise(w)).when(cut.rlike(VOWEL), F.concat(cut, F.lit("#"))).otherwise(w))
    # a word that lost an ending is marked, mended and unmarked
    body = F.rtrim(w, F.lit("#"))
    mended = F.when(body.rlike("(at|bl|iz)$"), F.concat(body, F.lit("e"))).when(body.rlike(DOUBLE), _less(body, 1)).when(body.rlike(SHORT), F.concat(body, F.lit("e"))).otherwise(body)
    steps.append(F.when(w.endswith("#"), mended).otherwise(w))
    steps.append(F.when(w.endswith("y") & _less(w, 1).rlike(VOWEL), F.concat(_less(w, 1), F.lit("i"))).otherwise(w))
    steps.append(_replaced(w, SECOND, SOME))
    steps.append(_replaced(w, THIRD, SOME))
    ion = _less(w, 3)
    steps.append(F.when(w.rlike("[st]ion$"), F.when(ion.rlike(MORE), ion).otherwise(w)).otherwise(_replaced(w, dict.fromkeys(FOURTH, ""), MORE)))
    stem = _less(w, 1)
    steps.append(F.when(w.endswith("e") & (stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT))), stem).otherwise(w))
    steps.append(F.when(w.endswith("ll") & _less(w, 1).rlike(MORE), _less(w, 1)).otherwise(w))
    plain = F.col(word).rlike(PLAIN)
    # a first y is a consonant
    rows = words.withColumn("_w", F.when(F.startswith(F.col(word), F.lit("y")), F.concat(F.lit("Y"), F.substr(F.col(word), F.lit(2)))).otherwise(F.col(word)))
    for step in steps:
        rows = rows.withColumn("_w", F.when(plain, step).otherwise(w))
    return rows.withColumn(out, F.when(plain, F.lower("_w")).otherwise(F.col(word))).drop("_w")


def tokens(text: Column) -> Column:
    """The words of a text: runs of letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def build(rows: DataFrame, path: str, key: str = "event_id", text: str = "message", time: str | None = "timestamp_ns", buckets: int = 64, rows_a_file: int = 500_000) -> None:
    """Write the index of the texts: stem, key, time (if there is one) and places, in folders by bucket.

    Files are ranges of (bucket, stem, hash of the key) of about `rows_a_file` rows,
    so a common stem has as many files as it needs and a task sorts no more than one.
    """
    extra = [key, *([time] if time else [])]
    placed = rows.select(*extra, F.posexplode(tokens(F.col(text))).alias("place", "word"))
    placed = settled(placed.groupBy(*extra, "word").agg(F.collect_list("place").alias("places")), "postings")
    parts = -(-placed.count() // rows_a_file) or 1
    # other words are their own stems; written, so that the size is known before the join
    stems = settled(with_stems(placed.select("word").where(F.col("word").rlike(PLAIN)).distinct()), "stems")
    stemmed = placed.join(stems, "word", "left").withColumn("stem", F.coalesce("stem", "word"))
    # one row a stem and text, with the places of all words of the stem
    each = stemmed.groupBy("stem", *extra).agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    dealt = each.withColumn("bucket", _bucket(F.col("stem"), buckets)).repartitionByRange(parts, "bucket", "stem", F.xxhash64(key)).sortWithinPartitions("bucket", "stem")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def asked_stems(spark: SparkSession, phrase: str, most: int = 256) -> list[str]:
    """The stems of a phrase, in order."""
    clean = "".join(c for c in phrase if c.isprintable() and c not in "\"'").strip()[:most].lower()
    found = re.findall(r"[^\W_]+", clean)
    if not found:
        return []
    rows = with_stems(spark.createDataFrame(list(enumerate(found)), "place int, word string")).collect()  # at most 256 letters
    return [r.stem for r in sorted(rows, key=lambda r: r.place)]


def _postings(spark: SparkSession, path: str, stems: Sequence[str], buckets: int) -> DataFrame:
    own = spark.range(1).select(F.array(*(_bucket(F.lit(s), buckets) for s in stems)).alias("b")).first().b
    return spark.read.parquet(path).where(F.col("bucket").isin(sorted(set(own))) & F.col("stem").isin(sorted(set(stems))))


def phrase_hits(spark: SparkSession, path: str, phrase: str, key: str = "event_id", extra: Sequence[str] = ("timestamp_ns",), buckets: int = 64) -> DataFrame:
    """key and the columns in `extra` of the texts in which the phrase's stems stand behind each other (Q3); none for a phrase without words."""
    stems = asked_stems(spark, phrase)
    rows = _postings(spark, path, stems or [""], buckets)
    numbers = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate(stems or [""])))
    placed = rows.select(key, *extra, "stem", F.explode("places").alias("place"))
    begun = placed.select(key, *extra, "place", F.explode(F.filter(numbers, lambda n: n["s"] == F.col("stem"))).alias("n")).select(key, *extra, (F.col("place") - F.col("n.i")).alias("begin"), "n.i")
    return begun.groupBy(key, *extra, "begin").agg(F.count("*").alias("n")).where(F.col("n") == max(1, len(stems))).select(key, *extra).distinct()


def word_hits(spark: SparkSession, path: str, words: str, key: str = "event_id", extra: Sequence[str] = ("timestamp_ns",), buckets: int = 64) -> DataFrame:
    """The same of the texts that have all the stems somewhere (Q3, the other form)."""
    stems = sorted(set(asked_stems(spark, words)))
    rows = _postings(spark, path, stems or [""], buckets)
    return rows.groupBy(key, *extra).agg(F.count("*").alias("n")).where(F.col("n") == max(1, len(stems))).select(key, *extra)
