"""Collocations: phrases that occur more often together than their parts would by chance.

Counting makes one stream of (lang, phrase, count) for each order, one to `LONGEST` words, of all phrases that
occur `LEAST` times or more. A phrase is never more frequent than its parts, so the words are counted first,
then the pairs of frequent words (as hashes), then phrases of frequent pairs. What is frequent is known to the
tasks as a bit filter of at most `FILTER_BITS` bits, which may let a rare phrase through but never holds back
a frequent one; the counts themselves are exact.

The streams are then merge-joined in lockstep, each order with the one below. In prefix order a phrase meets
the phrase without its last word and takes over the counts of all its beginnings; in suffix order it meets
the phrase without its first word and takes over those of all its endings. The same joins tell a phrase its
most frequent extension on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayfold.llm.common import documents, importable, released, slices, text_buffers, written
from dayfold.llm.phrases import BYTE_CODES, range_hashes
from dayfold.llm.syncmers import mixed

LEAST = 100
LONGEST = 5
#: A phrase goes if an extension has this share (in hundredths) of its occurrences.
SHARE = 100
FIRST = 2000
#: Bytes of text that a worker holds as words at a time.
STEP_BYTES = 6_000_000
FILTER_BITS = 1 << 26
#: Bits that Spark's bitmap functions put into one row.
ROW_BITS = 32768
BLANK = np.isin(np.arange(256), [0x20, 0x09])
BREAK = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
PAIRED = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words of some texts: distinct (language, word) units, and the texts as numbers of units."""

    lang: pa.Array       # of each distinct unit
    word: pa.Array
    code: np.ndarray     # its hash
    at: np.ndarray       # unit of each word, in text order
    joined: np.ndarray   # the next word stands in the same piece


def words_of(text: pa.Array, lang: pa.Array) -> Words:
    flat, offsets = text_buffers(text)
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    inside = ~(BLANK[flat] | BREAK[flat])
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    pieces = np.cumsum(BREAK[flat])[begin] if len(begin) else begin
    texts = np.searchsorted(offsets, begin, side="right") - 1
    joined = np.zeros(len(begin), bool)
    joined[:-1] = (pieces[1:] == pieces[:-1]) & (texts[1:] == texts[:-1])
    bounds = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(flat[inside])).dictionary_encode()
    langs = lang.dictionary_encode()
    of_text = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = max(1, len(words.dictionary))
    units, at = np.unique(of_text[texts] * kinds + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    spelled, bounds = text_buffers(words.dictionary)
    code = range_hashes(BYTE_CODES[spelled], bounds[:-1], bounds[1:])
    salt = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
    which, what = units // kinds, units % kinds
    return Words(langs.dictionary.take(pa.array(which)), words.dictionary.take(pa.array(what)), mixed(code[what] + salt[which]) if len(units) else code, at, joined)


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of units."""
    return mixed(first * PAIRED + second)


class Filter(NamedTuple):
    bits: np.ndarray

    def __contains__(self, code: int) -> bool:
        return bool(self.has(np.array([code], np.uint64))[0])

    def has(self, code: np.ndarray) -> np.ndarray:
        found = np.ones(len(code), bool)
        for place in (code, code >> np.uint64(32)):
            place = place & np.uint64(8 * len(self.bits) - 1)
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bit_filter(rows: DataFrame) -> Filter:
    """The codes (column `code`) as a bit filter: two bits each, 16 bits a row, `FILTER_BITS` (8 MB) at most."""
    size = ROW_BITS
    n = rows.count()
    while size < min(16 * n, FILTER_BITS):
        size *= 2
    code = F.col("code")
    two = [x.bitwiseAND(F.lit(size - 1)) + 1 for x in (code, F.shiftrightunsigned(code, 32))]
    places = rows.select(F.explode(F.array(*two)).alias("place"))
    made = places.groupBy(F.bitmap_bucket_number("place").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in made.collect():  # FILTER_BITS / ROW_BITS rows of 4 KB at most
        bits[(r.row - 1) * ROW_BITS // 8:r.row * ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return Filter(bits)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        for i, j in slices(np.diff(offsets), STEP_BYTES):
            part = batch.slice(i, j - i)
            yield words_of(part.column("text"), part.column("lang"))


def _rows(lang: pa.Array, phrase: pa.Array, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "phrase", "code", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts; a null phrase carries the number of all words of its language."""
    for w in _batches(batches):
        n = np.bincount(w.at, minlength=len(w.code))
        yield _rows(w.lang, w.word, w.code, n)
        for lang, total in pa.table({"lang": w.lang, "n": n}).group_by("lang").aggregate([("n", "sum")]).select(["lang", "n_sum"]).to_pandas().itertuples(index=False):
            yield _rows(pa.array([lang]), pa.nulls(1, pa.string()), np.zeros(1, np.uint64), np.array([total]))


def _count_pairs(words: Filter):
    """Pairs of frequent words, as hashes: equal pairs have equal hashes, so a frequent pair has a frequent hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(batches):
            frequent = words.has(w.code)[w.at]
            i = np.flatnonzero(w.joined[:-1] & frequent[:-1] & frequent[1:])
            codes, n = np.unique(paired(w.code[w.at[i]], w.code[w.at[i + 1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    return run


def _count_longer(words: Filter, pairs: Filter, longest: int):
    """Phrases of two words and more whose neighbouring words are all frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _batches(batches):
            kinds = len(w.code)
            frequent = words.has(w.code)[w.at]
            i = np.flatnonzero(w.joined[:-1] & frequent[:-1] & frequent[1:])
            good = np.zeros(len(w.at) + longest, bool)
            good[i] = pairs.has(paired(w.code[w.at[i]], w.code[w.at[i + 1]]))
            i = np.arange(len(w.at))
            number, members = w.at, [np.arange(kinds)]  # the words of each phrase
            for k in range(2, longest + 1):
                on = good[i + k - 2]
                i, number = i[on], number[on]
                if not len(i):
                    break
                keys, number, n = np.unique(number * kinds + w.at[i + k - 1], return_inverse=True, return_counts=True)
                members = [m[keys // kinds] for m in members] + [keys % kinds]
                phrase = pc.binary_join_element_wise(*(w.word.take(pa.array(m)) for m in members), " ")
                yield _rows(w.lang.take(pa.array(members[0])), phrase, np.zeros(len(keys), np.uint64), n)

    return run


def _totals(rows: DataFrame, run, least: int, by: str = "lang, phrase, code") -> DataFrame:
    kinds = {"lang": "string", "phrase": "string", "code": "long"}
    keys = by.split(", ")
    counted = rows.mapInArrow(released(run), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long").groupBy(*keys).agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | (F.col("phrase").isNull() if "phrase" in keys else F.lit(False)))


def count_streams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, words array, f) of all phrases of up to `longest` words with f >= least, (lang, n))."""
    importable(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = written(_totals(rows, _count_words, least), "words")
    single = words.where("phrase is not null")
    frequent = bit_filter(single)
    pairs = written(_totals(rows, _count_pairs(frequent), least, "code"), "pairs")
    longer = written(_totals(rows, _count_longer(frequent, bit_filter(pairs), longest), least), "phrases")
    streams = single.union(longer).select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("f"))
    return streams, words.where("phrase is null").select("lang", "n")


def _lockstep(streams: DataFrame, longest: int, without: Column, parts: str) -> DataFrame:
    """(lang, words, f, parts, extension), all orders; `without` is the phrase less its outer word.

    `parts` gets the counts of the phrases that remain when outer words are taken away, shortest first;
    `extension` is the count of the most frequent phrase with one more word on that side.
    """
    def order(k: int) -> DataFrame:
        return streams.where(F.size("words") == k)

    below = order(1).withColumn(parts, F.array().cast("array<long>"))
    done = below.withColumn("rest", F.lit(None).cast("array<string>"))
    for k in range(2, longest + 1):
        shorter = below.select("lang", F.col("words").alias("rest"), F.col("f").alias("rest_f"), F.col(parts).alias("rest_parts"))
        met = order(k).withColumn("rest", without).join(shorter.hint("merge"), ["lang", "rest"])
        below = written(met.select("lang", "words", "f", F.concat("rest_parts", F.array("rest_f")).alias(parts), "rest"), "stream")
        done = done.union(below)
    # a rest has one word less than its phrase, so orders do not mix
    longest_of = done.where("rest is not null").groupBy("lang", F.col("rest").alias("words")).agg(F.max("f").alias("extension"))
    extended = done.drop("rest").join(longest_of.hint("merge"), ["lang", "words"], "left")
    return written(extended.select("lang", "words", "f", parts, "extension"), "extended")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more with a >= `least` that no longer one replaces.

    Score is floor(1000 a n / (l r)) at the phrase's lowest-scoring cut (of equals the one after fewest words),
    exact in decimals of 38 digits. A null text is empty, a null language is `und`; empty texts and texts
    without words add nothing. Repeated rows count as often as they stand there, whatever their ids; very long
    texts are one text like any other. Other columns are ignored. An empty table gives no row.
    """
    streams, totals = count_streams(docs, least, longest, text_col, lang_col)
    size = F.size("words")
    begins = _lockstep(streams, longest, F.slice("words", 1, size - 1), "lefts")
    ends = _lockstep(streams, longest, F.slice("words", 2, size - 1), "rights").select("lang", "words", "rights", F.col("extension").alias("extension_left"))
    both = begins.where(size > 1).join(ends.where(size > 1).hint("merge"), ["lang", "words"])
    longer = F.greatest("extension", "extension_left")  # the greater one, or the one that is there
    both = both.where(longer.isNull() | (100 * longer < share * F.col("f"))).join(totals, "lang")
    a, n = F.col("f").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")

    def cut(left: Column, i: Column) -> Column:
        right = F.element_at("rights", (size - 1 - i).cast("int"))  # the rest of size - 1 - i words
        score = F.call_function("div", F.lit(1000).cast("decimal(38,0)") * a * n, left.cast("decimal(38,0)") * right.cast("decimal(38,0)"))
        return F.struct(score.alias("score"), i.alias("i"), left.alias("l"), right.alias("r"))

    best = both.withColumn("cut", F.array_min(F.transform("lefts", cut)))
    return best.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def first_of_each(found: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language with their rank; tasks keep no more than `first` each before they are shuffled."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language, by score; see `collocations`."""
    return first_of_each(collocations(documents(spark, sf_dir)))


# `letters` spells the 26 letters for translate(): only A to Z are lowered.
OP12_ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM lists, range(1, 6) AS ks(k), unnest(range(1, len(w) - k + 2)) AS starts(i)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2
), gone AS (
  SELECT DISTINCT c.lang, c.phrase
  FROM candidates c JOIN candidates x ON x.lang = c.lang AND x.k > c.k AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.f >= 100 * c.f
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM best ANTI JOIN gone USING (lang, phrase) WHERE place = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""
