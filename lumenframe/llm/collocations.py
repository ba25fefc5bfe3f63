"""Phrase collocations by stripes: a prefix keys a counter of what follows it.

The empty prefix keys the counter of words. A word keys the counter of its extensions by one word
and by two; in it stand the counts of its phrases, the totals of the prefixes of two words, and,
as the largest of the entries that go on from a phrase, what can subsume it. Tasks build stripes
from chunks of text, and stripes with the same key are added element by element after one shuffle.
The stripe of a frequent word is dealt out by a hash of the next word.

Stripes of two words come first. A phrase of three words occurs as often as ``least`` only if both
of its pairs do; those pairs set bits of a bounded map, and a phrase with a pair whose bit is not
set is not put into a stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from lumenframe.llm.tables import written

CHUNK = 4_000_000       # bytes of text counted at once: their distinct words number under 2^21, three of them fit 63 bits
PIECES = 8_192          # a stripe holds about 1 / PIECES of all words; words with more are dealt out, PIECES of them at most
SALTS = 64              # parts of a language that are cut to the best phrases before they meet
BREAK = b"."
MAP_BITS = (1 << 20, 1 << 28)   # least and most bits of the map of pairs: 32 MB at most
BITS_A_PAIR = 16
PAIR_FACTOR = 1_000_003
CLEAN = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray, int]]:
    """(lang, words and breaks of CHUNK bytes of text, how many at its start belong to the chunk before).

    A long text is cut at spaces; its next chunk repeats the last two words, so phrases count with their last word.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def split(lang: str) -> Iterator[tuple[str, pa.DictionaryArray, int]]:
        text = b" . ".join(held.pop(lang))
        sizes.pop(lang)
        at, before = 0, []
        while at < len(text):
            end = len(text) if len(text) - at <= CHUNK else text.find(b" ", at + CHUNK)
            end = len(text) if end < 0 else end
            tokens = before + text[at:end].split()
            yield lang, pa.array(tokens, pa.binary()).dictionary_encode(), len(before)
            at, before = end, tokens[-2:]

    for batch in batches:
        texts, langs = batch.column(1).cast(pa.binary()), batch.column(0).to_pylist()
        for i, lang in enumerate(langs):
            clean = texts[i].as_py().lower().translate(CLEAN).replace(BREAK, b" . ")
            held.setdefault(lang, []).append(clean)
            sizes[lang] = sizes.get(lang, 0) + len(clean) + 3
            if sizes[lang] >= CHUNK:
                yield from split(lang)
            elif sum(sizes.values()) >= 2 * CHUNK:
                yield from split(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from split(lang)


def coded(tokens: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each token, whether it is a word, words by number)."""
    ids, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
    a_break = pc.index(words, pa.scalar(BREAK, pa.binary())).as_py()
    return ids, ids != a_break, words


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): the stripe of the empty prefix, a part for each chunk."""
    for lang, tokens, before in chunks(batches):
        ids, is_word, words = coded(tokens)
        n = np.bincount(ids[before:][is_word[before:]], minlength=len(words))
        found = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "word": words.take(pa.array(found)).cast(pa.string()), "n": pa.array(n[found])})


def pairs_at(is_word: np.ndarray) -> np.ndarray:
    """Where a word follows a word."""
    return is_word[:-1] & is_word[1:]


def set_in(bits: np.ndarray, ids: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Whether the bit of each pair of neighbours is set."""
    sums = np.array([zlib.crc32(w) for w in names], np.int64)
    at = (sums[ids[:-1]] * PAIR_FACTOR + sums[ids[1:]]) % (8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def pair_map(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit for each (w1, w2) of the table, packed into bytes."""
    at = F.pmod(F.crc32(F.encode("w1", "UTF-8")) * PAIR_FACTOR + F.crc32(F.encode("w2", "UTF-8")), F.lit(bits)) + 1
    parts = pairs.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # 4 KB each, bits / 32,768 of them at most
        out[(row.no - 1) * 4_096:row.no * 4_096] = np.frombuffer(row.bits, np.uint8)[:bits // 8]
    return out


def stripes_of(hot: dict[tuple[str, bytes], int], bits: np.ndarray | None = None):
    """A function from batches of (lang, text) to stripes (lang, prefix, part, next, n).

    They hold extensions by one word; by two words where a map of pairs is given. ``hot`` says in how many parts a prefix is dealt.
    """

    def extensions(ids: np.ndarray, is_word: np.ndarray, before: int, names: list[bytes]) -> tuple[np.ndarray, ...]:
        """(first, second, third if any, count) of the phrases that end after ``before``."""
        v, here = len(names), pairs_at(is_word)
        key = ids[:-1] * v + ids[1:]
        if bits is not None:
            here &= set_in(bits, ids, names)
            here, key = here[:-1] & here[1:], key[:-1] * v + ids[2:]
            here[:max(before - 2, 0)] = False
        else:
            here[:max(before - 1, 0)] = False
        key, n = np.unique(key[here], return_counts=True)
        return (key // v, key % v, n) if bits is None else (key // (v * v), key // v % v, key % v, n)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens, before in chunks(batches):
            ids, is_word, words = coded(tokens)
            if len(ids) < 3 - (bits is None):
                continue
            names = words.to_pylist()
            first, second, *third, n = extensions(ids, is_word, before, names)
            if not len(first):
                continue
            parts = np.array([hot.get((lang, w), 1) for w in names])[first]
            part = np.zeros(len(first), np.int64)
            dealt = np.flatnonzero(parts > 1)
            part[dealt] = pd.util.hash_array(np.array(names, object))[second[dealt]] % parts[dealt].astype(np.uint64)
            order = np.lexsort((part, first))
            first, second, n, part = first[order], second[order], n[order], part[order]
            text = words.cast(pa.string())
            after = text.take(pa.array(second))
            if third:
                after = pc.binary_join_element_wise(after, text.take(pa.array(third[0][order])), " ")
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (part[1:] != part[:-1])]))
            offsets = pa.array(np.append(starts, len(first)).astype(np.int32))
            yield pa.record_batch({
                "lang": pa.array([lang] * len(starts), pa.string()), "prefix": text.take(pa.array(first[starts])), "part": pa.array(part[starts].astype(np.int32)),
                "next": pa.ListArray.from_arrays(offsets, after), "n": pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))})

    return build


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding, for counts under 10^16."""
    whole = [c.cast("decimal(16,0)") for c in (a, left, right)]
    up = (whole[0] * whole[0]).cast("decimal(33,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.floor(F.call_function("div", up, (whole[1] * whole[2]).cast("decimal(33,0)"))).cast("long")


def collocations(table: DataFrame, least: int = 10, subsumed: int = 50, top: int = 2_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two and three words in each language.

    Texts are lower-cased in A-Z and cut into pieces at . , ; : ! ? and line ends, pieces into words
    at spaces and tabs. A phrase that occurs ``least`` times or more scores floor(10^6 a^2 / (l r))
    at the cut into two parts where that is lowest (ties: the first cut); a, l and r are the counts
    of phrase and parts, n that of all words. A phrase inside a longer one with at least
    ``subsumed`` percent of its count is dropped. Ranks go by score and a, both falling, then by
    the bytes of the phrase, so there are no ties. Null and empty texts hold no words; a null
    language is "und"; repeated rows count each; long texts are read whole. Other columns are left
    out; an empty table gives no rows.
    """
    spark = table.sparkSession
    texts = table.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    words = texts.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    # At most PIECES rows: each has that share of all words.
    hot = frequent.where(F.col("n") >= max(total / PIECES, 1))
    dealt = spark.sparkContext.broadcast({(r.lang, r.word.encode()): -(-r.n * PIECES // total) for r in hot.collect()})

    def merged(dealt_map) -> DataFrame:
        """Phrases with ``least`` occurrences or more, from stripes added element by element."""
        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return stripes_of(dealt.value, dealt_map and dealt_map.value)(batches)

        stripes = texts.mapInArrow(build, "lang string, prefix string, part int, next array<string>, n array<int>")
        entries = stripes.repartition("lang", "prefix", "part").select("lang", "prefix", "part", F.inline(F.arrays_zip("next", "n")))
        return entries.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("a")).where(F.col("a") >= least)

    two = written(merged(None).select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), "a"), "stripes-two")
    bits = min(max(MAP_BITS[0], 1 << (BITS_A_PAIR * two.count()).bit_length()), MAP_BITS[1])
    shared = spark.sparkContext.broadcast(pair_map(two, bits))
    after = F.split("next", " ")
    three = written(merged(shared).select("lang", F.col("prefix").alias("w1"), after[0].alias("w2"), after[1].alias("w3"), "a"), "stripes-three")

    def with_count(df: DataFrame, word: str, name: str) -> DataFrame:
        """The count of a column's words; frequent ones come by broadcast, so that none gathers its rows in one task."""
        counts = frequent.select("lang", F.col("word").alias(word), F.col("n").alias(name))
        is_hot = F.col(name) >= max(total / PIECES, 1)
        listed = F.broadcast(counts.where(is_hot))
        return df.join(listed, ["lang", word]).unionByName(df.join(F.broadcast(counts.where(is_hot).select("lang", word)), ["lang", word], "left_anti").join(counts.where(~is_hot), ["lang", word]))

    longest = three.select("lang", "w1", "w2", "a").union(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = longest.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = written(with_count(with_count(two, "w1", "f1"), "w2", "f2"), "pairs")
    alone = pairs.join(longest, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < subsumed * F.col("a"), F.lit(True)))
    shorter = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    ends = three.join(pairs.select("lang", "w1", "w2", "f1", F.col("a").alias("f12")), ["lang", "w1", "w2"]).join(
        pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3")), ["lang", "w2", "w3"])
    cuts = ends.withColumn("s1", score(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", score(F.col("a"), F.col("f12"), F.col("f3")))
    early = F.col("s1") <= F.col("s2")
    longer = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = shorter.union(longer).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
