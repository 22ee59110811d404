"""Phrases whose words keep company, by vertical lists of positions.

A block of texts numbers its words and its places. For each phrase it has the
sorted list of places where the phrase begins; all lists of one length are kept
together, ordered by place, so that one merge-join extends all of them: a phrase
of k words at p goes on to k + 1 words if a frequent phrase of k words (for one
word: a frequent word) begins at p + 1. The lengths of a phrase's lists, summed
over blocks, are its exact frequency.

Only sums move between machines. What is frequent comes back to the blocks as a
bitmap of fixed size, addressed by hash: it rules out most of what cannot be
frequent and decides nothing, since every phrase that is left is counted again by
its words.

Words are told by 64-bit hashes inside blocks. A hash that a frequent word shares
with any other word is found when words are counted; then all start again with
another seed.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, raw

#: Bytes of text in a block; bits of the address in a bitmap (8 MB at 26).
BLOCK, BITS = 8 << 20, 26
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes.maketrans(SEPARATORS, b"\n" * len(SEPARATORS))
_TOKEN = re.compile(rb"\n|[^ \t\n]+")
UNKNOWN = "und"
_U = np.uint64


class _Numbers(dict):
    """Numbers things from ``first`` on as they come."""

    def __init__(self, first: int):
        super().__init__({b"\n": 0})
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.first + len(self) - 1
        return n


def number(langs: list[str | None], texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[str, list[bytes]]]]:
    """The words of some texts as numbers from 1 on, 0 between pieces, and for
    each language its words in the order of their numbers."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        if text:
            by_lang.setdefault(UNKNOWN if lang is None else lang, []).append(text)
    parts, vocabulary, first = [np.zeros(1, np.int32)], [], 1
    for lang, held in by_lang.items():
        known = _Numbers(first)
        for text in held:
            parts.append(np.array([known[w] for w in _TOKEN.findall(text.lower().translate(_CUT))] + [0], np.int32))
        first += len(known) - 1
        vocabulary.append((lang, list(known)[1:]))
    return np.concatenate(parts), vocabulary


STATE = "places binary, words array<struct<lang:string,words:binary>>"


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each block of texts of some ``size`` bytes: its numbered places
    and its words, packed."""

    def run(columns: list[list]) -> list:
        places, vocabulary = number(*columns)
        pack = zstandard.ZstdCompressor(level=1).compress
        return [[pack(places.tobytes())], [[{"lang": lang, "words": pack(b"\n".join(words))} for lang, words in vocabulary]]]

    return map_rows(docs.select("lang", raw("text").alias("t")), run, STATE, step=1 << 20, size=size)


def _unpacked(places: bytes, words: list[dict]) -> tuple[np.ndarray, list[tuple[str, list[bytes]]]]:
    unpack = zstandard.ZstdDecompressor().decompress
    cut = [(w["lang"], unpack(w["words"])) for w in words]
    return np.frombuffer(unpack(places), np.int32), [(lang, joined.split(b"\n") if joined else []) for lang, joined in cut]


def word_counts(state: DataFrame) -> DataFrame:
    """``lang, word, n``; a null word has its language's total."""

    def run(columns: list[list]) -> list:
        langs, found, counts = [], [], []
        for places, words in zip(*columns):
            places, vocabulary = _unpacked(places, words)
            n, first = np.bincount(places, minlength=1), 1
            for lang, mine in vocabulary:
                own = n[first : first + len(mine)]
                langs += [lang] * (len(mine) + 1)
                found += [*(w.decode() for w in mine), None]
                counts.append(np.r_[own, own.sum()])
                first += len(mine)
        return [langs, found, np.concatenate(counts) if counts else []]

    return map_rows(state, run, "lang string, word string, n long", step=1).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def named(word: str, lang: str, seed: int) -> Column:
    """The 64-bit name of a language's word."""
    return F.xxhash64(F.lit(str(seed)), F.col(lang), F.col(word))


def names_of(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """The same here: each value's hash is the seed of the next."""
    base = xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(str(seed).encode(), 42))
    return np.fromiter((xxhash.xxh64_intdigest(w, base) for w in words), _U, len(words))


def _address(names: list[np.ndarray]) -> np.ndarray:
    """Where a phrase of words with these names is in a bitmap."""
    h = np.zeros(len(names[0]), _U)
    for n in names:
        h = (h ^ n) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return h


def _bitmap(phrases: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """A bitmap of the given phrases: ``2 ** bits`` bits, however many there are."""

    def run(parts: list[list]) -> list:
        at = _address([np.array(c, np.int64).view(_U) for c in parts]) >> _U(64 - bits)
        slots, where = np.unique(at >> _U(6), return_inverse=True)
        held = np.zeros(len(slots), _U)
        np.bitwise_or.at(held, where, _U(1) << (at & _U(63)))
        return [slots.view(np.int64), held.view(np.int64)]

    set_bits = map_rows(phrases.select(*columns), run, "slot long, held long", step=1 << 16).groupBy("slot").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_bits.column("slot").to_numpy()] = set_bits.column("held").to_numpy()
    return out.view(_U)


def _set(bitmap: np.ndarray, address: np.ndarray, bits: int) -> np.ndarray:
    at = address >> _U(64 - bits)
    return (bitmap[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)


def extended(places: np.ndarray, names: np.ndarray, frequent: list[np.ndarray], length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of each phrase of ``length`` words whose shorter
    phrases may all be frequent, a row a phrase, and how long its list is.
    ``frequent`` has a bitmap for each shorter length."""
    at = np.flatnonzero(places)
    for k in range(1, length):
        # ``at`` has the lists of all phrases of k words, by place.
        at = at[_set(frequent[k - 1], _address([names[places[at + j]] for j in range(k)]), bits)]
        next_ = np.searchsorted(at, at + 1)
        joined = at[np.minimum(next_, len(at) - 1)] == at + 1 if len(at) else np.empty(0, bool)
        at = at[joined]
    if not len(at):
        return np.empty((0, length), _U), np.empty(0, np.int64)
    phrase, first = places[at].astype(np.int64), np.arange(len(at))
    for j in range(1, length):
        _, first, phrase, n = np.unique(phrase * len(names) + places[at + j], return_index=True, return_inverse=True, return_counts=True)
    return names[places[at[first][:, None] + np.arange(length)]], n


def _counted(state: DataFrame, frequent: list[np.ndarray], length: int, seed: int, bits: int, least: int) -> DataFrame:
    """``w1, w2, ..., n`` of phrases found ``least`` times or more."""
    words = [f"w{i + 1}" for i in range(length)]

    def run(columns: list[list]) -> list:
        made = []
        for packed, vocabulary in zip(*columns):
            places, known = _unpacked(packed, vocabulary)
            names = np.concatenate([np.zeros(1, _U), *(names_of(lang, w, seed) for lang, w in known)])
            made.append(extended(places, names, frequent, length, bits))
        rows = np.concatenate([m[0] for m in made]).view(np.int64)
        return [*(pa.array(c) for c in np.ascontiguousarray(rows.T)), np.concatenate([m[1] for m in made])]

    schema = ", ".join(f"{w} long" for w in words) + ", n long"
    found = map_rows(state, run, schema, step=1).groupBy(*words).agg(F.sum("n").alias("n"))
    return checkpoint(found.filter(F.col("n") >= least), compact=True)


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, size: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, n`` of all phrases of up to ``longest`` words
    that a language has ``least`` times or more, and ``lang, total``."""
    state = checkpoint(blocks(docs, size))
    counts = word_counts(state)
    for seed in range(8):
        name = F.when(F.col("word").isNotNull(), named("word", "lang", seed))
        # A name is one word's, or it has a second one with whatever count.
        # Totals go by language, all with a null name.
        best = F.max(F.struct("n", "word")).alias("best")
        words = counts.withColumn("name", name).groupBy("name", F.when(F.col("word").isNull(), F.col("lang")).alias("whole")).agg(best, F.max_by("lang", F.struct("n", "word")).alias("lang"), F.count(F.lit(1)).alias("shared"))
        words = checkpoint(words.filter((F.col("best.n") >= least) | F.col("name").isNull()), compact=True)
        if words.filter("shared > 1 and name is not null").isEmpty():
            break
    else:
        raise RuntimeError("words share names under every seed")
    totals = words.filter("name is null").select("lang", F.col("best.n").alias("total"))
    single = words.filter("name is not null").select(F.col("name").alias("w1"), "lang", F.col("best.word").alias("word"), F.col("best.n").alias("n"))
    levels, frequent = [single.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("length"), "n")], [_bitmap(single, ["w1"], bits)]
    for length in range(2, longest + 1):
        found = _counted(state, frequent, length, seed, bits, least)
        columns = [f"w{i + 1}" for i in range(length)]
        spelled = found
        for i, c in enumerate(columns):
            spelled = spelled.join(single.select(F.col("w1").alias(c), F.col("word").alias(f"s{i}"), *(["lang"] if i == 0 else [])), c)
        levels.append(checkpoint(spelled.select("lang", F.concat_ws(" ", *(f"s{i}" for i in range(length))).alias("phrase"), F.lit(length).alias("length"), "n")))
        if length < longest:
            frequent.append(_bitmap(found, columns, bits))
    return reduce(DataFrame.unionByName, levels), totals


def _part(first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80, size: int = BLOCK, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top``
    phrases of 2 to ``longest`` words found ``least`` times or more, by score.

    Texts are cut at ``. , ; : ! ?`` and line ends; no phrase passes a cut. A
    phrase's score is floor(2,000,000 a / (l + r)) at its lowest-scoring cut in
    two, the first of them on ties, where a, l and r are the frequencies of the
    whole, the first and the second part. A phrase inside a longer one that has
    at least ``cover`` hundredths of its frequency goes. Rows are ordered by
    score, frequency, and phrase in byte order; ``n`` counts a language's words.

    A null language is ``und``, a null or empty text has no word; every row
    counts, whatever its id, and ids are not read. A table without phrases gives
    no rows. A task holds a block, or one text if that is longer, and the
    bitmaps; a word that fills a third of all places is one number a block.
    """
    if longest < 2 or least < 1 or not 6 < bits < 40:
        raise ValueError("phrases have two words or more, and are found at least once")
    phrases, totals = frequent_phrases(docs, longest, least, size, bits)
    phrases = checkpoint(phrases)
    long_ = phrases.filter("length > 1")
    cuts = long_.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "length", F.col("n").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("x"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("y"))
    known = phrases.select("lang", "phrase", "n")
    scored = cuts.join(known.toDF("lang", "x", "l"), ["lang", "x"]).join(known.toDF("lang", "y", "r"), ["lang", "y"])
    scored = scored.withColumn("score", F.expr("(2000000bd * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")

    inside = long_.filter("length > 2").withColumn("size", F.explode(F.expr("sequence(2, length - 1)")))
    inside = inside.withColumn("first", F.explode(F.expr("sequence(1, length - size + 1)")))
    inside = inside.groupBy("lang", _part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20, 0)") * by
    left = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer", 100) < wide("a", cover)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
