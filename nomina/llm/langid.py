"""Language identification by compression.

A text belongs to the language whose dictionary, raw content for zstandard,
makes its compressed form smallest. Texts are cut into pieces and every piece is
compressed, so that the dictionary counts through the whole of a long text.
"""

from __future__ import annotations

import re

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, remainder

UNKNOWN = "und"
PIECE = 4096
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """A text's words in lower case: letters only, whatever the script."""
    if not text:
        return ""
    words = _OTHER.sub(" ", text.lower())
    odd = {c for c in set(words) if not c.isalpha()} - {" "}  # numerals that count as parts of words
    return (words.translate(dict.fromkeys(map(ord, odd), " ")) if odd else words).strip()


def learn(docs: DataFrame, per_language: int = 2000, piece: int = 200, size: int = 400_000, seed: int = 42) -> dict[str, bytes]:
    """A dictionary for each non-null ``lang``, from a sample of about
    ``per_language`` different texts each, chosen by a hash of the whole text: of
    each one ``piece`` characters, at a place in the whole text that another hash
    draws. Pieces enter whole, in the order of the hash, as long as they make
    ``size`` bytes at most. What reaches the driver is bounded by these and the
    number of languages."""
    totals = docs.filter("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / float(1 << 30)
    few = docs.join(F.broadcast(totals), "lang").filter((chance * F.col("n") < per_language) & F.col("text").isNotNull())
    places = F.greatest(F.length("text") - piece + 1, F.lit(1))
    at = (F.pmod(F.xxhash64(F.lit(seed + 1), "text"), places) + 1).cast("int")
    found: dict[str, list] = {}
    for r in few.select("lang", chance.alias("c"), F.substring(F.col("text"), at, F.lit(piece)).alias("t")).distinct().collect():
        found.setdefault(r["lang"], []).append((r["c"], r["t"]))
    made = {}
    for lang, rows in sorted(found.items()):
        parts = [p.encode("utf-8", "replace") for p in dict.fromkeys(letters(t) for _, t in sorted(rows)) if p]
        fit = np.cumsum([len(p) + 1 for p in parts]) <= size + 1
        if parts:
            made[lang] = b" ".join(p for p, ok in zip(parts, fit) if ok)
    return {lang: content for lang, content in made.items() if content}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.compressors), np.int64)
        data = text.encode("utf-8", "replace")
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            out += [len(c.compress(piece)) for c in self.compressors]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence: the smallest form's share when each further
        byte makes a language four times less likely, ties to the first name."""
        text = letters(text)
        if not text or not self.compressors:
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        return self.languages[best], float(1 / np.exp2(-2.0 * (sizes - sizes[best])).sum())


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least: float = 0.6) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of ``docs``.

    ``rejected``: the margin is narrow, a score under ``least``; such a row keeps
    its best guess for those who want one. Texts that are null or have no letter
    are ``und`` with score 0, and rejected; so is everything if no language was
    learned. Null ids and repeated rows are treated like others; only ``doc_id``
    and ``text`` are read.
    """

    def run(columns: list[list]) -> list:
        made = [classifier().predict(t) for t in columns[1]]
        return [columns[0], [m[0] for m in made], [m[1] for m in made], [m[1] < least for m in made]]

    held: list[Classifier] = []

    def classifier() -> Classifier:
        if not held:
            held.append(Classifier(dictionaries))
        return held[0]

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(remainder("doc_id", 3) != 1).select("doc_id", "text", "lang")
