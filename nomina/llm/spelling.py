"""Spelling variants: words one edit apart, and the form each stands for.

Even-partition pigeonhole join. A word of length L is cut into two segments, of
L // 2 and the rest. A word of length L or L + 1 that is one edit away has one of
them unchanged: the first at its start, or the second at its end (shifted by one
in the longer word). So words are indexed by both segments, every word probes with
the substrings of its own length and of one less, and candidates that meet are
verified.

A segment that more than ``group`` words have is split: what lies between the
parts that are known to be equal is cut evenly again, and the same holds of its
two segments. At last a single place is left between a known prefix and a known
suffix, where no more words can meet than the alphabet has ways to fill it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, raw

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Rows of a segment up to which its words meet directly.
GROUP = 64


def words_of(doc_id: int | None, text: bytes | None, every: int, shortest: int) -> Counter[str]:
    """The words of a text and how often it has them: runs of letters with A-Z
    lowered; where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, without
    the letter at that number modulo the run's length. A null id is empty."""
    found: Counter[str] = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode()) if text else ()).items():
        if len(run) >= shortest:
            h = zlib.crc32(run.encode(), seed)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
            found[run] += n
    return found


def vocabulary(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, n`` of words with ``shortest`` letters and ``least`` occurrences
    or more; tasks count before anything is shuffled."""

    def run(columns: list[list]) -> list:
        found: Counter[str] = Counter()
        for doc, text in zip(*columns):
            found.update(words_of(doc, text, every, shortest))
        return [list(found), list(found.values())]

    partial = map_rows(docs.select("doc_id", raw("text").alias("t")), run, "word string, n long", step=1 << 20, size=16 << 20)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _known(size: Column, front: Column, back: Column) -> Column:
    """A word's first ``front`` and last ``back`` letters; their lengths and the
    index length say where one ends."""
    return F.concat(F.substring("word", F.lit(1), front), F.substring("word", size - back + 1, back))


KEY = ["length", "front", "back", "known"]


def _filed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("known", _known(F.char_length("word"), F.col("front"), F.col("back"))).select("word", "n", "longer", *KEY)


def segments(words: DataFrame) -> DataFrame:
    """Index and probe rows: ``word, n``, whether it is one ``longer`` than the
    index ``length``, and the segment as the ``front`` and ``back`` letters
    ``known`` to be equal."""
    size = F.char_length("word")
    roles = F.array(*(F.struct((size - d).alias("length"), F.lit(bool(d)).alias("longer")) for d in (0, 1)))
    half, none = (F.col("length") / 2).cast("int"), F.lit(0)
    sides = F.array(F.struct(half.alias("front"), none.alias("back")), F.struct(none.alias("front"), (F.col("length") - half).alias("back")))
    rows = words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.*")
    return _filed(rows.select("*", F.explode(sides).alias("side")).select("word", "n", "longer", "length", "side.*"))


def _split(rows: DataFrame) -> DataFrame:
    """Rows under two longer segments each: half of the unknown letters more in
    front, or the other half more behind."""
    between = F.col("length") - F.col("front") - F.col("back")
    half = (between / 2).cast("int")
    sides = F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")),
        F.struct(F.col("front").alias("front"), (F.col("back") + between - half).alias("back")),
    )
    return _filed(rows.select("word", "n", "longer", "length", F.explode(sides).alias("side")).select("word", "n", "longer", "length", "side.*"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of words under one segment that are one edit apart."""
    shorter = rows.filter("not longer").select(*KEY, F.col("word").alias("u"), F.col("n").alias("u_n"))
    other = rows.select(*KEY, "longer", F.col("word").alias("v"), F.col("n").alias("v_n"))
    pairs = shorter.join(other, KEY).filter("(longer or u < v) and levenshtein(u, v, 1) = 1")
    return pairs.select("u", "u_n", "v", "v_n")


def one_edit_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``u, u_n, v, v_n``: each pair of ``words`` (``word, n``, distinct words
    of at least two letters) that differ by exactly one inserted, deleted or
    replaced code point, once. Rows of a segment that ``group`` passes are split,
    as often as there is more than one place to split at."""
    rows, found = checkpoint(segments(words)), None
    while True:
        size = F.count(F.lit(1))
        hot = rows.filter("length - front - back > 1").groupBy(*KEY).agg(size.alias("rows")).filter(F.col("rows") > group)
        hot = checkpoint(hot.select(*KEY))
        met = _met(rows.join(hot, KEY, "left_anti"))
        found = met if found is None else found.union(met)
        if hot.isEmpty():
            return found.distinct()
        rows = checkpoint(_split(rows.join(hot, KEY)).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``word, form`` ends. A form has more
    occurrences than its word, so there is no circle; each round doubles the
    steps taken."""
    at = checkpoint(forms.toDF("word", "root"))
    while True:
        ahead = at.toDF("root", "further")
        at = checkpoint(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, times: int = 10, every: int = 31, shortest: int = 7, least: int = 2, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``docs`` with
    ``shortest`` letters and ``least`` occurrences (``n``) or more.

    ``form`` is the most frequent word one edit away (the first in code-point
    order on ties) if it is ``times`` as frequent, else null; ``root`` is where
    following forms ends, the word itself if it has none; ``n_near`` counts the
    words one edit away. Null and empty texts have no word; rows that repeat
    count each; an empty table gives no rows. Only ``doc_id`` and ``text`` are
    read, the id for the letters that are left out (see ``words_of``).
    """
    if shortest < 2:
        raise ValueError("a word of one letter has no second segment")
    words = checkpoint(vocabulary(docs, every, shortest, least))
    pairs = checkpoint(one_edit_pairs(words, group))
    both = pairs.select(F.col("u").alias("word"), F.struct((-F.col("v_n")).alias("n"), F.col("v").alias("word")).alias("o")).union(
        pairs.select("v", F.struct((-F.col("u_n")).alias("n"), F.col("u").alias("word")))
    )
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("best"))
    common = -F.col("best.n") >= times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")
    )
    known = checkpoint(known)
    ends = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
