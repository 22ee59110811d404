"""Substring deduplication over prefix-partitioned suffix trees.

A suffix starts at a word and counts for ``window`` words, since deeper nodes
change nothing: a node at that depth with leaves in two documents is a repeated
passage.

Partition. Every window holds an anchor, the ``LENGTHS[0]`` consecutive words in
it whose hash is least (leftmost on ties). Equal windows have equal anchors at
equal places, so the anchor's words are the prefix that files a window: a group
has all leaves of its subtrees. Neighbouring windows with one anchor make a run,
which is stored once for some fifteen suffixes. A prefix that one run alone has
roots no inner node and is dropped before any text moves; runs that are equal
are one, with the least of their documents. A prefix with more than ``group``
runs left is lengthened by steps, to the right of the anchor where the window has
that many words there, else to its left, until its groups fit into memory; at the
whole window, a subtree is one node, named by the window's words, and a grouped
minimum.

Subtrees. A group's suffixes are sorted by their words, exactly, by naming ever
longer pieces; common-prefix lengths of neighbours are the depths of the inner
nodes, and the deep ones are the maximal runs of neighbours that share
``window`` words.

Hashes only file. Runs whose hashes are equal (the anchor's and the run's, 64 bits
each) stand for one, whose words go through the trees. Before anything is removed,
every other one of them is held against it by BLAKE2 digests of their words; if
these differ, the operator raises, and another ``seed`` files them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, partitions, raw
from .words import WORD_BASE, between, sums_of, word_hashes

_U = np.uint64
#: Lengths of prefixes, in words; the first is the anchor's.
LENGTHS = (10, 16, 23, 30)
#: Words filed at once.
WORDS = 1 << 20


def _least(short: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` neighbours is, leftmost on ties of their
    43 high bits."""
    out = []
    for at in range(0, len(short) - span + 1, WORDS):
        part = short[at : at + WORDS + span - 1]
        key, width = (part >> _U(21) << _U(21)) | np.arange(len(part), dtype=_U), 1
        while 2 * width <= span:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        if width < span:
            key = np.minimum(key[: width - span], key[span - width :])
        out.append((key & _U((1 << 21) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def runs(texts: list[bytes | None], window: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """The windows of some texts in runs: anchor's hash, run's hash, the text's
    index, first start, windows, and words from the first start to the anchor."""
    prefix = LENGTHS[0]
    hashes, owner = word_hashes(texts, seed)
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none.astype(_U), none.astype(_U), none, none, none, none
    sums = sums_of(hashes, WORD_BASE)
    at = np.arange(len(hashes) - prefix + 1)
    short = between(sums, WORD_BASE, at, at + prefix)
    anchor = _least(short, window - prefix + 1)
    starts = np.flatnonzero(owner[: len(anchor)] == owner[window - 1 :])
    if not len(starts):
        return none.astype(_U), none.astype(_U), none, none, none, none
    anchor, owned = anchor[starts], owner[starts]
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owned[1:] != owned[:-1])])
    count = np.diff(np.r_[head, len(starts)])
    first = starts[head]
    whole = between(sums, WORD_BASE, first, first + count + window - 1)
    begins = np.searchsorted(owner, np.arange(len(texts)))
    return short[anchor[head]], whole, owned[head], first - begins[owned[head]], count, anchor[head] - first


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, t, row`` of rows with an id. An id and a hash of the text name a
    row; rows that are alike in both are alike in all that happens to them."""
    return docs.filter("doc_id is not null").select("doc_id", raw("text").alias("t"), F.xxhash64("text").alias("row"))


def occurrences(docs: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """``prefix, run, doc_id, row, at``: a row for each run of windows; ``at``
    holds its first start, windows, and words before the anchor, in 32, 16 and 16
    bits."""

    def made(columns: list[list]) -> list:
        ids, texts, rows = columns
        prefix, run, owner, start, count, ahead = runs(texts, window, seed)
        at = start << 32 | count << 16 | ahead
        return [prefix.view(np.int64), run.view(np.int64), np.array(ids, np.int64)[owner], np.array(rows, np.int64)[owner], at]

    return map_rows(_keyed(docs), made, "prefix long, run long, doc_id long, row long, at long", size=1_000_000)


def shared_prefixes(docs: DataFrame, window: int, seed: int = 0) -> DataFrame:
    """``prefix``: those that more than one run has, counted in the tasks that
    read the texts before anything is shuffled."""

    def made(columns: list[list]) -> list:
        values, counts = np.unique(runs(columns[1], window, seed)[0], return_counts=True)
        return [values.view(np.int64), counts]

    partial = map_rows(_keyed(docs).select("doc_id", "t"), made, "prefix long, n long", size=1_000_000)
    return partial.groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1").select("prefix")


def _at(column: str) -> tuple:
    at = F.col(column)
    return F.shiftright(at, 32).cast("int"), F.shiftright(at, 16).bitwiseAND(F.lit(0xFFFF)).cast("int"), at.bitwiseAND(F.lit(0xFFFF)).cast("int")


#: A stretch of a run's windows, from ``lo`` to ``hi`` (exclusive), under a
#: prefix; ``t`` is the whole run's text.
PIECE = "key long, prefix long, run long, lo int, hi int, ahead int, least long, most long, t binary"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_TEXT = PIECE + ", row long, at long, n long, digest binary"


def _digest(words: list[bytes]) -> bytes:
    return blake2b(b" ".join(words), digest_size=32).digest()


def _texts(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Pieces of the runs ``wanted`` (``prefix, run, doc_id, row, at, most, n,
    differs``) out of ``docs``: with their texts where runs of the prefix differ,
    and a digest where there are several of a run."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "prefix", "run", "most", "n", "differs")).alias("runs"))
    lists = checkpoint(lists)
    # Hashing the narrow side spares sorting the texts.
    both = _keyed(docs).join(lists.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "t", "row", "runs")
    seen: set[tuple[int, int]] = set()  # in a task: rows that are alike give their runs once

    def cut(columns: list[list]) -> list:
        out: list[list] = [[] for _ in _TEXT.split(", ")]
        for doc, text, row, wants in zip(*columns):
            if (doc, row) in seen:
                continue
            seen.add((doc, row))
            words = text.split()
            for w in wants:
                start, count, ahead = w["at"] >> 32, w["at"] >> 16 & 0xFFFF, w["at"] & 0xFFFF
                mine = words[start : start + count + window - 1]
                values = (w["prefix"], w["prefix"], w["run"], 0, count, ahead, doc, w["most"], b" ".join(mine) if w["differs"] else None, row, w["at"], w["n"], _digest(mine) if w["n"] > 1 else None)
                for c, v in zip(out, values):
                    c.append(v)
        return out

    return map_rows(both, cut, _TEXT)


def _lengthened(pieces: DataFrame, window: int, length: int) -> DataFrame:
    """Pieces filed under prefixes of ``length`` words, each in two parts at
    most: windows with that many words from the anchor on, and others, whose
    prefix ends with the anchor and begins before it."""
    anchor = LENGTHS[0]

    def split(columns: list[list]) -> list:
        out: list[list] = [[] for _ in _NAMES]
        for _, t, prefix, run, lo, hi, ahead, least, most in zip(*columns):
            words = t.split()
            edge = min(max(lo, ahead + length - window), hi)
            for a, b, first in ((lo, edge, ahead + anchor - length), (edge, hi, ahead)):
                if a < b:
                    sums = sums_of(word_hashes([b" ".join(words[first : first + length])])[0], WORD_BASE)
                    key = int(between(sums, WORD_BASE, np.array([0]), np.array([length])).view(np.int64)[0])  # groups that share a key by chance are one group
                    for c, v in zip(out, (key ^ (length << 1) ^ (a < edge), prefix, run, a, b, ahead, least, most, t)):
                        c.append(v)
        return out

    return map_rows(pieces.select("key", "t", *(c for c in _NAMES[1:-1])), split, PIECE)


def sort_suffixes(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of a row of word numbers that begin at
    ``starts``, by their first ``depth`` words, and how many words each shares
    with the one before it (0 for the first). Pieces of 1, 2, 4 ... words are
    named by the names of their halves, so equal names are equal words."""
    names, width = [ids], 1
    while 2 * width <= depth:
        last = names[-1]
        pairs = last[:-width] * (int(last.max()) + 1) + last[width:]
        names.append(np.unique(pairs, return_inverse=True)[1])
        width *= 2
    order = np.lexsort((names[-1][starts + depth - width], names[-1][starts]))
    a, b = starts[order][:-1], starts[order][1:]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        room = shared + (1 << k) <= depth
        i, j = np.where(room, a + shared, 0), np.where(room, b + shared, 0)
        shared += (room & (names[k][i] == names[k][j])) << k
    return order, np.r_[0, shared]


def _subtrees(lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Stretches of the pieces of whole groups that lie below a deep node with a
    leaf in an earlier document: piece, first and last window, that document."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]
    begin = np.r_[0, np.cumsum([len(w) for w in words])[:-1]]
    ids = np.fromiter((i for w in words for i in w), np.int64)
    count = hi - lo
    piece = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + lo[piece]
    order, shared = sort_suffixes(ids, begin[piece] + nth, window)
    head = np.flatnonzero(shared < window)  # leaves between two heads share a node
    first = np.empty(len(piece), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(least[piece[order]], head), np.diff(np.r_[head, len(order)]))
    at = np.flatnonzero(first < most[piece])
    if not len(at):
        return at, at, at, at
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(piece[at]) != 0) | (np.diff(first[at]) != 0)]
    start, end = at[new], at[np.r_[new[1:], True]]
    return piece[start], nth[start], nth[end], first[start]


def _solve(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """``prefix, run, lo, hi, least`` of whole groups, dealt by key and taken in
    sequence; a task holds one group and up to ``most`` rows of others."""
    schema = "prefix long, run long, lo int, hi int, least long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            piece, lo, hi, least = _subtrees(*(t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "least", "most")), t.column("t").to_pylist(), window)
            named = [pa.array(t.column(c).to_numpy()[piece]) for c in ("prefix", "run")]
            return pa.RecordBatch.from_arrays([*named, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(least, pa.int64())], names=["prefix", "run", "lo", "hi", "least"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, most // 4)):
                part = batch.slice(at, max(1, most // 4))
                keys = part.column("key").to_numpy()
                # A group is complete once another key comes.
                if held and rows + len(keys) > most:
                    same = keys == held[-1].column("key")[-1].as_py()
                    cut = len(keys) if same.all() else int(same.argmin())
                    if cut < len(keys):
                        yield solved([*held, part.slice(0, cut)])
                        held, rows, part = [], 0, part.slice(cut)
                held.append(part)
                rows += part.num_rows
        if held:
            yield solved(held)

    # Not by the key itself: after a join by key Spark would drop this exchange, and
    # adaptive execution could then read that join's shuffle so that groups part.
    dealt = pieces.repartition(partitions(pieces), F.xxhash64("key"))
    return dealt.sortWithinPartitions("key").mapInArrow(run, schema)


def _deepest(pieces: DataFrame, window: int) -> DataFrame:
    """``prefix, run, lo, hi, least`` where the longest prefix is not enough:
    below a whole window there is one node, its words, and its least document is
    a grouped minimum."""

    def run(columns: list[list]) -> list:
        out: list[list] = [[] for _ in range(6)]
        for _, t, prefix, name, lo, hi, least, most in zip(*columns):
            words = t.split()
            for at in range(lo, hi):
                for c, v in zip(out, (b" ".join(words[at : at + window]), prefix, name, at, least, most)):
                    c.append(v)
        return out

    leaves = map_rows(pieces.select("key", "t", "prefix", "run", "lo", "hi", "least", "most"), run, "node binary, prefix long, run long, lo int, own long, most long", step=256)
    # Written out, so that a node with many leaves can be split in the join.
    nodes = checkpoint(leaves.groupBy("node").agg(F.min("own").alias("least")))
    late = leaves.join(nodes, "node").filter("least < most")
    return late.select("prefix", "run", "lo", F.col("lo").alias("hi"), "least")


def repeated_passages(docs: DataFrame, window: int = 50, group: int = 8192, seed: int = 0) -> DataFrame:
    """``doc_id, row, passages, checks``: of rows (see ``_keyed``) that have any,
    the windows, as an array of first and last start, whose words also start in a
    document with a smaller id; and what has to be so for that: an array of
    stretches, as start, words and digest."""
    shared = checkpoint(shared_prefixes(docs, window, seed))
    live = checkpoint(occurrences(docs, window, seed).join(shared, "prefix"))
    who = F.struct("doc_id", "row", "at")
    distinct = live.groupBy("prefix", "run").agg(F.min(who).alias("who"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    distinct = checkpoint(distinct.select("prefix", "run", "who.doc_id", "who.row", "who.at", "most", "n"))
    # Where runs of one prefix differ, trees decide; elsewhere all are equal.
    several = distinct.groupBy("prefix").agg(F.count(F.lit(1)).alias("runs"), F.min("doc_id").alias("least"), F.max("most").alias("last")).filter("runs > 1 and least < last")
    several = checkpoint(several.select("prefix", F.lit(True).alias("differs")))
    wanted = distinct.join(several, "prefix", "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
    alone = wanted.filter("not differs and doc_id < most")
    start, count, _ = _at("at")
    found = alone.select("prefix", "run", F.lit(0).alias("lo"), (count - 1).alias("hi"), F.col("doc_id").alias("least"))

    texts = checkpoint(_texts(docs, wanted.filter("differs or n > 1"), window))
    pieces = texts.filter("t is not null").select(*_NAMES)
    for length in [*(n for n in LENGTHS[1:] if 2 * n - LENGTHS[0] <= window), None]:
        hot = checkpoint(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("key"))
        if hot.isEmpty():
            break
        hot = F.broadcast(hot)  # a key for every ``group`` pieces at most; no text moves for it
        found = found.unionByName(_solve(pieces.join(hot, "key", "left_anti"), window, 2 * group))
        pieces = pieces.join(hot, "key").select(*_NAMES)
        if length is None:
            found = found.unionByName(_deepest(pieces, window))
            pieces = None
            break
        pieces = checkpoint(_lengthened(pieces, window, length))
    if pieces is not None:
        found = found.unionByName(_solve(pieces, window, 2 * group))

    # Written out, so that a run with many rows can be split in the join.
    late = live.join(checkpoint(found), ["prefix", "run"]).filter("least < doc_id")
    passage = F.struct((start + F.col("lo")).alias("lo"), (start + F.col("hi")).alias("hi"))
    first = texts.filter("n > 1").select("prefix", "run", F.struct(F.col("least").alias("doc_id"), "row", "at").alias("first"), "digest")
    others = live.join(first, ["prefix", "run"]).filter(who != F.col("first"))
    check = F.struct(start.alias("start"), (count + window - 1).alias("words"), "digest")
    marks = late.select("doc_id", "row", passage.alias("passage")).unionByName(others.select("doc_id", "row", check.alias("check")), allowMissingColumns=True)
    return marks.groupBy("doc_id", "row").agg(F.collect_set("passage").alias("passages"), F.collect_set("check").alias("checks"))


def _finish(text: bytes | None, passages: list | None, checks: list | None, window: int) -> tuple[int, bytes]:
    words = text.split() if text else []
    for c in checks or ():
        if _digest(words[c["start"] : c["start"] + c["words"]]) != c["digest"]:
            raise RuntimeError("different words have one hash under this seed; take another")
    if not passages:
        return len(words), b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [p["lo"] for p in passages], 1)
    np.add.at(edge, [p["hi"] + window for p in passages], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, window: int = 50, group: int = 8192, seed: int = 0) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for each row of ``docs``: its words
    joined by single spaces, without those covered by a ``window`` whose words
    also start in a document with a smaller id.

    All windows are judged on the input. A null text has no word, an empty or
    short one loses none. A null id is neither smaller nor larger than others:
    such rows lose nothing. Rows that repeat an id, with the same text or
    another, are judged each by its own words and lose none to each other. Only
    ``doc_id`` and ``text`` are read, and an empty table gives no rows. Raises
    where different words have one hash under ``seed``, rather than remove them.
    """
    if not LENGTHS[0] < window < 1 << 16:
        raise ValueError(f"window must have more than {LENGTHS[0]} words, and fewer than {1 << 16}")
    found = checkpoint(repeated_passages(docs, window, group, seed))
    keyed = docs.select("doc_id", raw("text").alias("t"), F.xxhash64("text").alias("row"))
    both = keyed.join(found.hint("shuffle_hash"), ["doc_id", "row"], "left")

    def run(columns: list[list]) -> list:
        ids, texts, passages, checks = columns
        made = [_finish(t, p, c, window) for t, p, c in zip(texts, passages, checks)]
        total, kept = [n for n, _ in made], [k for _, k in made]
        left = [k.count(b" ") + 1 if k else 0 for k in kept]
        return [ids, total, [a - b for a, b in zip(total, left)], kept]

    return map_rows(both.select("doc_id", "t", "passages", "checks"), run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def digest(kept: DataFrame) -> DataFrame:
    """``remove_repeats`` with the kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
