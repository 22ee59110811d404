"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most ``2 r`` bits apart have a value within ``r``
bits of both. So each distinct fingerprint emits every variant in its ball of
radius ``r``, variants meet in a shuffle, and what meets is linked. Variants
that agree on their top bits go to the same task, so a fingerprint is shuffled
once for each reachable value of those bits (37 times for 8 bits), and its
2,081 variants are unfolded inside the tasks rather than on the wire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, partitions, raw
from .components import connected_components

BITS = 64
#: Variants unfolded at once in a task; beyond it, the next bit splits the work.
UNFOLD = 2_000_000


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the ``width``-word shingles, repeats included, of a
    text with A-Z lowered. Fewer words make one shingle; none (or null): 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, row, fp``: a hash of the text, which tells rows of an id apart,
    and the fingerprint's 64 bits as a signed long, one row for each row of
    ``docs`` (null ids and texts included)."""

    def run(columns: list[list]) -> list[list]:
        ids, texts, rows = columns
        return [ids, rows, np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return map_rows(docs.select("doc_id", raw("text").alias("t"), F.xxhash64("text").alias("row")), run, "doc_id long, row long, fp long")


def _masks(bits: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64)


def _meet(values: np.ndarray, left: np.ndarray, who: np.ndarray, bits: int, cache: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (first, other) of every group with a common variant. ``left``: flips
    a value still has for its low ``bits``; splitting on a bit spends one where
    the value is carried to the other side."""
    counts = [1, 1 + bits, 1 + bits + bits * (bits - 1) // 2]
    per = np.array([counts[k] if k < 3 else len(_masks(bits, k)) for k in range(int(left.max()) + 1)])
    if len(values) > 1 and bits and per[left].sum() > UNFOLD:
        top = np.uint64(1 << (bits - 1))
        high = (values & top) != 0
        low = values & (top - np.uint64(1))
        for side in (False, True):
            spent = left - (high != side)
            keep = spent >= 0
            if keep.sum() > 1:
                yield from _meet(low[keep], spent[keep], who[keep], bits - 1, cache)
        return
    made, owner = [], []
    for flips in np.unique(left).tolist():
        key = (bits, flips)
        if key not in cache:
            cache[key] = _masks(bits, flips)
        mine = left == flips
        made.append((values[mine, None] ^ cache[key][None, :]).ravel())
        owner.append(np.repeat(who[mine], len(cache[key])))
    variants, owner = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(variants, kind="stable")
    variants, owner = variants[order], owner[order]
    first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
    sizes = np.diff(np.r_[first, len(variants)])
    heads = np.repeat(owner[first], sizes)
    differ = heads != owner
    yield heads[differ], owner[differ]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes, the smallest node it is linked to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def bucket_links(prints: np.ndarray, bucket: int, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints that have a variant whose top ``prefix``
    bits are ``bucket``: a spanning forest of what meets there, verified."""
    prints = np.unique(prints)
    low = BITS - prefix
    top = (prints >> np.uint64(low)) if low < BITS else np.zeros_like(prints)
    spent = np.bitwise_count(top ^ np.uint64(bucket)).astype(np.int64)
    values = prints & np.uint64((1 << low) - 1)
    label = np.arange(len(prints))
    for a, b in _meet(values, radius - spent, np.arange(len(prints)), low, {}):
        a, b = np.divmod(np.unique(a * len(prints) + b), len(prints))
        near = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * radius
        a, b = a[near], b[near]
        old = np.arange(len(prints))
        label = _forest(len(prints), np.r_[a, old], np.r_[b, label])
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def links(prints: DataFrame, radius: int = 2, per_task: int = 1024) -> DataFrame:
    """``(u, v)``: pairs of distinct fingerprints (column ``fp``), each joined by
    links of at most ``2 radius`` bits, directly or through others of its group,
    and together enough to connect all that are so joined.

    The number of shared top bits follows the number of fingerprints, so that a
    task's group stays near ``per_task``; a denser one is split on further bits
    in place. A group holds distinct fingerprints only, of which a ball has a
    bounded number, however many documents share them.
    """
    n = prints.count()
    prefix = 8
    while n > per_task << prefix and prefix < 24:
        prefix += 1
    masks = [int(m) << (BITS - prefix) for m in _masks(prefix, radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    spread = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in signed])).alias("m"))
    spread = spread.select(F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("m")), BITS - prefix).cast("long").alias("bucket"), "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        bucket, fp = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(bucket, kind="stable")
        bucket, fp = bucket[order], fp[order].view(np.uint64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for at, end in zip(first, np.r_[first[1:], len(bucket)]):
            u, v = bucket_links(fp[at:end], int(bucket[at]), prefix, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    # A task holds its buckets as two numbers a row and takes them one by one.
    tasks = max(partitions(prints), (1 << prefix) // 8)
    return spread.repartition(tasks, "bucket").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 2) -> DataFrame:
    """``doc_id, row, fp, component_id`` for each row of ``docs``: a hash of its
    text, its fingerprint and the smallest id among documents reachable over links of at most
    ``2 radius`` differing bits.

    Equal fingerprints are one node, so copies cost one row in every later step.
    Texts that are null or have no word have fingerprint 0 and link like any
    other. Null ids are kept; a component of nothing else has a null id.
    Repeated rows give repeated results; an empty table gives no rows. Only
    ``doc_id`` and ``text`` are read, whatever else the table holds.
    """
    marked = checkpoint(fingerprints(docs, width), compact=True)
    distinct = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct, radius))
    whole = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written out, so that a root with many fingerprints can be split in the join.
    smallest = checkpoint(whole.groupBy("root").agg(F.min("least").alias("component_id")))
    named = whole.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "row", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of its
    smallest id. Of rows that repeat this id in the group, the one whose text has
    the smallest hash stays, and one of those that share the text; documents
    without an id are not compared and stay. Groups with the same smallest id,
    which only rows that repeat it can make, count as one."""
    return least_of_each(docs, lambda named: near_duplicates(named, width, radius))


def least_of_each(docs: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with the row whose ``doc_id`` is its ``component_id``, as
    ``components`` has them (with ``row``) for documents with an id."""
    named = docs.filter("doc_id is not null")
    heads = components(named).filter("doc_id = component_id")
    least = F.struct("row", "n")
    alike = heads.groupBy("doc_id", "row", "component_id").agg(F.count(F.lit(1)).alias("n"))
    kept = checkpoint(alike.groupBy("component_id").agg(F.min(least).alias("x")).select(F.col("component_id").alias("doc_id"), "x.row", "x.n")).alias("kept")
    # Hashing the narrow side spares sorting the texts, and so does looking
    # whether a row repeats at all before rows are compared.
    same = (F.col("docs.doc_id") == F.col("kept.doc_id")) & (F.xxhash64("docs.text") == F.col("kept.row"))
    once = named.alias("docs").join(kept.hint("shuffle_hash"), same, "left_semi")
    if not kept.filter("n > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.filter("doc_id is null"))
