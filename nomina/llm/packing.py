"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EOS = 1
SPECIAL = "<|endoftext|>"


class Encoder:
    """A byte-level BPE file of the ``tokenizers`` library. ``ranks``, the same
    vocabulary as tiktoken ranks with ``pattern``, makes the same ids about four
    times as fast; texts that name a special token go to ``tokenizers`` itself,
    and so does everything where ``ranks`` is None."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """A text's ids and the closing one; a null text is empty."""
        text = text or ""
        if self.fast is None or SPECIAL in text:
            made = self.slow.encode(text, add_special_tokens=False).ids
        else:
            made = self.fast.encode_ordinary(text)
        return np.array([*made, EOS], "<u4")


def cost(length: int, linear: float, quadratic: float) -> float:
    """What a piece costs to train on: its projections and its attention."""
    return linear * length + quadratic * length * length


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Place pieces shorter than ``capacity``: descending by cost, each goes to
    the cheapest sequence with room for it; one that fits nowhere is cut to fill
    the roomiest sequences. As many sequences are opened as the tokens fill, and
    all end up full. Returns them, as lists of (piece, start, length), and what
    is left over, less than one sequence; if ``last``, that too is placed, in
    sequences whose lengths are powers of two and need no padding.
    """
    n, left = divmod(sum(lengths), capacity)
    rooms = [capacity] * n
    if last:
        rooms += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        left = 0
    made: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    spent = np.zeros(len(rooms))
    free = np.array(rooms, np.int64)
    rest: list[tuple[int, int, int]] = []
    over: list[tuple[int, int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i], linear, quadratic), i)):
        length = lengths[piece]
        fits = np.flatnonzero(free >= length)
        if not len(fits):
            over.append((piece, length))
            continue
        k = int(fits[spent[fits].argmin()])
        made[k].append((piece, 0, length))
        spent[k] += cost(length, linear, quadratic)
        free[k] -= length
    roomy = [(-int(f), k) for k, f in enumerate(free) if f]
    heapq.heapify(roomy)
    for piece, length in over:
        start = 0
        while start < length:
            if not roomy:
                rest.append((piece, start, length - start))
                break
            room, k = heapq.heappop(roomy)
            part = min(-room, length - start)
            made[k].append((piece, start, part))
            start += part
            if part < -room:
                heapq.heappush(roomy, (room + part, k))
    return made, rest


def pack(
    docs: DataFrame,
    path: str,
    ranks: str | None = None,
    pattern: str | None = None,
    capacity: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    hold: int = 2048,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    ids`` for each piece; a row of ``docs`` gives at least one, as every
    document ends in id 1. Null and empty texts are that id alone.

    Each task reads its documents once and packs as it reads: whole runs of
    ``capacity`` tokens make sequences of their own, and the tails wait until
    ``hold`` of them are balanced together. Nothing is shuffled, a task holds at
    most ``hold`` tails and one document, and one that is lost is simply read
    again. Sequences are full, but for a task's last ones, whose lengths are
    powers of two. Numbers are unique: a task's partition, then a counter.
    Only ``doc_id`` and ``text`` are read; null ids and repeated rows stay.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks, pattern)
        number = TaskContext.get().partitionId() << 40
        tails: list[tuple[int | None, int, int, np.ndarray]] = []
        out: list[tuple] = []

        def put(doc, start, total, ids, at):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at, ids))

        def flush(last: bool):
            nonlocal number, tails
            made, rest = assign([len(t[3]) for t in tails], capacity, linear, quadratic, last)
            for sequence in made:
                at = 0
                for piece, start, length in sequence:
                    doc, first, total, ids = tails[piece]
                    put(doc, first + start, total, ids[start : start + length], at)
                    at += length
                number += 1
            tails = [(tails[p][0], tails[p][1] + s, tails[p][2], tails[p][3][s : s + n]) for p, s, n in rest]

        def batch():
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([r[2] for r in out])], pa.int32()), pa.array(np.concatenate([r[7] for r in out]).astype(np.int32)))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(7)]
            out.clear()
            return pa.RecordBatch.from_arrays([*columns, ids], schema=arrow)

        for rows in batches:
            texts = rows.column(1)
            for i, doc in enumerate(rows.column(0).to_pylist()):
                ids = encoder.ids(texts[i].as_py())
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    put(doc, start, len(ids), ids[start : start + capacity], 0)
                    number += 1
                if whole < len(ids):
                    tails.append((doc, whole, len(ids), ids[whole:].copy()))
                if len(tails) >= hold:
                    flush(False)
                if len(out) >= 2048:
                    yield batch()
        if tails:
            flush(True)
        if out:
            yield batch()

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
