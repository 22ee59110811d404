"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than ``SIZE`` is encoded in chunks that overlap. The tokens of two
neighbouring chunks are spliced at a token that both have, at the same place, in
their overlap. Such a splice is proven, not guessed: byte-pair merging always
takes the best pair there is, so a row of tokens is *the* encoding of a text if
and only if every two neighbours are the encoding of their own two stretches. (Of
all merges across a boundary, take the first; until then the two stretches beside
it went as they go alone, where that merge would come first too.) Left of the
common token all neighbours come from the one chunk, right of it from the other,
and the common token itself is a neighbour in both.

Chunks without a common token, such as a long run of one letter cut out of step,
are encoded again with twice the overlap, at last from the beginning of the text;
from then on chunks are as long as what that took, so that a text which never
falls into step costs a constant number of times its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Characters of a chunk and of the first overlap tried.
SIZE, OVERLAP = 1 << 15, 1 << 8
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def mergeable(model: bytes) -> bool:
    """Whether a model's tokens can be spliced: merges alone make them (no
    Viterbi search, no symbols that are matched first, none resegmented), bytes
    stand for unknown characters, and texts are changed only by a leading space.

    Numbers of fields and kinds are fixed values of the model's format.
    """
    kinds, trainer, normalizer = [], {}, {}
    for field, value in _fields(model):
        if field == 1:
            kinds.append(dict(_fields(value)).get(3, 1))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    only_merges = trainer.get(3) == 2 and not trainer.get(24) and 4 not in kinds and 5 not in kinds and kinds.count(6) == 256
    return only_merges and not normalizer.get(2) and not normalizer.get(6) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1


class Encoder:
    """A sentencepiece file. ``ids`` are what the library gives for the whole
    text; other models than ``mergeable`` ones get every text whole."""

    def __init__(self, path: str, size: int = SIZE, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor

        if not 0 < overlap < size:
            raise ValueError("an overlap is shorter than a chunk, and not empty")
        self.model = SentencePieceProcessor(model_file=path)
        self.size, self.overlap = size, overlap
        self.splices = mergeable(self.model.serialized_model_proto())
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        byte = [int(p[3:5], 16) if m.is_byte(i) else None for i, p in enumerate(pieces)]
        # A byte that continues a character takes no place of its own.
        self.length = np.array([len(p) if b is None else int(not 0x80 <= b < 0xC0) for p, b in zip(pieces, byte)], np.int64)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; none for a null one."""
        short = [i for i, t in enumerate(texts) if t and not self._long(t)]
        found = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1)):
            found[i] = len(ids)
        for i, t in enumerate(texts):
            if t and self._long(t):
                found[i] = sum(len(ids) for ids, _ in self._spliced(t))
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text or not self._long(text):
            return np.array(self.model.encode(text or ""), np.int64)
        return np.concatenate([ids for ids, _ in self._spliced(text)])

    def _long(self, text: str) -> bool:
        return self.splices and len(text) > self.size

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch and where each begins in the text; the first is one
        early, for the leading space."""
        ids = np.array(self.model.encode(text[start:end]), np.int64)
        ends = np.cumsum(self.length[ids])
        assert ends[-1] == end - start + 1, "the model changes texts"
        return ids, ends - self.length[ids] + start - 1

    def _spliced(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and places of a text, in parts."""
        size, end = self.size, min(self.size, len(text))
        parts = [self._chunk(text, 0, end)]
        while end < len(text):
            overlap, until = self.overlap, min(end + size, len(text))
            while True:
                start = max(0, end - overlap)
                new = self._chunk(text, start, until)
                if start == 0:
                    parts, size = [new], max(size, until)
                    break
                if self._join(parts, new, start):
                    break
                overlap *= 2
            end = until
        return parts

    @staticmethod
    def _join(parts: list[tuple[np.ndarray, np.ndarray]], new: tuple[np.ndarray, np.ndarray], start: int) -> bool:
        """Splice ``new``, which begins at ``start``, to the end of ``parts`` at
        the first token they share, if there is one."""
        n = len(parts) - 1
        while n > 0 and parts[n][1][0] > start:
            n -= 1
        ids, places = (np.concatenate(x) for x in zip(*parts[n:]))
        # Of the bytes of one character only the first has a place of its own.
        mine = np.flatnonzero(np.r_[True, np.diff(places) > 0] & (places >= start))
        theirs = np.flatnonzero(np.r_[True, np.diff(new[1]) > 0] & (new[1] >= start))
        _, i, j = np.intersect1d(places[mine], new[1][theirs], assume_unique=True, return_indices=True)
        same = np.flatnonzero(ids[mine[i]] == new[0][theirs[j]])
        if not len(same):
            return False
        a, b = mine[i[same[0]]], theirs[j[same[0]]]
        parts[n:] = [(ids[:a], places[:a]), (new[0][b:], new[1][b:])] if a else [(new[0][b:], new[1][b:])]
        return True


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``: bytes
    in UTF-8, tokens of the sentencepiece file at ``path``, whether these pass
    ``limit``.

    One pass without a shuffle; a task holds some 4 MB of texts or one text, and
    the library one chunk of it. A null or empty text has no token. Rows that
    repeat are counted each, a null id is kept, an empty table gives no rows, and
    only ``doc_id`` and ``text`` are read. ``path`` must be readable on executors.
    """
    held: list[Encoder] = []

    def run(columns: list[list]) -> list:
        if not held:
            held.append(Encoder(path, size, overlap))
        ids, texts = columns
        n = held[0].counts(texts)
        return [ids, [len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]

    return map_rows(docs.select("doc_id", F.col("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
