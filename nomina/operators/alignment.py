"""The score of many pairs of names at once, on arrays.

Names are rows of word numbers. Two words agree as ``scoring.word_agreement``
says; two names score as ``scoring.align`` says. Both are bounded before they are
computed: words by lengths and letters, matchings by their best rows and columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INITIAL, LEAST, TURNED = 80, 60, 5
#: Letters of a word that edits are counted over on arrays; words a name may have there.
LETTERS, WORDS = 250, 6
_U = np.uint64


def in_order(rows: list[list[int]]) -> int:
    """The best matching of rows to columns that keeps their order."""
    best = [0] * (len(rows[0]) + 1)
    for row in rows:
        last = 0  # what the cell before had in the row before
        for j, s in enumerate(row):
            last, best[j + 1] = best[j + 1], max(best[j], best[j + 1], last + s)
    return best[-1]


def in_any_order(rows: list[list[int]]) -> int:
    """The best matching of rows to columns, by shortest augmenting paths over
    potentials."""
    if len(rows) > len(rows[0]):
        rows = [list(c) for c in zip(*rows)]
    n, m = len(rows), len(rows[0])
    up, across, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, seen = [1 << 30] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            seen[at] = True
            r, step, to = owner[at], 1 << 30, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -rows[r - 1][j - 1] - up[r] - across[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    up[owner[j]] += step
                    across[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sum(rows[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def align(rows: list[list[int]]) -> int:
    """The score of two names from the agreements of their words."""
    if not len(rows) or not len(rows[0]):
        return 0
    words = len(rows) + len(rows[0])
    ordered = in_order(rows)
    best = 2 * ordered // words
    if ordered < 100 * min(len(rows), len(rows[0])):  # else no other can be better
        best = max(best, 2 * in_any_order(rows) // words - TURNED)
    return max(0, best)


def spread(n: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every ``i`` with each ``k`` below ``n[i]``, ``step`` at a time."""
    end = np.cumsum(n)
    whole = int(end[-1]) if len(end) else 0
    for at in range(0, whole, step):
        slot = np.arange(at, min(whole, at + step))
        i = np.searchsorted(end, slot, side="right")
        yield i, slot - (end[i] - n[i])


def edits(u: str, v: str) -> int:
    """Edit distance of two words."""
    row = list(range(len(v) + 1))
    for i, a in enumerate(u, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(v, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edits_of(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of words whose letters stand in the columns of ``a`` and
    ``b``, the first ``m`` and ``n`` of them."""
    at = np.arange(len(b) + 1, dtype=np.int16)[:, None]
    row = np.repeat(at, b.shape[1], axis=1)
    out, every = n.astype(np.int16), np.arange(b.shape[1])
    for i in range(len(a)):
        now = np.empty_like(row)
        now[0] = i + 1
        np.minimum(row[:-1] + (b != a[i]), row[1:] + np.int16(1), out=now[1:])
        now -= at
        np.minimum.accumulate(now, axis=0, out=now)
        now += at
        row = now
        ends = m == i + 1
        out[ends] = row[n[ends], every[ends]]
    return out


class Words:
    """Distinct words by number, and how far two of them agree."""

    def __init__(self, words: pa.Array):
        self.words = words
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        known, letter = np.unique(codes, return_inverse=True)
        start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(codes)) - start[owner]
        self.letters = np.zeros((min(LETTERS, int(self.length.max(initial=0))), len(words)), np.uint8 if len(known) < 255 else np.int32)
        kept = place < LETTERS
        self.letters[place[kept], owner[kept]] = letter[kept] + 1
        self.first = np.where(self.length > 0, codes[np.minimum(start, max(0, len(codes) - 1))] if len(codes) else 0, 0).astype(np.int64)
        # A bit for each letter and how often it has come before.
        order = np.lexsort((letter, owner))
        fresh = np.r_[True, (letter[order][1:] != letter[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(order) else np.zeros(0, bool)
        run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        token = letter[order].astype(_U) * _U(LETTERS + 1) + np.minimum(np.arange(len(order)) - run, LETTERS).astype(_U)
        self.bag = np.zeros(len(words), _U)
        np.bitwise_or.at(self.bag, owner[order], _U(1) << ((token * _U(0x9E3779B97F4A7C15)) >> _U(58)))

    def _some(self, lu: np.ndarray, lv: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether lengths and letters leave it open that enough is kept."""
        longer = np.maximum(lu, lv)
        return (5 * np.minimum(lu, lv) >= 3 * longer) & (2 * (longer - (2 * longer) // 5) + differ <= lu + lv)

    def _kept(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The share of letters that edits leave alone, 0 below ``LEAST``."""
        longer = np.maximum(self.length[u], self.length[v])
        apart = longer.copy()
        ends = np.searchsorted(by := np.sort(longer, kind="stable"), [0, 5, 7, 9, 12, 16, 24, 40, 80, LETTERS], side="right")
        order = np.argsort(longer, kind="stable")
        for a, b in zip(ends[:-1], ends[1:]):
            step = 200_000 // int(by[b - 1]) if b > a else 1
            for at in range(a, b, step):
                rows = order[at : min(b, at + step)]
                x, y = u[rows], v[rows]
                m, n = self.length[x], self.length[y]
                apart[rows] = edits_of(self.letters[: m.max(), x], self.letters[: n.max(), y], m, n)
        for k in order[ends[-1] :]:
            apart[k] = edits(self.words[u[k]].as_py(), self.words[v[k]].as_py())
        kept = 100 * (longer - apart) // np.maximum(longer, 1)
        return np.where(kept >= LEAST, kept, 0).astype(np.uint8)

    def agreement(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """0 to 100 for words by number, pair by pair."""
        same, lu, lv = u == v, self.length[u], self.length[v]
        out = np.where(same, 100, np.where((np.minimum(lu, lv) == 1) & (self.first[u] == self.first[v]), INITIAL, 0)).astype(np.uint8)
        rest = np.flatnonzero((out == 0) & (5 * np.minimum(lu, lv) >= 3 * np.maximum(lu, lv)))
        a, b = u[rest], v[rest]
        some = self._some(lu[rest], lv[rest], np.bitwise_count(self.bag[a] ^ self.bag[b]))
        out[rest[some]] = self._kept(a[some], b[some])
        return out

    def table(self, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
        """The agreement of each of ``us`` with each of ``vs``, by number."""
        out = np.zeros((len(us), len(vs)), np.uint8)
        small = np.int16 if self.length.max(initial=0) < 3_000 else np.int64
        lv, first, bag = self.length[vs].astype(small), self.first[vs], self.bag[vs]
        step = max(1, 200_000 // max(1, len(vs)))
        for at in range(0, len(us), step):
            own = us[at : at + step]
            lu = self.length[own].astype(small)[:, None]
            i, j = np.nonzero(self._some(lu, lv[None, :], np.bitwise_count(self.bag[own, None] ^ bag[None, :])))
            out[at + i, j] = self._kept(own[i], vs[j])
            i, j = np.nonzero(((lu == 1) | (lv == 1)[None, :]) & (self.first[own, None] == first[None, :]))
            out[at + i, j] = INITIAL
            i, j = np.nonzero(own[:, None] == vs[None, :])
            out[at + i, j] = 100
        return out


def _any_order(s: np.ndarray) -> np.ndarray:
    """The best matchings of rows to columns (``s``: rows, columns, pairs)."""
    if len(s) < s.shape[1]:
        s = s.transpose(1, 0, 2)
    rows, columns, n = s.shape
    best = np.zeros((1 << columns, n), np.int16)
    for r in range(rows):
        now = best.copy()
        for used in range(1 << columns):
            for c in range(columns):
                if used >> c & 1:
                    np.maximum(now[used], best[used ^ 1 << c] + s[r, c], out=now[used])
        best = now
    return best[-1]


def aligned(s: np.ndarray) -> np.ndarray:
    """Scores from the agreements of words (``s``: words of the first name, of the
    second, pairs)."""
    rows, columns, n = s.shape
    s, words = s.astype(np.int16), rows + columns
    best = np.zeros((columns + 1, n), np.int16)
    for r in range(rows):
        last = best[0]
        for c in range(columns):
            before = best[c + 1].copy()
            np.maximum(before, best[c], out=best[c + 1])
            np.maximum(best[c + 1], last + s[r, c], out=best[c + 1])
            last = before
    score = 2 * best[-1] // words
    most = np.minimum(s.max(axis=1).sum(axis=0), s.max(axis=0).sum(axis=0))
    open_ = np.flatnonzero(2 * most // words - TURNED > score)
    if len(open_):
        score[open_] = np.maximum(score[open_], 2 * _any_order(s[:, :, open_]) // words - TURNED)
    return score


class Names:
    """Names as rows of words (a list of strings a row), and their scores."""

    def __init__(self, words: pa.ListArray, *more: pa.ListArray):
        parts = [words, *more]
        coded = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
        self.words = Words(coded.dictionary)
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.size = np.concatenate([pc.list_value_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts])
        self.start = np.cumsum(self.size) - self.size

    def of(self, rows: np.ndarray, k: int) -> np.ndarray:
        """The words of rows that have ``k`` each, a column a row."""
        return self.word[self.start[rows][None, :] + np.arange(k)[:, None]]

    def scores(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """0 to 100 for rows ``p`` and ``q``, pair by pair."""
        out = np.zeros(len(p), np.int32)
        m, n = self.size[p], self.size[q]
        few = (m > 0) & (n > 0) & (m <= WORDS) & (n <= WORDS)
        shape = np.where(few, m * (WORDS + 1) + n, 0).astype(np.uint8)
        order = np.argsort(shape, kind="stable")
        kinds, begin = np.unique(shape[order], return_index=True)
        for kind, a, b in zip(kinds.tolist(), begin, np.r_[begin[1:], len(p)]):
            rows, (x, y) = order[a:b], divmod(kind, WORDS + 1)
            if kind:
                step = max(1, 400_000 // (x * y))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    u, v = (np.broadcast_to(w, (x, y, len(some))).ravel() for w in (self.of(p[some], x)[:, None], self.of(q[some], y)[None, :]))
                    out[some] = aligned(self.words.agreement(u, v).reshape(x, y, len(some)))
                continue
            for k in rows[(m[rows] > 0) & (n[rows] > 0)]:
                u, v = (self.word[self.start[r] : self.start[r] + self.size[r]] for r in (p[k], q[k]))
                out[k] = align(self.words.table(u, v).tolist())
        return out

    def _bounds(self, p: np.ndarray, best: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """What rows ``p`` can score at most with others, if each of their words
        finds the word that agrees ``best`` (words, others)."""
        at = np.searchsorted(known, self.word)
        out = np.empty((len(p), len(sizes)), np.float32)
        for k in np.unique(self.size[p]):
            rows = np.flatnonzero(self.size[p] == k)
            total = np.zeros((len(rows), len(sizes)), np.int32 if k > 300 else np.uint16)
            for j in range(k):
                total += best[at[self.start[p[rows]] + j]]
            out[rows] = total * (2 / (k + sizes)).astype(np.float32)[None, :]
        return out

    def leading(self, p: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of ``p`` and of ``q`` with their scores, among them all pairs that
        score best for their row of ``p``."""
        words = lambda rows: self.word[np.concatenate([np.arange(a, a + n) for a, n in zip(self.start[rows], self.size[rows])])]
        theirs = words(q)
        us, (vs, back) = np.unique(words(p)), np.unique(theirs, return_inverse=True)
        starts = np.cumsum(self.size[q]) - self.size[q]
        best = np.empty((len(us), len(q)), np.uint8)
        step = max(1, 4_000_000 // max(len(theirs), 1))
        for at in range(0, len(us), step):
            best[at : at + step] = np.maximum.reduceat(self.words.table(us[at : at + step], vs)[:, back], starts, axis=1)
        found, step = [], max(1, 2_000_000 // len(q))
        for at in range(0, len(p), step):
            rows = p[at : at + step]
            most = self._bounds(rows, best, self.size[q], us) + 1e-3
            tried = self.scores(rows, q[np.argmax(most, axis=1)])
            i, j = np.nonzero(most >= np.maximum(tried, 1)[:, None])
            found.append((rows[i], q[j], self.scores(rows[i], q[j])))
        return found
