"""Exact top-k inner products by the threshold algorithm of Fagin, Lotem and Naor.

Vectors are dealt into cells around centres, and cells into blocks. In a cell a
vector is its centre plus a rest, which is told along a few principal axes and by
the length of what these leave over. A block keeps one sorted list for each axis
and one for that length. A query reads all lists in step, an axis from the large
end where the query is positive and from the small end where it is negative; rows
that come up are scored whole, by exact integers, and the search ends once the
most that any unseen row can score, which follows from the values now reached, is
below the query's k-th best score. That score, its floor, is carried along: every
query first searches its own cell, and then only the cells whose first values
don't rule them out.

Centres and axes come from a bounded sample and decide how much is read, never
what is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint

_NONE = -(1 << 63) + 1  # below any score: no floor
#: Lists are read to these depths, then whole.
DEPTHS = (64, 256, 1024)
#: Queries that a task searches at once.
AT_ONCE = 256


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v, n``: components as floor(scale * x), x as double, and how many
    rows have this id and these components. Rows with a null id, or null, empty
    or not finite in part, are left out. Raises where components are so large
    that an inner product could leave 64 bits."""
    x = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    usable = usable.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    largest = F.array_max(F.transform("x", lambda c: F.abs(c) * scale + 1))
    fits = F.size("x") * largest * largest < float(1 << 62)
    checked = F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("inner products of these vectors don't fit 64 bits")).cast("array<double>"))
    whole = usable.select("vec_id", F.transform(checked, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return whole.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Space:
    """Centres of the cells and axes through them, for vectors of one length."""

    centres: np.ndarray  # cells x length
    axes: np.ndarray  # axes x length, orthonormal

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of the nearest centre."""
        half = (self.centres**2).sum(axis=1) / 2
        return np.concatenate([(x[at : at + 4096] @ self.centres.T - half).argmax(axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Along the axes, and the length of what is left."""
        along = x @ self.axes.T
        return along, np.linalg.norm(x - along @ self.axes, axis=1)


def fit(x: np.ndarray, cells: int, axes: int, seed: int = 42) -> Space:
    """Centres by a few rounds of k-means, axes by the spread about them."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        space = Space(centres, np.zeros((0, x.shape[1])))
        own = space.cells(x)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    rest = x - centres[Space(centres, space.axes).cells(x)]
    _, _, turned = np.linalg.svd(rest.T @ rest)
    return Space(centres, turned[: min(axes, x.shape[1])])


def slack(q: np.ndarray, size: float) -> np.ndarray:
    """What rounding may add to a bound; ``size`` is the largest length met."""
    return 1e-9 * (np.linalg.norm(q, axis=1) * size + 1.0)


class Lists:
    """A block's vectors (each with the number of rows it stands for) and its
    sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, centre: np.ndarray, axes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.copies, self.centre = ids[order], x[order], copies[order], centre
        self.space = Space(centre[None, :], axes)
        both = np.c_[self.space.parts(self.x - centre)]
        up = np.argsort(both, axis=0, kind="stable")
        self.values = np.take_along_axis(both, up, axis=0)
        n = len(ids)
        self.place = np.empty((both.shape[1], n), np.int16 if n < 32_000 else np.int32)
        for c in range(both.shape[1]):
            self.place[c, up[:, c]] = np.arange(n)
        self.size = float(np.linalg.norm(centre) + np.sqrt((both**2).sum(axis=1).max(initial=0)))
        self.largest = int(np.abs(self.x).max(initial=0))
        #: Rows scored so far, for tests and reports.
        self.scored = 0

    def search(self, own: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, scores and how many rows each stands for, of each query: the
        ``k`` best that reach the query's floor, best first, ties to smaller ids.
        The query itself, the row of its id and components, is left out."""
        n, kind = len(self.ids), self._exact(q)
        x, asked = self.x.astype(kind), q.astype(kind)
        weight = np.c_[self.space.parts(q.astype(float))]
        base = q @ self.centre + slack(q, self.size)
        least = -np.inf if kind != np.int64 else np.iinfo(np.int64).min
        scores, floors = np.full((len(q), n), least, kind), floors.copy()
        # The depth at which a query's lists first show a row.
        first = np.full((len(q), n), n, self.place.dtype)
        for c, place in enumerate(self.place):
            shown = np.where((weight[:, c] > 0)[:, None], n - 1 - place, place)
            np.minimum(first, shown, out=first, where=(weight[:, c] != 0)[:, None])
        first[~weight.any(axis=1)] = 0
        itself = self._itself(own, q)
        for i, row in itself.items():
            if self.copies[row] == 1:
                first[i, row] = n + 1
        live, depth = np.arange(len(q)), 0
        for until in (*(d for d in DEPTHS if d < n), n + 1):
            at = min(depth, n - 1)
            reach = np.where(weight[live] > 0, self.values[n - 1 - at], self.values[at])
            live = live[base[live] + (weight[live] * reach).sum(axis=1) >= floors[live]]
            if not len(live):
                break
            new = (first[live] >= depth) & (first[live] < until)
            self.scored += int(new.sum())
            came = np.flatnonzero(new.any(axis=0))
            here = np.ix_(live, came)
            scores[here] = np.where(new[:, came], asked[live] @ x[came].T, scores[here])
            if n >= k:
                kth = np.partition(scores[live], n - k, axis=1)[:, n - k]
                floors[live] = np.maximum(floors[live], np.where(kth > least, kth, _NONE).astype(np.int64))
            depth = until
        out = []
        for i, (s, floor) in enumerate(zip(scores, floors)):
            rows = np.flatnonzero((s >= floor) & (s > least))
            best = rows[np.lexsort((self.ids[rows], -s[rows]))[:k]]
            out.append((best, s[best].astype(np.int64), self.copies[best] - (best == itself.get(i, -1))))
        return out

    def _exact(self, q: np.ndarray) -> np.dtype:
        """The fastest kind of number in which these products are exact."""
        most = len(self.centre) * self.largest * int(np.abs(q).max(initial=0))
        return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)

    def _itself(self, own: np.ndarray, q: np.ndarray) -> dict[int, int]:
        low, high = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        return {i: row for i in np.flatnonzero(high > low).tolist() for row in range(low[i], high[i]) if (self.x[row] == q[i]).all()}


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> list[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors ``v`` are of one length."""
    dims = np.asarray(batch.column("v").value_lengths())
    return [(int(d), batch.filter(pa.array(dims == d))) for d in np.unique(dims)]


def _space(spaces: dict[int, Space], dim: int) -> Space:
    """Lengths that the sample lacks make one cell, without axes."""
    return spaces.get(dim) or Space(np.zeros((1, dim)), np.zeros((0, dim)))


def spaces(vectors: DataFrame, n: int, cells: int | None, axes: int, sample: int) -> dict[int, Space]:
    """A space for each length of vector, from at most ``sample`` of them."""
    rows = bounded_sample(vectors.select("vec_id", "v"), "vec_id", sample).collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["vec_id"], r["v"])):
        found.setdefault(len(r["v"]), []).append(r["v"])
    share = cells or min(256, max(1, n // 2048))
    return {dim: fit(np.array(v, float), max(1, share * len(v) // len(rows)), axes) for dim, v in found.items()}


def _bounds(space: Space, q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that a row of each cell can score, for each query; ``high`` and
    ``low``: the cells' largest and smallest values, by axis and of the rest."""
    weight = np.c_[space.parts(q)]
    size = float(np.linalg.norm(space.centres, axis=1).max() + np.linalg.norm(np.maximum(np.abs(high), np.abs(low)), axis=1).max())
    out = q @ space.centres.T + slack(q, size)[:, None]
    return out + np.where(weight > 0, weight, 0.0) @ high.T + np.where(weight < 0, weight, 0.0) @ low.T


def top_k(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    scale: int = 64,
    block: int = 4096,
    queries: int = 4096,
    cells: int | None = None,
    axes: int = 16,
    sample: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every``, the ``k`` other rows of the largest integer inner product, all if
    there are fewer, ties to smaller ids.

    Rows that repeat an id are rows like others: each asks, if the id is one of a
    query, and each can be found. Only vectors of equal length meet. Null ids,
    and vectors that are null, empty or hold null or non-finite components, take
    no part; an empty table gives no rows. Only ``vec_id`` and ``embedding`` are
    read.

    A task holds one block of about ``block`` vectors and at most ``queries`` of
    the queries, whatever the table's size; rows that are alike in all are one.
    The driver gets ``sample`` vectors, and totals for each of the cells, of
    which there is one for 2,048 vectors, up to 256.
    """
    rows = checkpoint(quantised(vectors, scale))
    n = rows.count()
    known = spaces(rows, n, cells, axes, sample)
    wide = max((len(s.axes) for s in known.values()), default=0) + 1
    ends = [f"{side}{c}" for side in ("high", "low") for c in range(wide)]

    def deal(batches):
        for batch in batches:
            for dim, part in _by_length(batch):
                own = _space(known, dim).cells(_matrix(part.column("v"), dim).astype(float))
                made = [pa.array(np.full(len(own), dim, np.int32)), pa.array(own.astype(np.int32)), *(part.column(c) for c in ("vec_id", "v", "n"))]
                yield pa.RecordBatch.from_arrays(made, names=["dim", "cell", "vec_id", "v", "n"])

    dealt = checkpoint(rows.mapInArrow(deal, "dim int, cell int, vec_id long, v array<long>, n long"))

    def measure(batches):
        for batch in batches:
            for dim, part in _by_length(batch):
                space, x, cell = _space(known, dim), _matrix(part.column("v"), dim), part.column("cell").to_numpy()
                both = np.c_[space.parts(x - space.centres[cell])]
                both = np.pad(both, ((0, 0), (0, wide - both.shape[1])))
                asks = part.column("vec_id").to_numpy() % every == 0
                for c in np.unique(cell):
                    mine = cell == c
                    totals = [[dim], [c], [mine.sum()], [(mine & asks).sum()]]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(v, t) for v, t in zip(totals, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))), *(pa.array([v], pa.float64()) for v in [*both[mine].max(axis=0), *both[mine].min(axis=0)])],
                        names=["dim", "cell", "n", "asks", *ends],
                    )

    partial = dealt.mapInArrow(measure, "dim int, cell int, n long, asks long, " + ", ".join(f"{e} double" for e in ends))
    whole = partial.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.sum("asks").alias("asks"), *(F.max(e) if e[0] == "h" else F.min(e) for e in ends)).collect()
    met: dict[int, dict] = {}
    for dim in {r[0] for r in whole}:
        own = sorted((tuple(r) for r in whole if r[0] == dim), key=lambda r: r[1])
        m = len(_space(known, dim).axes) + 1
        ranges = np.array([r[4:] for r in own])
        met[dim] = {
            "cells": np.array([r[1] for r in own]),
            "salts": np.array([math.ceil(r[2] / block) for r in own]),
            "asks": np.array([r[3] for r in own]),
            "high": ranges[:, :m],
            "low": ranges[:, wide : wide + m],
        }
    # A vector's block in its cell, and a query's share of the queries.
    hashed = dealt.withColumn("place", F.pmod(F.xxhash64(F.lit(11), "vec_id", "v"), F.lit(1 << 30)))
    asked = hashed.filter(F.pmod("vec_id", F.lit(every)) == 0)
    columns = "dim int, cell int, salt int, share int, asks boolean, place long, vec_id long, v array<long>, n long, floor long"
    names = [c.split()[0] for c in columns.split(", ")]

    def sent(part, dim, cell, salt, share, asks, at, floor):
        """Rows ``at`` of a batch, for these blocks."""
        picked = part.take(pa.array(at, pa.int64()))
        same = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), (len(at),)), t)
        made = {"dim": same(dim, pa.int32()), "cell": same(cell, pa.int32()), "salt": same(salt, pa.int32()), "share": same(share, pa.int32()), "asks": same(asks, pa.bool_()), "floor": same(floor, pa.int64())}
        return pa.RecordBatch.from_arrays([made[c] if c in made else picked.column(c) for c in names], names=names)

    def answer(t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        asks = t.column("asks").to_numpy()
        if asks.any() and not asks.all():
            dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
            space = _space(known, dim)
            x = _matrix(t.column("v"), dim)
            ids, place, copies, floor = (t.column(c).to_numpy() for c in ("vec_id", "place", "n", "floor"))
            lists = Lists(ids[~asks], x[~asks], copies[~asks], space.centres[cell], space.axes)
            own, q, low, name = ids[asks], x[asks], floor[asks], place[asks]
            for at in range(0, len(own), AT_ONCE):
                few = slice(at, at + AT_ONCE)
                for i, (best, scores, counts) in enumerate(lists.search(own[few], q[few], low[few], k)):
                    for c, v in zip(out, (np.full(len(best), own[at + i]), np.full(len(best), name[at + i]), lists.ids[best], scores, counts)):
                        c.append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in zip(("query_id", "place", "vec_id", "score", "n"), out)})

    def found(pairs: DataFrame, counts: dict[tuple[int, int], int]) -> DataFrame:
        """Answers to ``pairs``, queries sent to blocks; ``counts``: how many a
        cell gets, for the shares that its blocks are sent to."""
        shares = {key: math.ceil(v / queries) for key, v in counts.items()}

        def stored(batches):
            for batch in batches:
                for dim, part in _by_length(batch):
                    cell, place = part.column("cell").to_numpy(), part.column("place").to_numpy()
                    salts = dict(zip(met[dim]["cells"].tolist(), met[dim]["salts"].tolist()))
                    times = np.array([shares.get((dim, c), 0) for c in cell.tolist()], np.int64)
                    at = np.repeat(np.arange(len(cell)), times)
                    if len(at):
                        share = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                        salt = (place % np.array([salts[c] for c in cell.tolist()]))[at]
                        yield sent(part, dim, cell[at], salt, share, False, at, 0)

        def shared(batches):
            for batch in batches:
                share = [p % shares[key] for p, key in zip(batch.column("place").to_pylist(), zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist()))]
                yield batch.set_column(names.index("share"), "share", pa.array(share, pa.int32()))

        both = hashed.mapInArrow(stored, columns).unionByName(pairs.mapInArrow(shared, columns))
        return both.groupBy("dim", "cell", "salt", "share").applyInArrow(answer, "query_id long, place long, vec_id long, score long, n long")

    def home(batches):
        for batch in batches:
            for dim, part in _by_length(batch):
                cell = part.column("cell").to_numpy()
                salts = dict(zip(met[dim]["cells"].tolist(), met[dim]["salts"].tolist()))
                times = np.array([salts[c] for c in cell.tolist()], np.int64)
                at = np.repeat(np.arange(len(cell)), times)
                yield sent(part, dim, cell[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), 0, True, at, _NONE)

    near = checkpoint(found(asked.mapInArrow(home, columns), {(d, int(c)): int(a) for d, x in met.items() for c, a in zip(x["cells"], x["asks"])}))
    key = Window.partitionBy("query_id", "place")
    best = key.orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, 0)
    kth = near.withColumn("upto", F.sum("n").over(best)).filter(F.col("upto") >= k).groupBy("query_id", "place").agg(F.max("score").alias("floor"))
    floors = kth.select(F.col("query_id").alias("vec_id"), "place", "floor")
    ready = asked.join(floors, ["vec_id", "place"], "left").select("dim", "cell", "vec_id", "v", "n", "place", F.coalesce("floor", F.lit(_NONE)).alias("floor"))

    def others(batches):
        for batch in batches:
            for dim, part in _by_length(batch):
                x = met[dim]
                floor, cell = part.column("floor").to_numpy(), part.column("cell").to_numpy()
                bound = _bounds(_pick(_space(known, dim), x["cells"]), _matrix(part.column("v"), dim).astype(float), x["high"], x["low"])
                at, to = np.nonzero((bound >= floor[:, None]) & (x["cells"][None, :] != cell[:, None]))
                times = x["salts"][to]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, to = np.repeat(at, times), np.repeat(to, times)
                if len(at):
                    yield sent(part, dim, x["cells"][to], salt, 0, True, at, floor[at])

    pairs = checkpoint(ready.mapInArrow(others, columns))
    counts = {(r[0], r[1]): r[2] for r in pairs.filter("salt = 0").groupBy("dim", "cell").count().collect()}
    every_one = near.unionByName(found(pairs, counts))
    # As many copies as can be in an answer, then one row for each.
    many = every_one.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))))
    rank = F.row_number().over(key.orderBy(F.desc("score"), "vec_id"))
    ranked = many.select("query_id", "place", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    again = asked.filter("n > 1").select(F.col("vec_id").alias("query_id"), "place", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy"))
    more = ranked.join(again, ["query_id", "place"])
    answers = ranked.select("query_id", "rank", "vec_id", "score")
    return answers.unionByName(more.select(*answers.columns))


def _pick(space: Space, cells: np.ndarray) -> Space:
    return Space(space.centres[cells], space.axes)
