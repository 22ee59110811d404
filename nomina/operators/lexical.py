"""Lexical candidates: an exact similarity join on words, and searching entities
with names and vectors together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpoint
from .alignment import Names, spread
from .scoring import name_words, scored_names, scored_pairs
from .search import neighbours


def _words(name: Column) -> Column:
    return F.array_distinct(text.words(F.lower(name)))


#: Sets of a block, and their words, at most; sets of one that is cut for the sake of more tasks, at least, and blocks then.
BLOCK, TOKENS, LEAST, SPLIT = 32_768, 1_000_000, 1_024, 8
#: Posting rows of the tokens that share a task.
TOGETHER = 20_000
#: Ids of a set that move together; queries, and as many names, of a token that meet in a task.
PIECE, MOST = 512, 8_192
#: Tasks that blocks are dealt to, at most.
TASKS = 4_096
#: Queries, and aliases, whose vectors meet in a task.
MEET = 8_192
_U = np.uint64


def _sketch(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """256 bits a set, one for each of its tokens."""
    h = tokens.astype(_U) * _U(0x9E3779B97F4A7C15)
    bits = np.zeros((n, 4), _U)
    np.bitwise_or.at(bits, (owner, (h >> _U(62)).astype(np.int64)), _U(1) << ((h >> _U(56)) & _U(63)))
    return bits


def _by_rarity(sets: DataFrame, theta: float, *more: str) -> DataFrame:
    """``sets`` (``node``, unique; ``words``: distinct, not null, not empty) with
    ``tokens``, their words by number, rarest first, and ``rarest``: how many of
    these are sure to have one that a set as similar as ``theta`` has as well."""
    sets = checkpoint(sets.select("node", "words", *more))
    frequency = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # Numbers in the order of the words, whatever their partitions.
    numbered = checkpoint(frequency.orderBy("df", "word").select("word", F.monotonically_increasing_id().alias("token")))
    each = sets.select("node", *more, F.explode("words").alias("word")).join(numbered, "word")
    rows = each.groupBy("node", *more).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    few = (F.size("tokens") - F.ceil(F.lit(theta) * F.size("tokens") - 1e-9) + 1).cast("int")
    return rows.withColumn("rarest", few)


def _needed(theta: float, own: int, sizes: np.ndarray) -> np.ndarray:
    """The fewest tokens that a set of ``own`` has in common with sets of ``sizes``
    that are as similar as ``theta``."""
    both = own + sizes
    least = np.maximum(1, np.ceil(theta / (1 + theta) * both)).astype(np.int64)
    for step in (-1, 1):  # what rounding may have moved
        other = least - 1 if step < 0 else least
        enough = other / np.maximum(1, both - other) >= theta
        least = np.where(enough & (other > 0), other, least) if step < 0 else np.where(enough, least, least + 1)
    return least


def _met(tokens: pa.ListArray, left: np.ndarray, right: np.ndarray, theta: float, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a ``left`` and a ``right`` row (``inside``: these are the same rows)
    that are alike, with what they have in common, which is counted for a left row
    and all right ones at once: tokens that many have are rows of a matrix, others
    lists of who has them."""
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    token = tokens.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    left, right = (rows[np.argsort(size[rows], kind="stable")] for rows in (left, right))
    theirs = size[right]
    i, k = next(spread(theirs, int(theirs.sum())), (np.zeros(0, np.int64),) * 2)
    held = token[start[right[i]] + k]
    n = np.bincount(held, minlength=int(token.max(initial=0)) + 1)
    widest = int(max(size[left].max(initial=0), theirs.max(initial=0)))
    kind = np.uint8 if widest < 120 else np.int32
    often = np.argsort(-n, kind="stable")[: max(1, 64_000_000 // (len(right) * np.dtype(kind).itemsize))]
    often = often[n[often] > max(8, len(right) // 64)]
    row = np.full(len(n), -1)
    row[often] = np.arange(len(often))
    matrix = np.zeros((len(often), len(right)), kind)
    dense = row[held] >= 0
    matrix[row[held[dense]], i[dense]] = 1
    held, i = held[~dense], i[~dense]
    order = np.argsort(held, kind="stable")
    who, ends = i[order], np.searchsorted(held[order], np.arange(len(n) + 1))
    common, of, need = np.zeros(len(right), kind), -1, None
    found, waiting = [], 0
    for x in left:
        if size[x] != of:
            of = size[x]
            need = _needed(theta, int(of), theirs).astype(kind)
        common.fill(0)
        for t in token[start[x] : start[x] + of]:
            if row[t] >= 0:
                common += matrix[row[t]]
            elif ends[t] < ends[t + 1]:
                common[who[ends[t] : ends[t + 1]]] += 1
        hit = np.flatnonzero(common >= need)
        if inside:
            hit = hit[right[hit] > x]
        if len(hit):
            found.append((np.full(len(hit), x), right[hit], common[hit].astype(np.int64)))
            waiting += len(hit)
        if waiting >= 100_000:
            yield tuple(np.concatenate(c) for c in zip(*found))
            found, waiting = [], 0
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found))


def _in_blocks(sets: DataFrame, kept: list[str]) -> DataFrame:
    """``sets`` (``node``, ``words``, ``asks``) in blocks, grouped by the pairs of
    blocks that meet (``u <= v``), with ``own``, the block a row is of. Rows that
    don't ask are blocks of their own, which meet those that do, so work follows
    these. Blocks hold some ``BLOCK`` sets of ``TOKENS`` words together."""
    rows = checkpoint(sets.filter(F.size("words") > 0))
    shape = {r["asks"]: (r["n"], r["w"]) for r in rows.groupBy("asks").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("w")).collect()}
    blocks = lambda asks: max(-(-n // min(BLOCK, max(LEAST, n // SPLIT))), -(-w // TOKENS)) if (n := (shape.get(asks) or (0, 0))[0]) and (w := shape[asks][1]) else 0
    a, s = blocks(True), blocks(False)
    if not a:
        rows = rows.limit(0)
    own = F.when(F.col("asks"), F.pmod(F.xxhash64("node"), F.lit(max(1, a)))).otherwise(a + F.pmod(F.xxhash64("node"), F.lit(max(1, s)))).cast("int")
    others = F.when(F.col("asks"), F.lit(a + s)).otherwise(F.lit(a))
    dealt = rows.withColumn("own", own).select(*kept, "own", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    dealt = dealt.select(*kept, "own", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"))
    # What a task reads says little of what it writes, so tasks are not to be merged by that.
    return dealt.repartition(min(max(1, 3 * a * (a + 1 + 2 * s) // 2), TASKS), "u", "v").groupBy("u", "v")


def _sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    own, u, v = part["own"].to_numpy(), part["u"][0].as_py(), part["v"][0].as_py()
    return np.flatnonzero(own == u), np.flatnonzero(own == v), u == v


def similar_sets(sets: DataFrame, theta: float) -> DataFrame:
    """``x, y, jaccard``: pairs, once each and in any order, of the ``sets``
    (``node`` string, unique; ``words``: distinct, not null; ``asks``: one of a
    pair must) whose shares of common words are at least ``theta``, which is
    above 0; sets without words match nothing.

    Sets are dealt to pairs of blocks. A task counts what a set has in common with
    all of a block, token by token, so a pair is met once and candidates are never
    written."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        left, right, inside = _sides(part)
        node, words = part["node"].combine_chunks(), part["words"].combine_chunks()
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        for p, q, c in _met(words, left, right, theta, inside):
            yield pa.RecordBatch.from_arrays([node.take(pa.array(p)), node.take(pa.array(q)), pa.array(c / (size[p] + size[q] - c))], ["x", "y", "jaccard"])

    return _in_blocks(sets, ["node", "words"]).applyInArrow(meet, "x string, y string, jaccard double")


def scored_sets(sets: DataFrame, theta: float, least: int | None = None) -> DataFrame:
    """The pairs that ``similar_sets`` finds among names (``node``) as ``name_a``,
    the first in byte order, ``name_b`` and their ``score``, null where nothing
    agrees; with ``least`` only those that score as much. A pair is scored in the
    task that finds it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        left, right, inside = _sides(part)
        node, names = part["node"].combine_chunks(), Names(part["terms"].combine_chunks())
        rank = np.empty(len(node), np.int64)
        rank[pc.sort_indices(node).to_numpy()] = np.arange(len(node))
        for p, q, _ in _met(part["words"].combine_chunks(), left, right, theta, inside):
            score = names.scores(p, q)
            if least is not None:
                p, q, score = (c[score >= max(1, least)] for c in (p, q, score))
            turned = rank[p] > rank[q]
            a, b = np.where(turned, q, p), np.where(turned, p, q)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(score, mask=score == 0)], ["name_a", "name_b", "score"])

    termed = sets.select("node", "words", "asks", name_words(F.col("node")).alias("terms"))
    return _in_blocks(termed, ["node", "words", "terms"]).applyInArrow(meet, "name_a string, name_b string, score int")


class _Sets:
    """Sets of tokens as they come by Arrow: a list of ids in order a row."""

    def __init__(self, tokens: pa.ListArray, token: np.ndarray, place: np.ndarray):
        self.flat, self.token = tokens.flatten().to_numpy(), token
        self.size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        self.start, self.after = np.cumsum(self.size) - self.size, self.size - place
        self.bits = _sketch(self.flat, np.repeat(np.arange(len(self.size)), self.size), len(self.size))

    def _padded(self, rows: np.ndarray, wide: int) -> np.ndarray:
        at = np.arange(wide)
        return np.where(at < self.size[rows, None], self.flat[np.minimum(self.start[rows, None] + at, len(self.flat) - 1)], -1)

    def alike(self, left: np.ndarray, right: np.ndarray, theta: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a left and a right row that have their token as the first in
        common and are alike, with their similarity. What comes after the token,
        and the bits that differ, bound what two sets can have in common."""
        left, right = (x[np.argsort(self.token[x], kind="stable")] for x in (left, right))
        first, last = (np.searchsorted(self.token[right], self.token[left], side=x) for x in ("left", "right"))
        for i, k in spread(last - first, 200_000):
            p, q = left[i], right[first[i] + k]
            need = theta / (1 + theta) * (self.size[p] + self.size[q]) - 1e-9
            some = np.minimum(self.after[p], self.after[q]) >= need
            p, q, need = p[some], q[some], need[some]
            differ = np.bitwise_count(self.bits[p] ^ self.bits[q]).sum(axis=1, dtype=np.int64)
            some = self.size[p] + self.size[q] - differ >= 2 * need
            p, q = p[some], q[some]
            if not len(p):
                continue
            step = max(1, 500_000 // int(max(self.size[p].max(), self.size[q].max())))
            for at in range(0, len(p), step):
                yield self._compared(p[at : at + step], q[at : at + step], theta)

    def _compared(self, p: np.ndarray, q: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = int(max(self.size[p].max(), self.size[q].max()))
        both = np.sort(np.concatenate([self._padded(p, wide), self._padded(q, wide)], axis=1), axis=1)
        same = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
        common = same.sum(axis=1)
        jaccard = common / (self.size[p] + self.size[q] - common)
        hit = (jaccard >= theta) & (both[np.arange(len(p)), np.argmax(same, axis=1) + 1] == self.token[p])
        return p[hit], q[hit], jaccard[hit]


def _in_pieces(rows: DataFrame, ids: str) -> DataFrame:
    """``node, piece`` and the node's ``ids`` (unique), some ``PIECE`` together. At
    most one row in ``PIECE`` tells how a node is cut and is broadcast."""
    cut = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces")).filter("pieces > 1")
    piece = F.pmod(F.xxhash64(ids), F.coalesce("pieces", F.lit(1))).alias("piece")
    return rows.join(F.broadcast(cut), "node", "left").groupBy("node", piece).agg(F.collect_list(ids).alias(ids))


def similar_names(queries: DataFrame, names: DataFrame, theta: float = 0.5, tokens: Callable[[Column], Column] = _words) -> DataFrame:
    """``query_id, id, jaccard`` of queries and names (``id, name``) whose shares
    of common words, or whatever distinct ``tokens`` a name has, are at least
    ``theta``, which is above 0; names without any match nothing.

    Sets meet at one of their ``n - ceil(theta * n) + 1`` rarest words, of which
    two that similar share one, and in the first that both have. The ids of a set go with
    it, so pairs leave the task that finds them as rows of the result: neither
    pairs of sets nor of ids are ever shuffled. A token that many have is met in
    blocks of ``MOST`` queries and ``MOST`` names."""
    keyed = lambda d, ids: checkpoint(d.select(F.struct(F.col("id")).alias(ids), F.array_sort(tokens(F.col("name"))).alias("node")).filter(F.size("node") > 0))
    asked, stored = _in_pieces(keyed(queries, "askers"), "askers"), _in_pieces(keyed(names, "ids"), "ids")
    pieces = checkpoint(asked.withColumn("asks", F.lit(True)).unionByName(stored.withColumn("asks", F.lit(False)), allowMissingColumns=True))
    rows = checkpoint(pieces.join(_by_rarity(pieces.select("node", F.col("node").alias("words")).distinct(), theta), "node").drop("node"))
    posted = rows.select("asks", "piece", "askers", "ids", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("rarest"))).alias("place", "token"))
    counts = posted.groupBy("token").agg(*[F.sum(F.when(F.col("asks") == asks, F.size(c)).otherwise(0)).alias(n) for asks, c, n in ((True, "askers", "asked"), (False, "ids", "held"))])
    counts = checkpoint(counts.filter("asked > 0 and held > 0"))
    us, vs = (F.ceil(F.col(n) / MOST).cast("int") for n in ("asked", "held"))
    alone = us * vs > 1
    shared, large = counts.agg(F.coalesce(F.sum(F.when(~alone, F.col("asked") + F.col("held"))), F.lit(0)), F.coalesce(F.sum(F.when(alone, us * vs)), F.lit(0))).first()
    bins = 1 + shared // TOGETHER
    shape = counts.select("token", us.alias("us"), vs.alias("vs"), F.when(alone, F.col("token")).otherwise(-1 - F.pmod(F.xxhash64("token"), F.lit(bins))).alias("bin"))
    own, other = F.when(F.col("asks"), F.col("us")).otherwise(F.col("vs")), F.when(F.col("asks"), F.col("vs")).otherwise(F.col("us"))
    dealt = posted.join(shape, "token").withColumn("own", F.pmod(F.xxhash64("tokens", "piece"), own).cast("int"))
    dealt = dealt.select("bin", "asks", "token", "place", "askers", "ids", "tokens", "own", F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    u, v = (F.when(F.col("asks") == asks, F.col("own")).otherwise(F.col("other")) for asks in (True, False))
    dealt = dealt.select("bin", u.alias("u"), v.alias("v"), "asks", "token", "place", "askers", "ids", "tokens")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        token, place, asks = (part[c].to_numpy() for c in ("token", "place", "asks"))
        sets = _Sets(part["tokens"].combine_chunks(), token, place)
        mine, theirs = (part[c].combine_chunks() for c in ("askers", "ids"))
        n, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (mine, theirs))
        query, name = (x.flatten().field(0) for x in (mine, theirs))
        of_query, of_name = np.cumsum(n) - n, np.cumsum(m) - m
        for p, q, s in sets.alike(np.flatnonzero(asks), np.flatnonzero(~asks), theta):
            for i, k in spread(n[p] * m[q], 100_000):
                a, b = of_query[p[i]] + k // m[q[i]], of_name[q[i]] + k % m[q[i]]
                yield pa.RecordBatch.from_arrays([query.take(pa.array(a)), name.take(pa.array(b)), pa.array(s[i])], ["query_id", "id", "jaccard"])

    kind = lambda d: d.schema["id"].dataType.simpleString()
    # What a task reads says little of what it writes, so tasks are not to be merged by that.
    dealt = dealt.repartition(min(bins + large, TASKS), "bin", "u", "v")
    return dealt.groupBy("bin", "u", "v").applyInArrow(meet, f"query_id {kind(queries)}, id {kind(names)}, jaccard double")


def alias_hits(queries: DataFrame, aliases: DataFrame, theta: float, cosine: float, k: int | None, own: bool) -> DataFrame:
    """``query_id, id, gnr, emb``: aliases that a query reaches by name, with
    their graded score, and by vector, with their cosine in hundredths, a row for
    each way. ``own``: whether a query may reach its own id by name."""
    met = similar_names(queries, aliases, theta).select("query_id", "id")
    met = met if own else met.filter("query_id <> id")
    met = met.join(queries.select(F.col("id").alias("query_id"), F.col("name").alias("name_a")), "query_id").join(aliases.select("id", F.col("name").alias("name_b")), "id")
    by_name = scored_names(met, score="gnr").select("query_id", "id", "gnr", F.lit(None).cast("int").alias("emb"))
    near = neighbours(queries, aliases, k, cosine)
    by_vector = near.select("query_id", F.col("feat_id").alias("id"), F.lit(None).cast("int").alias("gnr"), F.floor(100 * F.col("cosine") + 1e-6).cast("int").alias("emb"))
    return by_name.unionByName(by_vector)


def entity_hits(queries: DataFrame, aliases: DataFrame, theta: float = 0.5, cosine: float = 0.43, k: int | None = 100) -> DataFrame:
    """``case_id, entity_id, gnr_score, emb_score, ordinal``: entities that a
    query (``id, entity, name, v``) reaches by name or by vector, each with the
    best scores of its aliases (same columns), 0 to 100, in order of the better
    of them. Names are candidates if they share ``theta`` of their words, and get
    their graded score. Stands in for an engine's search with all candidates."""
    found = alias_hits(queries, aliases, theta, cosine, k, True).join(aliases.select("id", "entity"), "id")
    hits = found.groupBy(F.col("query_id").alias("case_id"), F.col("entity").alias("entity_id")).agg(F.max("gnr").alias("gnr_score"), F.max("emb").alias("emb_score"))
    order = Window.partitionBy("case_id").orderBy(F.desc(F.greatest("gnr_score", "emb_score")), "entity_id")
    return hits.withColumn("ordinal", F.row_number().over(order) - 1)


def search_modes(queries: DataFrame, aliases: DataFrame, theta: float = 0.5, cosine: float = 0.43, k: int | None = 100) -> DataFrame:
    """``case_id, mode, entity_id, gnr_score, emb_score, ordinal``: what each
    query finds by names alone (``name``) and by vectors alone (``emb``), entities
    in order of their best alias's score, ties to smaller ids. A query's own row
    among the aliases counts in neither. An entity that a mode does not reach is
    no hit of it; the other score is null."""
    if k is None:
        # All aliases count, so that the best of each entity can be kept as they come.
        by = lambda hits, mode, score: hits.select("case_id", F.lit(mode).alias("mode"), "entity_id", *[(F.col(score) if c == score else F.lit(None).cast("int")).alias(f"{c}_score") for c in ("gnr", "emb")])
        hits = by(_best_names(queries, aliases, theta), "name", "gnr").unionByName(by(_best_vectors(queries, aliases, cosine), "emb", "emb"))
        order = Window.partitionBy("case_id", "mode").orderBy(F.desc(F.coalesce("gnr_score", "emb_score")), "entity_id")
        return hits.withColumn("ordinal", F.row_number().over(order) - 1)
    found = alias_hits(queries, aliases, theta, cosine, k, False).join(aliases.select("id", F.col("entity").alias("entity_id")), "id")
    mode = F.when(F.col("gnr").isNotNull(), "name").otherwise("emb")
    hits = found.groupBy(F.col("query_id").alias("case_id"), mode.alias("mode"), "entity_id").agg(F.max("gnr").alias("gnr_score"), F.max("emb").alias("emb_score"))
    order = Window.partitionBy("case_id", "mode").orderBy(F.desc(F.coalesce("gnr_score", "emb_score")), "entity_id")
    return hits.withColumn("ordinal", F.row_number().over(order) - 1)


def _best_vectors(queries: DataFrame, aliases: DataFrame, cosine: float) -> DataFrame:
    """``case_id, entity_id, emb``: for each query and entity the best cosine, in
    hundredths, of an alias that is not the query's own, if it reaches ``cosine``.
    A block of queries meets a block of aliases in a task, which keeps the best of
    each entity: at most one row for a query, an entity and a block leaves it."""
    usable = lambda d: d.select("id", "entity", F.col("v").cast("array<double>").alias("v")).filter("v is not null and id is not null")
    asked, held = checkpoint(usable(queries)), checkpoint(usable(aliases))
    parts = lambda d: max(1, -(-d.count() // MEET))
    qs, ts = parts(asked), parts(held)
    deal = lambda d, own, n, other, m: d.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(own == "q").alias("asks"), "id", "entity", "v")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asks, out = part["asks"].to_numpy(bool), []
        q, t = part[asks], part[~asks].sort_values("entity", ignore_index=True)
        if len(q) and len(t):
            x, y, ids, own = np.stack(q["v"].to_numpy()), np.stack(t["v"].to_numpy()), t["id"].to_numpy(), q["id"].to_numpy()
            start = np.flatnonzero(~t["entity"].duplicated().to_numpy())
            entity = t["entity"].iloc[start].to_numpy()
            for at in range(0, len(q), 256):
                s = x[at : at + 256] @ y.T
                s[own[at : at + 256, None] == ids[None, :]] = -np.inf
                best = np.maximum.reduceat(s, start, axis=1)
                i, e = np.nonzero(best >= cosine)
                out.append(pd.DataFrame({"case_id": own[at + i], "entity_id": entity[e], "emb": best[i, e]}))
        return pd.concat(out) if out else pd.DataFrame({"case_id": [], "entity_id": [], "emb": []})

    both = deal(asked, "q", qs, "t", ts).unionByName(deal(held, "t", ts, "q", qs))
    met = both.groupBy("q", "t").applyInPandas(meet, "case_id long, entity_id long, emb double")
    return met.groupBy("case_id", "entity_id").agg(F.floor(100 * F.max("emb") + 1e-6).cast("int").alias("emb"))


def _best_names(queries: DataFrame, aliases: DataFrame, theta: float) -> DataFrame:
    """``case_id, entity_id, gnr``: for each query and entity the best graded
    score of an alias that is not the query's own, among names that share
    ``theta`` of their words. Names are compared and entities gathered before
    queries are: no pair of a query and an alias is made."""
    plain = lambda d: d.filter("name is not null and id is not null")
    owners = checkpoint(plain(aliases).groupBy("name", "entity").agg(F.min("id").alias("least"), F.max("id").alias("most")))
    names = plain(queries).select("name", F.lit(True).alias("asks"), F.lit(False).alias("held")).unionByName(owners.select("name", F.lit(False).alias("asks"), F.lit(True).alias("held")))
    names = checkpoint(names.groupBy(F.col("name").alias("node")).agg(F.max("asks").alias("asks"), F.max("held").alias("held")))
    found = similar_sets(names.select("node", _words(F.col("node")).alias("words"), "asks"), theta).select("x", "y")
    same = names.filter("asks and held").filter(F.size(_words(F.col("node"))) > 0).select(F.col("node").alias("x"), F.col("node").alias("y"))
    scored = checkpoint(scored_pairs(found.union(same), "x", "y").filter("score is not null"))
    turned = scored.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "score")
    near = scored.unionByName(turned).join(owners.withColumnRenamed("name", "y"), "y")
    # A query's own row is one of its own name's; the entity has another if its
    # least or largest id is not the query's.
    self_ = F.col("x") == F.col("y")
    kept = [F.max(F.when(~self_, F.col("score"))).alias("other"), *[F.max(F.when(self_, F.col(c))).alias(n) for c, n in (("score", "own"), ("least", "least"), ("most", "most"))]]
    best = checkpoint(near.groupBy("x", "entity").agg(*kept))
    met = plain(queries).select(F.col("id").alias("case_id"), F.col("name").alias("x")).join(best, "x")
    alone = (F.col("least") == F.col("case_id")) & (F.col("most") == F.col("case_id"))
    gnr = F.greatest("other", F.when(~alone, F.col("own")))
    return met.select("case_id", F.col("entity").alias("entity_id"), gnr.alias("gnr")).filter("gnr is not null")


def searched_results(queries: DataFrame, aliases: DataFrame, theta: float = 0.5, cosine: float = 0.43, k: int | None = 100) -> DataFrame:
    """``case_id, name_rank, emb_rank, name_score, emb_score, name_total,
    emb_total``: where each query's own entity comes up in either mode, null if it
    doesn't, and how many entities do. A row for every query, for the reports of
    ``metrics``."""
    hits = search_modes(queries, aliases, theta, cosine, k)
    cases = queries.select(F.col("id").alias("case_id"), F.col("entity").alias("expected"))
    known = hits.join(cases, "case_id").withColumn("hit", F.col("entity_id") == F.col("expected"))
    of = lambda mode, value: F.max(F.when((F.col("mode") == mode) & F.col("hit"), value))
    totals = [F.count_if(F.col("mode") == m).alias(f"{m}_total") for m in ("name", "emb")]
    ranks = [of(m, F.col("ordinal") + 1).cast("int").alias(f"{m}_rank") for m in ("name", "emb")]
    scores = [of("name", F.col("gnr_score")).alias("name_score"), of("emb", F.col("emb_score")).alias("emb_score")]
    found = known.groupBy("case_id").agg(*ranks, *scores, *totals)
    return cases.select("case_id").join(found, "case_id", "left").na.fill(0, ["name_total", "emb_total"])
