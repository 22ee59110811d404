"""A graded name score by token alignment, and names against whole entities.

Words of two names are matched one to one. Equal words agree by 100, an initial
and a word that begins with it by 80, others by the share of letters that an edit
leaves alone, if that is 60 or more. The score is twice the agreement of the best
matching, spread over the words of both names; a matching that does not keep the
order of words costs 5. Word agreements are column expressions; the matching is
an Arrow kernel over distinct pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import checkpoint
from .alignment import INITIAL, LEAST, TURNED, Names, align, in_any_order, in_order  # noqa: F401

#: Names, and aliases, of an entity that meet in a task; names and aliases of the entities that share one.
MOST, TOGETHER = 4_096, 20_000
#: Pairs of an entity that are listed rather than bounded first.
LISTED = 2_048
#: Tasks that entities are dealt to, at most.
TASKS = 4_096


def name_words(name: Column) -> Column:
    """Lower-cased words without the dots and commas around them."""
    bare = F.transform(text.words(F.lower(name)), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    return F.filter(bare, lambda w: w != "")


def word_agreement(u: Column, v: Column) -> Column:
    """How far two words agree, 0 to 100."""
    longer = F.greatest(F.char_length(u), F.char_length(v))
    shorter = F.least(F.char_length(u), F.char_length(v))
    initial = (shorter == 1) & (F.left(u, F.lit(1)) == F.left(v, F.lit(1)))
    kept = F.floor(F.lit(100) * (longer - F.levenshtein(u, v)) / longer)
    return F.when(u == v, 100).when(initial, INITIAL).when(kept >= LEAST, kept).otherwise(0).cast("int")


def scored_pairs(pairs: DataFrame, a: str = "name_a", b: str = "name_b", score: str = "score") -> DataFrame:
    """Distinct pairs of names (``a, b``, neither null) with their ``score``, 0 to
    100, null where nothing agrees or a name has no word. Nothing is moved."""
    table = pairs.select(F.col(a).alias("_x"), F.col(b).alias("_y"), name_words(F.col(a)).alias("u"), name_words(F.col(b)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.num_rows
            found = Names(part["u"], part["v"]).scores(np.arange(n), n + np.arange(n))
            yield pa.RecordBatch.from_arrays([part["_x"], part["_y"], pa.array(found, mask=found == 0)], [a, b, score])

    return table.mapInArrow(run, f"`{a}` string, `{b}` string, `{score}` int")


def scored_names(pairs: DataFrame, a: str = "name_a", b: str = "name_b", score: str = "score") -> DataFrame:
    """``pairs`` with the ``score`` of two of their columns, 0 to 100, null where
    nothing agrees or a name is null or has no word. Each distinct pair is
    scored once, in either order, and joined back."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))
    distinct = pairs.filter(both).select(x.alias("_x"), y.alias("_y")).distinct()
    known = scored_pairs(distinct, "_x", "_y", score).filter(F.col(score) > 0)
    return pairs.join(known, (x == F.col("_x")) & (y == F.col("_y")), "left").drop("_x", "_y")


def agreeing_words(a: Column, b: Column) -> Column:
    """Words of ``a`` that some word of ``b`` agrees with, as evidence."""
    other = name_words(b)
    return F.filter(name_words(a), lambda u: F.exists(other, lambda v: word_agreement(u, v) > 0))


def why(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names against whole entities: ``pairs`` (``name, entity`` and others) with
    the ``score`` and ``bucket`` of the entity's alias (``entity, name``) that
    scores best, the first in byte order on ties, that ``alias``, and the words of
    the name that ``agree`` with it.

    Each distinct (name, entity) is looked up once and remembered for all its
    pairs. The names asked of an entity meet its aliases in blocks of ``MOST``;
    their words are compared once, which bounds what each pair can score, and the
    pairs that may be a name's best are scored. Pairs of names are never written.
    A row without a name, an entity or an agreeing alias has nulls."""
    listed = lambda rows, asks: rows.select("name", "entity", F.lit(asks).alias("asks")).filter("name is not null and entity is not null").distinct()
    rows = listed(pairs, True).unionByName(listed(aliases, False)).withColumn("words", name_words(F.col("name"))).filter("size(words) > 0")
    rows = checkpoint(rows)
    counts = rows.groupBy("entity").agg(F.count_if("asks").alias("asked"), F.count_if(~F.col("asks")).alias("held")).filter("asked > 0 and held > 0")
    counts = checkpoint(counts.select("*", F.monotonically_increasing_id().alias("no")))
    us, vs = (F.ceil(F.col(n) / MOST).cast("int") for n in ("asked", "held"))
    alone = F.col("asked") + F.col("held") > TOGETHER // 10
    shared, large = counts.agg(F.coalesce(F.sum(F.when(~alone, F.col("asked") + F.col("held"))), F.lit(0)), F.coalesce(F.sum(F.when(alone, us * vs)), F.lit(0))).first()
    bins = 1 + shared // TOGETHER
    shape = counts.select("entity", "no", us.alias("us"), vs.alias("vs"), F.when(alone, F.col("no")).otherwise(-1 - F.pmod(F.xxhash64("no"), F.lit(bins))).alias("bin"))
    own, other = F.when(F.col("asks"), F.col("us")).otherwise(F.col("vs")), F.when(F.col("asks"), F.col("vs")).otherwise(F.col("us"))
    dealt = rows.join(shape, "entity").withColumn("own", F.pmod(F.xxhash64("name"), own).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    u, v = (F.when(F.col("asks") == asks, F.col("own")).otherwise(F.col("other")) for asks in (True, False))
    dealt = dealt.select("bin", u.alias("u"), v.alias("v"), "no", "asks", "name", "entity", "words")
    kind = pairs.schema["entity"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        name, entity, names = part["name"].combine_chunks(), part["entity"].combine_chunks(), Names(part["words"].combine_chunks())
        rank = np.empty(len(name), np.int64)
        rank[pc.sort_indices(name).to_numpy()] = np.arange(len(name))
        no, asks = part["no"].to_numpy(), part["asks"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(no, kind="stable")
        few, found = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(no[order])) + 1):
            p, q = rows[asks[rows]], rows[~asks[rows]]
            if len(p) * len(q) <= LISTED:
                few.append((np.repeat(p, len(q)), np.tile(q, len(p))))
            else:
                found += names.leading(p, q)
        if few:
            p, q = (np.concatenate(c) for c in zip(*few))
            found.append((p, q, names.scores(p, q)))
        p, q, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((rank[q], -score, p))
        first = order[np.r_[True, p[order][1:] != p[order][:-1]]] if len(order) else order
        first = first[score[first] > 0]
        take = pa.array(p[first])
        yield pa.RecordBatch.from_arrays([name.take(take), entity.take(take), name.take(pa.array(q[first])), pa.array(score[first])], ["name", "entity", "alias", "score"])

    out = T.StructType([T.StructField("name", T.StringType()), T.StructField("entity", kind), T.StructField("alias", T.StringType()), T.StructField("score", T.IntegerType())])
    met = dealt.repartition(min(3 * (bins + large), TASKS), "bin", "u", "v").groupBy("bin", "u", "v").applyInArrow(run, out)
    best = met.groupBy("name", "entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "alias")).alias("b"))
    memo = best.select("name", "entity", (-F.col("b.s")).alias("score"), F.col("b.alias").alias("alias"))
    memo = memo.withColumn("bucket", text.bucket(F.col("score"))).withColumn("agree", agreeing_words(F.col("name"), F.col("alias")))
    return pairs.join(memo, ["name", "entity"], "left")
