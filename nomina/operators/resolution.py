"""Entity resolution as records are loaded.

A batch's records meet each other and the stored ones over shared tokens, pairs
are decided by name and, where both have one, by vector, and what is linked joins
the stored entities. Resolving batch after batch gives what resolving all of them
at once would: links depend on two records alone, and entities are components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import checkpoint
from .components import components, merged
from .lexical import scored_sets
from .scoring import name_words

RECORD = ("record_id", "name", "v")


def trigrams(name: Column) -> Column:
    """Distinct three-letter stretches of a name's lower-cased words, each word
    between two marks; tokens that survive a typing error."""
    cut = F.transform(name_words(name), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    of = F.transform(cut, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(of))


def links(batch: DataFrame, stored: DataFrame, share: float = 0.4, least: int = 75, cosine: float = 0.0) -> DataFrame:
    """``u, v``: records of ``batch`` and of ``batch`` or ``stored``
    (``record_id, name, v``, no id in both) that are one entity: their names are
    equal, or share ``share`` of their three-letter stretches and score ``least``,
    while their vectors, if both have one, have a cosine of ``cosine``. A vector
    is its name's: records of one name have one, or null. Records without a name
    link to none.

    A name that thousands have is one name until pairs are known; its records
    hang on the first of them."""
    flagged = lambda rows, new: rows.filter("name is not null and record_id is not null").select(*RECORD, F.lit(new).alias("new"))
    every = flagged(batch, True).unionByName(flagged(stored, False))
    old = F.min(F.when(~F.col("new"), F.col("record_id"))).alias("old")
    names = checkpoint(every.groupBy("name").agg(F.min("record_id").alias("first"), old, F.max("new").alias("met"), F.max("v").alias("v")))
    sets = names.select(F.col("name").alias("node"), trigrams(F.col("name")).alias("words"), F.col("old").isNull().alias("asks"))
    side = lambda s: names.select(F.col("name").alias(f"name_{s}"), F.col("first").alias(f"first_{s}"), F.col("v").alias(f"v_{s}"))
    alike = scored_sets(sets, share, least).join(side("a"), "name_a").join(side("b"), "name_b")
    agree = F.col("v_a").isNull() | F.col("v_b").isNull() | (F.round(vectors.cosine(F.col("v_a"), F.col("v_b")), 6) >= cosine)
    between = alike.filter(agree).select(F.col("first_a").alias("u"), F.col("first_b").alias("v"))
    own = batch.join(names.select("name", "first"), "name").filter("record_id <> first").select(F.col("record_id").alias("u"), F.col("first").alias("v"))
    # Where a new record comes before the stored ones of its name.
    hung = names.filter("met and old <> first").select(F.col("old").alias("u"), F.col("first").alias("v"))
    return between.union(own).union(hung)


def resolve(batch: DataFrame, stored: DataFrame | None = None, **rules: float) -> DataFrame:
    """``record_id, name, v, entity_id``: the stored records and a batch's, with
    the entity each belongs to, which is the least ``record_id`` in it.

    ``stored`` is what an earlier call gave. Entities that a new record connects
    become one, under the least id. A record that comes again with another name or
    vector replaces the stored one, whose entity is resolved again without it.
    Rows that repeat an id within a batch count as one, the least by value; rows
    without an id are left out, rows without a name are entities of their own."""
    plain = batch.select(*RECORD).filter("record_id is not null")
    plain = checkpoint(plain.groupBy("record_id").agg(F.min(F.struct("name", "v")).alias("r")).select("record_id", "r.name", "r.v"))
    if stored is None:
        found = components(links(plain, plain.limit(0), **rules)).withColumnRenamed("node", "record_id")
        return plain.join(found, "record_id", "left").select(*RECORD, F.coalesce("root", "record_id").alias("entity_id"))
    was = stored.select("record_id", F.col("name").alias("was"), F.col("v").alias("was_v"))
    changed = checkpoint(plain.join(was, "record_id").filter(~(F.col("name").eqNullSafe(F.col("was")) & F.col("v").eqNullSafe(F.col("was_v")))).select("record_id"))
    if not changed.isEmpty():
        stored = checkpoint(without(stored, changed, **rules))
    new = checkpoint(plain.join(stored.select("record_id"), "record_id", "left_anti"))
    known = stored.select(F.col("record_id").alias("node"), F.col("entity_id").alias("root"))
    now, _ = merged(known, links(new, stored, **rules))
    every = stored.select(*RECORD).unionByName(new)
    return every.join(now.toDF("record_id", "root"), "record_id", "left").select(*RECORD, F.coalesce("root", "record_id").alias("entity_id"))


def without(stored: DataFrame, gone: DataFrame, **rules: float) -> DataFrame:
    """``stored`` without the records in ``gone`` (``record_id``): entities that
    lose one are resolved again among what is left of them, all others stay."""
    gone = gone.select("record_id").distinct()
    touched = checkpoint(stored.join(gone, "record_id").select("entity_id").distinct())
    left = stored.join(gone, "record_id", "left_anti")
    again = resolve(left.join(touched, "entity_id").select(*RECORD), **rules)
    return left.join(touched, "entity_id", "left_anti").select(*RECORD, "entity_id").unionByName(again)
