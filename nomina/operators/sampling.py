"""Seeded sampling. Rows are ordered by the MD5 of a seed and their key, so that
a draw is the same on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

from .pairs import seeded


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in seeded order, a distributed range sort."""
    return rows.orderBy(seeded(seed, key), key)


def placed(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with their ``place`` in seeded order, from 1. Hashes are counted
    by their first three digits, a table of 4096 rows at most, and rows are
    ordered within those alone, so no task holds all of them."""
    drawn = rows.withColumn("_draw", seeded(seed, key)).withColumn("_cell", F.substring("_draw", 1, 3))
    counts = drawn.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", key))
    return drawn.join(F.broadcast(offsets), "_cell").withColumn("place", F.col("_before") + nth).drop("_draw", "_cell", "_before")


def sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, all if there are fewer; 0 takes all."""
    return rows if n == 0 else shuffled(rows, key, seed).limit(n)


def stratified(analyzed: DataFrame, size: int, key: str, person_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """A sample of persons and organisations by ratio; where one type has too
    few, the other makes up for it. Within a type, three tenths may go to records
    with aliases, two tenths to other than Latin names, the rest to anyone.

    Whoever is drawn is among the first of its type, of those with aliases or of
    those with other names, in seeded order. The records are read once, for their
    keys, draws and two flags; three top-n cuts of these leave a few times ``size``
    keys, from which the quotas are filled, and the chosen keys meet the records
    again. Records with a null key can't be drawn; of those that share a key one is.
    """
    kinds = F.col("record_type").isin("PERSON", "ORGANIZATION")
    flags = (F.coalesce("has_aliases", F.lit(False)).alias("_a"), F.coalesce(F.col("script") != "latin", F.lit(False)).alias("_odd"))
    slim = checkpoint(analyzed.filter(kinds & F.col(key).isNotNull()).select(key, "record_type", seeded(seed, key).alias("_draw"), *flags).dropDuplicates([key]))
    have = {r["record_type"]: r["n"] for r in slim.groupBy("record_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    persons, orgs = have.get("PERSON", 0), have.get("ORGANIZATION", 0)
    p = int(size * person_ratio)
    o = size - p
    if persons < p:
        p = persons
        o = min(size - p, orgs)
    elif orgs < o:
        o = orgs
        p = min(size - o, persons)
    made = [_drawn(slim.filter(F.col("record_type") == kind), target, key) for kind, target in (("PERSON", p), ("ORGANIZATION", o))]
    return analyzed.join(F.broadcast(made[0].unionByName(made[1])), key, "left_semi").dropDuplicates([key])


def _drawn(rows: DataFrame, target: int, key: str) -> DataFrame:
    """``target`` keys of one type, by stratum."""
    order = (F.col("_draw"), F.col(key))
    with_aliases, others = int(target * 0.3), int(target * 0.2)
    cuts = ((F.col("_a"), with_aliases), (F.col("_odd"), with_aliases + others), (F.lit(True), target))
    few = None
    for of, n in cuts:
        part = rows.filter(of).orderBy(*order).limit(n)
        few = part if few is None else few.unionByName(part)
    # From here on a few times ``target`` keys: rank them by stratum.
    few = few.dropDuplicates([key])
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = few.withColumn("_first", F.col("_a") & (nth("_a") <= with_aliases))
    second = first.withColumn("_o", F.col("_odd") & ~F.col("_first")).withColumn("_second", F.col("_o") & (nth("_o") <= others))
    taken = second.withColumn("_taken", F.col("_first") | F.col("_second"))
    all_taken = F.count_if("_taken").over(Window.partitionBy(F.lit(1)))
    chosen = taken.withColumn("_got", all_taken).withColumn("_n", nth("_taken")).filter(F.col("_taken") | (F.col("_n") <= target - F.col("_got")))
    return chosen.select(key)


def priority_split(rows: DataFrame, n: int, priority: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Up to ``share`` of ``n`` from the rows of the highest positive priority,
    equal ones by key; the rest at random from those without any."""
    top = rows.filter(F.col(priority) > 0).orderBy(F.desc(priority), key).limit(int(share * n))
    held = top.count()
    other = sample(rows.filter(F.col(priority) <= 0), n - held, key, seed) if n > held else rows.limit(0)
    return top.unionByName(other)
