"""Connected components by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, checkpoint, single


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.bit_xor(F.xxhash64("v", "u", F.lit(7))).alias("y"),
    ).first()
    return row["n"], row["x"], row["y"]


def connected_components(edges: DataFrame, rounds: int = 40, few: int = FEW) -> DataFrame:
    """``(u, v)`` long pairs, in either direction, to ``(node, root)``: for each
    node on an edge to another node, the smallest node it can reach.

    Every round links each node's larger neighbours to the smallest one, then
    its smaller ones; both steps keep connectivity, need only grouped minima and
    equi-joins, and leave stars around the minima after O(log^2 n) rounds. Up to
    ``few`` edges are one partition, whose rounds broadcast their minima and
    shuffle nothing; beyond that minima are written out, so that the join can
    split a star with many leaves. Null ends
    and self-loops are ignored; no edges give no rows. Raises if ``rounds`` is
    not enough, rather than return wrong roots.
    """
    e = edges.filter("u is not null and v is not null and u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    for _ in range(rounds):
        if not before[0]:
            break
        e = single(e, before[0]) if before[0] <= few else e
        held = F.broadcast if before[0] <= few else checkpoint
        least = e.select(both.alias("e")).select("e.*").groupBy("u").agg(F.min("v").alias("m"))
        least = held(least.select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = e.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        large = large if before[0] <= few else checkpoint(large)
        small = held(large.groupBy("u").agg(F.min("v").alias("m")))
        rest = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpoint(rest.distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", "v").distinct().toDF("node", "root")
    )
