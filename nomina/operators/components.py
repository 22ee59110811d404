"""Connected components of links, from scratch and on top of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, settled

#: Links up to which a round's minima, at most two a link, are broadcast.
FEW = 100_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return row["n"], row["x"], row["y"]


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (``u, v``, of any one type that
    has an order): the least node that a node can reach.

    Each round hangs every node's larger neighbours on its least one, then its
    smaller ones, which leaves stars around the least nodes after some
    log(n) ** 2 rounds (alternating stars). Both are grouped minima and equi-joins.
    Minima of up to ``FEW`` links are broadcast; those of more are written, so that
    the join can split a star with many leaves. The planner's guess of what is left is
    dropped after each round, or its digits would be four times as many. Null ends and loops are ignored.
    Raises if ``rounds`` do not do, rather than return wrong roots."""
    e = links.filter("u is not null and v is not null and u <> v")
    e = settled(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(e)
    for _ in range(rounds):
        if not before[0]:
            return e.toDF("node", "root")
        held, kept = (F.broadcast, lambda df: df) if before[0] <= FEW else (checkpoint, checkpoint)
        around = e.union(e.select("v", "u"))
        least = held(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
        large = kept(e.join(least, "v").select("u", F.col("m").alias("v")).distinct())
        small = held(large.groupBy("u").agg(F.min("v").alias("m")))
        end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        e = settled(large.join(small, "u").select(end.alias("u"), F.col("m").alias("v")).distinct())
        now = _fingerprint(e)
        if now == before:
            return e.toDF("node", "root").union(e.select("v", "v").distinct().toDF("node", "root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged(stored: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components after more ``links`` (``u, v``), given ``stored`` ones (``node,
    root``, a row for every node seen before): ``node, root`` of all nodes, and
    ``root, into`` of the stored components that became part of another.

    Links are lifted to the components of their ends, so work follows the new
    links and not the stored table, which is joined and never iterated over."""
    at = lambda end: stored.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    lifted = links.join(at("u"), "u", "left").join(at("v"), "v", "left")
    lifted = lifted.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    moved = checkpoint(components(lifted).toDF("root", "into"))
    old = stored.join(moved, "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    # What has moved and is no stored component is a node met for the first time.
    roots = stored.select("root").distinct()
    new = moved.join(roots, "root", "left_anti").join(stored.select(F.col("node").alias("root")), "root", "left_anti")
    changed = moved.join(roots, "root").filter("root <> into")
    return old.union(new.toDF("node", "root")), changed
