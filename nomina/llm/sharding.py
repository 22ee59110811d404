"""Shard placement by a permutation-filled lookup table (as in Maglev).

Each shard has a permutation of the slots of a prime-sized table, from two
hashes of its name. Shards take turns claiming their most preferred slot that is
still free until none is, so all own nearly as many, and adding or removing a
shard moves few others' slots. A row's place is then one look-up in the table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables have at most this many slots, so they may be broadcast.
LARGEST = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int) -> list[int]:
    """The owner of each slot, as a position in ``shards``."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than the slots")
    if slots > LARGEST or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime up to {LARGEST}")
    nth = [_hash(f"offset|{s}") % slots for s in shards]
    skip = [_hash(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while owner[nth[k]] >= 0:
            nth[k] = (nth[k] + skip[k]) % slots
        owner[nth[k]] = k
    return owner


def slot(key: Column, slots: int) -> Column:
    """A key's slot, from 60 bits of its MD5; null counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """``slot, shard``: ``slots`` rows."""
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(fill(shards, slots))], "slot int, shard string")


def place(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, replacing columns of these names.

    Equal keys go to one shard, null keys to the empty string's; an empty table
    stays empty. The table is broadcast, as ``slots`` bounds it: no row moves,
    so the share of a hot key costs nothing here.
    """
    placed = rows.withColumn("slot", slot(F.col(key), slots)).drop("shard")
    return placed.join(F.broadcast(table(rows.sparkSession, shards, slots)), "slot")
