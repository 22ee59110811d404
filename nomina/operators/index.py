"""A stored vector index: inverted lists with product-quantised residuals.

Vectors are filed by the nearest of some centres. What is left of a vector after
its centre is cut into parts, and each part is a byte: the nearest of 256 words
learned for that part. A table partitioned by cell holds the bytes, another the
vectors. A query reads only the bytes of the cells nearest to it, scores them by
the words they stand for, and then the vectors of the best few, by which it ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .search import Best, centroids

#: Rows that a bounded sample has for centres and words; words of a part.
SAMPLE, WORDS = 20_000, 256
#: Rows of a cell, and queries, that meet in a task.
BLOCK = 16_384
_OUT = "query_id long, feat_id long, near double"


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (2 * x @ words.T - (words * words).sum(axis=1)).argmax(axis=1)


def _words(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Words by k-means over rows."""
    made = x[np.random.default_rng(seed).permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(rounds):
        own = _nearest(x, made)
        sums, counts = np.zeros_like(made), np.bincount(own, minlength=len(made))
        np.add.at(sums, own, x)
        made = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], made)
    return made


@dataclass
class Book:
    """Centres (cells x width) and the words of each part (parts x words x width
    of a part), bounded by their numbers."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.words)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = (x - self.centres[cell]).reshape(len(x), self.parts, -1)
        return np.stack([_nearest(left[:, p], self.words[p]) for p in range(self.parts)], axis=1).astype(np.uint8)


def learn(table: DataFrame, cells: int, parts: int | None, seed: int = 42) -> Book:
    """Centres and words from at most ``SAMPLE`` rows, those with the smallest
    hashes of their id. Without ``parts``, a part is two components, so that bytes
    tell rows apart however many there are."""
    centres = centroids(table, cells, SAMPLE, seed=seed)
    rows = table.filter("v is not null").select("id", "v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in rows], float)
    if not len(x):
        raise ValueError("an index needs vectors to learn from")
    parts = parts or x.shape[1] // (1 if x.shape[1] % 2 else 2)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components can't be cut into {parts} equal parts")
    left = (x - centres[(x @ centres.T).argmax(axis=1)]).reshape(len(x), parts, -1)
    words = [_words(left[:, p], WORDS, 12, seed) for p in range(parts)]
    return Book(centres, np.stack(words))


def _paths(path: str) -> dict[str, str]:
    return {name: f"{path}/{name}" for name in ("codes", "vectors", "book")}


def build(table: DataFrame, path: str, cells: int = 64, parts: int | None = None, seed: int = 42) -> None:
    """Index every row of ``table`` (``id, entity, v``) at ``path``; rows without
    an id or a vector are left out. Overwrites, so a lost job can run again."""
    spark, at = table.sparkSession, _paths(path)
    rows = table.select("id", "entity", F.col("v").cast("array<double>").alias("v")).filter("v is not null and id is not null")
    book = learn(rows, cells, parts, seed)
    kept = [("centre", i, c.tolist()) for i, c in enumerate(book.centres)] + [("word", p * book.words.shape[1] + i, w.tolist()) for p, part in enumerate(book.words) for i, w in enumerate(part)]
    spark.createDataFrame(kept, "kind string, nth int, v array<double>").coalesce(1).write.mode("overwrite").parquet(at["book"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = np.stack(part["v"].to_numpy())
                cell = book.cell(x)
                yield part.assign(cell=cell, code=[c.tobytes() for c in book.codes(x, cell)])

    filed = rows.mapInPandas(run, "id long, entity long, v array<double>, cell long, code binary")
    # Dealt by cell and a part of it, so that a full cell is several files.
    filed = checkpoint(filed).repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8)))
    filed.select("id", "entity", "code", "cell").write.mode("overwrite").partitionBy("cell").parquet(at["codes"])
    filed.select("id", F.col("v").cast("array<float>").alias("v"), "cell").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(at["vectors"])


def book(spark: SparkSession, path: str, parts: int | None = None) -> Book:
    rows = spark.read.parquet(_paths(path)["book"]).orderBy("kind", "nth").collect()
    centres, words = (np.array([r["v"] for r in rows if r["kind"] == kind]) for kind in ("centre", "word"))
    parts = parts or centres.shape[1] // words.shape[1]
    return Book(centres, words.reshape(parts, -1, words.shape[1]))


def search(queries: DataFrame, path: str, k: int, probes: int = 8, again: int = 10, parts: int | None = None) -> DataFrame:
    """``query_id, rank, feat_id, cosine``: for each query (``id, v``) the ``k``
    nearest rows in its ``probes`` nearest cells, by the exact cosine of the
    ``again * k`` that look nearest by their bytes; never its own id. Partitions
    of cells that no query probes are not read."""
    return searched(queries, path, k, probes, again, parts)[0]


def searched(queries: DataFrame, path: str, k: int, probes: int = 8, again: int = 10, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``search``, and what it reads: ``queries, rows`` (query and row pairs that
    there are), ``codes`` and ``vectors`` (those scored by bytes and by vectors)."""
    spark, at = queries.sparkSession, _paths(path)
    held = book(spark, path, parts)
    parts = held.parts

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                near = np.argsort(-(np.stack(part["v"].to_numpy()) @ held.centres.T), axis=1, kind="stable")[:, :probes]
                yield part.loc[part.index.repeat(near.shape[1])].assign(cell=near.ravel())

    asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).filter("v is not null and id is not null")
    sent = checkpoint(asked.mapInPandas(probe, "id long, v array<double>, cell long"))
    # At most one number for each cell of the index.
    wanted = [r["cell"] for r in sent.select("cell").distinct().collect()]
    codes = spark.read.schema("id long, entity long, code binary, cell long").parquet(at["codes"]).filter(F.col("cell").isin(wanted))
    sizes = checkpoint(spark.read.schema("id long, entity long, code binary, cell long").parquet(at["codes"]).groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    asks = sent.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs"))
    shape = F.broadcast(checkpoint(sizes.join(asks, "cell").select("cell", "qs", pieces.alias("ts"))))
    deal = lambda rows, own, n, other, m, *c: rows.join(shape, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other), "id", *c)
    left = deal(sent, "q", "qs", "t", "ts", "v", F.lit(None).cast("binary").alias("code"))
    right = deal(codes, "t", "ts", "q", "qs", F.lit(None).cast("array<double>").alias("v"), "code")

    def score(part: pd.DataFrame) -> pd.DataFrame:
        mine = part["code"].isna().to_numpy()
        q, t = part[mine], part[~mine]
        if not len(q) or not len(t):
            return pd.DataFrame({"query_id": [], "feat_id": [], "near": []})
        code = np.frombuffer(b"".join(t["code"]), np.uint8).reshape(len(t), parts)
        best = Best(q.assign(entity=0), again * k, None, False, None)
        for at in range(0, len(t), 4096):
            # What the bytes stand for; the sum of its words' products.
            near = held.words[np.arange(parts), code[at : at + 4096]].reshape(-1, held.centres.shape[1]) + held.centres[int(part["cell"].iloc[0])]
            best.meet(t.iloc[at : at + 4096][["id"]].assign(entity=0, v=list(near)))
        return best.end().rename(columns={"cosine": "near"})

    looked = left.unionByName(right).groupBy("cell", "q", "t").applyInPandas(score, _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "feat_id")
    few = checkpoint(looked.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= again * k).select("query_id", "feat_id"))
    vectors = spark.read.schema("id long, v array<float>, cell long").parquet(at["vectors"]).filter(F.col("cell").isin(wanted))
    both = few.join(vectors.select(F.col("id").alias("feat_id"), F.col("v").alias("tv")), "feat_id").join(asked.select(F.col("id").alias("query_id"), "v"), "query_id")
    dot = F.aggregate(F.zip_with("v", "tv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "feat_id"))
    found = both.select("query_id", "feat_id", dot.alias("cosine")).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "feat_id", "cosine")
    read = sent.join(F.broadcast(sizes), "cell").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("codes"))
    whole = asked.agg(F.count(F.lit(1)).alias("queries")).crossJoin(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    told = whole.crossJoin(read).crossJoin(few.agg(F.count(F.lit(1)).alias("vectors"))).select("queries", (F.col("queries") * F.col("n")).alias("rows"), "codes", "vectors")
    return found, told
