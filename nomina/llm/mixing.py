"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is met by as many whole epochs as fit, then by a weighted
sample without replacement: documents in ascending order of the exponential key
-ln(u) / weight, that is descending order of u ** (1 / weight), u uniform from a
hash of the id, until the words left over are filled. The prefix sums are
hierarchical: words are summed by ``(source, key range)`` before anything is
ordered, the range in which the budget runs out is refined the same way, and
single documents are ordered only within the last one. Ranges are even in the
logarithm of the key, whose density is the same for every weight, only shifted: a
last range holds at most three millionths of a source's documents of one weight,
whatever the weights.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, cuts, unused

_WORDS = re.compile(WORD)
#: A key range is split into this many; the first has this many octaves.
FAN, OCTAVES = 4096, 128
#: Sources whose totals may be broadcast.
SOURCES = 100_000


def size(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size, target`` for rows of ``source, source_size``: shares
    of the whole by weight, in order of source with null last, none above
    ``most`` times its size; what is above goes to the others by weight.

    Sources are ranked by ``most * size / weight``: if the one at rank k stays
    at its limit, so do those before it, hence the level is the first at which
    the rest's share, spread by weight, no longer reaches the limit. One row for
    each source; the tables of totals have as many rows as there are sources.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("limit", most * F.col("source_size").cast("double"))
    s = s.withColumn("level", F.col("limit") / F.col("w"))
    order = (F.col("level"), F.col("source").isNull(), F.col("source"))
    by = Window.orderBy(*order)
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("held", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("share", (F.sum("source_size").over(everything) - F.col("held")) / F.col("open"))
    first = F.struct(*order, F.col("share"))
    s = s.withColumn("flow", F.min(F.when(F.col("level") > F.col("share"), first)).over(everything)["share"])
    target = F.when(F.col("flow").isNull() | (F.col("level") <= F.col("flow")), F.col("limit")).otherwise(F.col("flow") * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def uniform(key: str, text: str, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the hash of a seed, a key and the MD5
    of a text; the same in every engine that has MD5."""
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    digits = F.substring(F.md5(named.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _running(rows: DataFrame, by: list[str], order: list[Column]) -> Column:
    return F.sum("s").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _refine(rows: DataFrame, budgets: DataFrame, bin_: str, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``g, edge, left``: for each source, the key range in which its budget ends
    and what remains for it. Ranges are summed before they are ordered."""
    sums = rows.groupBy("g", bin_).agg(F.sum("s").alias("s"))
    run = sums.withColumn("upto", _running(sums, ["g"], [F.col(bin_)])).join(near(budgets), "g")
    edge = run.filter("upto >= left").groupBy("g").agg(F.min(F.struct(F.col(bin_).alias("edge"), (F.col("left") - F.col("upto") + F.col("s")).alias("left"))).alias("x"))
    return edge.select("g", "x.edge", "x.left")


def _place(key: Column) -> Column:
    """The range of a key: even in its logarithm, from 2 ** -64 to 2 ** 64; what
    lies beyond, if anything does, is in the outermost."""
    at = F.floor((F.log2(key) + OCTAVES / 2) * (FAN * FAN / OCTAVES))
    return F.greatest(F.lit(0), F.least(at, F.lit(FAN * FAN - 1))).cast("long")


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``doc_id, row, size, source_size, target, taken`` for each of ``rows``
    with columns ``doc_id, row, source, size, weight, u``: a hash that tells rows
    of an id apart, a quality weight (null or not positive counts as 1e-6) and a
    uniform draw in (0, 1).

    ``taken``: words the mix takes of a document, ``size`` for every whole epoch
    and once more if the sample takes it; the document at which the budget ends
    is cut to what is left, so that a source's words add up to its target,
    rounded down. Empty documents take nothing. Equal keys (rows that repeat an
    id and a text) go by size. A null source is a source; an empty table gives no
    rows.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-6)
    key = -F.log(F.col("u")) / weight
    base = rows.select("doc_id", "row", "source", F.col("size").cast("long").alias("s"), key.alias("key"), _place(key).alias("place"))
    base = checkpoint(base.select("*", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("g")), compact=True)

    sizes = base.groupBy("source").agg(F.sum("s").alias("source_size"))
    aims = checkpoint(targets(sizes, weights, most).select("*", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("g")))
    # A row for each source: few enough are broadcast, more are joined by a shuffle.
    near = F.broadcast if aims.count() <= SOURCES else (lambda df: df)
    plan = aims.withColumn("words", F.floor("target").cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0))
    plan = plan.withColumn("left", F.col("words") - F.col("epochs") * F.col("source_size")).drop("source")

    open_ = plan.filter("left > 0").select("g", "left")
    coarse = _refine(base.withColumn("bin", F.expr(f"place div {FAN}")), open_, "bin", near).withColumnRenamed("edge", "bin_edge")
    inside = base.withColumn("bin", F.expr(f"place div {FAN}")).join(near(coarse.drop("left")), "g").filter("bin = bin_edge")
    fine = checkpoint(_refine(inside, coarse.select("g", "left"), "place", near))

    # Only documents in the last range are ordered one by one.
    last = base.join(near(fine), "g").filter("place = edge")
    order = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("s")]
    last = last.withColumn("got", F.least("s", F.greatest(F.lit(0), F.col("left") - _running(last, ["g"], order) + F.col("s"))))
    rest = base.join(near(fine.select("g", "edge")), "g", "left").filter("edge is null or place <> edge")
    rest = rest.withColumn("got", F.when(F.col("place") < F.col("edge"), F.col("s")).otherwise(0))
    got = rest.select("g", "doc_id", "row", "s", "got").unionByName(last.select("g", "doc_id", "row", "s", "got"))
    taken = (F.col("epochs") * F.col("s") + F.col("got")).cast("long")
    return got.join(near(plan), "g").select("doc_id", "row", F.col("s").alias("size"), "source_size", "target", taken.alias("taken"))


def _row(of: str = "") -> Column:
    """A hash that tells rows of an id apart: of source and text, nulls too."""
    source, text = F.col(f"{of}source"), F.col(f"{of}text")
    return F.xxhash64(source.isNull(), source, text.isNull(), text)


def quality_weights(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, row, source, size, weight, u`` of documents: weight 1 if labelled
    good, 0.1 if labelled bad by any label, 0.5 otherwise; a label without a
    quality, or without an id, is none."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    sized = docs.select("doc_id", _row().alias("row"), "source", size().alias("size"), uniform("doc_id", "text", seed).alias("u"))
    weight = F.when(F.col("_q") >= 1, 1.0).when(F.col("_q") < 1, 0.1).otherwise(0.5)
    return sized.join(marks, "doc_id", "left").select("doc_id", "row", "source", "size", weight.alias("weight"), "u")


def copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` as often as the mix takes them: a row for each whole epoch, and
    one cut after its last taken word where the mix takes a part. Rows alike in
    id, source and text, of which the mix may take different parts, share what
    it takes evenly, rounded down; null ids are an id like others. Texts without
    a word give no row."""
    words = unused("taken", docs.columns)
    taken = mixed.groupBy("doc_id", "row").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("n"))
    taken = checkpoint(taken.select("doc_id", "row", F.expr("t div n").alias(words)).filter(F.col(words) > 0)).alias("mixed")
    same = F.col("docs.doc_id").eqNullSafe(F.col("mixed.doc_id")) & (_row("docs.") == F.col("mixed.row"))
    both = docs.alias("docs").join(taken.hint("shuffle_hash"), same).select("docs.*", words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in cuts(batch.num_rows, batch.column(at), 256):
                part = batch.slice(start, length)
                rows, texts = [], []
                for i, (text, n) in enumerate(zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                    ends = [m.end() for m in _WORDS.finditer(text or "")]
                    while n > 0 and ends:
                        rows.append(i)
                        texts.append(text if n >= len(ends) else text[: ends[n - 1]])
                        n -= len(ends)
                out = part.take(pa.array(rows, pa.int64())).select(docs_names)
                yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))

    docs_names = docs.columns
    return both.mapInArrow(run, docs.schema)
