"""Name pairs: making them within and across entities, scoring them, and mining
training triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts, text, vectors
from .ranking import first_n, keep_first
from .scoring import scored_names
from .search import similarity_join

PAIR = ("name_a", "name_b", "entity_a", "entity_b", "same_entity", "pair_type")


def within_entity(aliases: DataFrame, most: int = 6, cross_first: bool = True) -> DataFrame:
    """Pairs i < j of an entity's aliases (``entity, ord, name, script``), those
    across scripts before others, at most ``most`` for each entity.

    If a pair holds the r-th alias of a script, each earlier one of that script
    makes an earlier pair of the same kind with the other alias, so r is at most
    ``most + 1``: the others are cut before the join, which an entity of any size
    then enters with a few rows for each script."""
    aliases = first_n(aliases, ["entity", "script"], ["ord"], most + 1)
    a = aliases.select("entity", F.col("ord").alias("i"), F.col("name").alias("name_a"), F.col("script").alias("sa"))
    b = aliases.select("entity", F.col("ord").alias("j"), F.col("name").alias("name_b"), F.col("script").alias("sb"))
    pairs = a.join(b, "entity").filter("i < j").withColumn("cross", scripts.differs(F.col("sa"), F.col("sb")))
    order = ([F.desc("cross")] if cross_first else []) + [F.col("i"), F.col("j")]
    few = first_n(pairs, ["entity"], order, most)
    kind = F.when(F.col("cross"), "within_entity_cross_script").otherwise("within_entity_same_script")
    return few.select("name_a", "name_b", F.col("entity").alias("entity_a"), F.col("entity").alias("entity_b"), F.lit(True).alias("same_entity"), kind.alias("pair_type"))


def cross_entity(aliases: DataFrame, theta: float = 0.43, k: int = 5, decimals: int | None = None) -> DataFrame:
    """Similar aliases (``id, entity, v, name``) of different entities; a name
    that several entities have counts for the first."""
    unique = keep_first(aliases, ["name"], ["id"])
    found = similarity_join(unique, theta, k, decimals=decimals)
    a = unique.select(F.col("id").alias("query_id"), F.col("name").alias("name_a"), F.col("entity").alias("entity_a"))
    b = unique.select(F.col("id").alias("feat_id"), F.col("name").alias("name_b"), F.col("entity").alias("entity_b"))
    rows = found.join(a, "query_id").join(b, "feat_id")
    return rows.select("name_a", "name_b", "entity_a", "entity_b", F.lit(False).alias("same_entity"), F.lit("cross_entity_embedding_match").alias("pair_type"), F.col("cosine").alias("initial_cosine"))


def deduplicated(pairs: DataFrame, order: str) -> DataFrame:
    """The first of the pairs that have the same two names, in either order, and
    the same label."""
    return keep_first(pairs, [F.least("name_a", "name_b"), F.greatest("name_a", "name_b"), "same_entity"], [order])


def all_pairs(within: DataFrame, cross: DataFrame) -> DataFrame:
    return within.unionByName(cross, allowMissingColumns=True)


def scored(pairs: DataFrame, embeddings: DataFrame, mapping: DataFrame) -> DataFrame:
    """``pairs`` with the cosine of their names' vectors (``name, v``) and their
    graded name score, null where the second entity is not in ``mapping``
    (``entity_b``). Each distinct pair of names is scored once."""
    v = lambda side: embeddings.select(F.col("name").alias(f"name_{side}"), F.col("v").alias(f"v_{side}"))
    rows = pairs.join(v("a"), "name_a", "left").join(v("b"), "name_b", "left").join(mapping.select("entity_b").distinct().withColumn("_known", F.lit(True)), "entity_b", "left")
    rows = scored_names(rows, score="_score")
    gnr = F.when(F.col("_known"), F.col("_score"))
    out = rows.withColumn("gnr_score", gnr).withColumn("gnr_bucket", text.bucket(F.col("gnr_score"))).withColumn("cosine_sim", vectors.cosine(F.col("v_a"), F.col("v_b")))
    return out.select(*PAIR, "gnr_score", "gnr_bucket", "cosine_sim")


def is_positive(high: int = 85, null_too: bool = False) -> Column:
    """Name scores agree that a true pair is one; a missing score may pass."""
    ok = F.coalesce(F.col("gnr_score") >= high, F.lit(null_too))
    return F.col("same_entity") & ok


def is_hard_negative(low: int = 50, cosine: float = 0.5, null_too: bool = False) -> Column:
    ok = F.coalesce(F.col("gnr_score") < low, F.lit(null_too))
    return ~F.col("same_entity") & ok & (F.col("cosine_sim") >= cosine)


def is_hard_positive(cosine: float = 0.6, high: int = 85) -> Column:
    return F.col("same_entity") & (F.col("cosine_sim") < cosine) & F.coalesce(F.col("gnr_score") >= high, F.lit(True))


def triplets(pairs: DataFrame, per_anchor: int = 5, high: int = 85, low: int = 50, cosine: float = 0.5, null_too: bool = False) -> DataFrame:
    """``anchor, positive, negative, anchor_group, positive_cosine,
    negative_cosine``: either name of a pair is an anchor, and for each, the
    first of its positives by name score times its negatives by cosine. Only the
    first ``per_anchor`` of either side can be among them, so both are cut before
    they are joined. A missing score that may pass counts as 100 or 0."""
    score = F.coalesce("gnr_score", F.when(F.col("same_entity"), 100).otherwise(0))
    scores = ("same_entity", "gnr_score", "cosine_sim")
    rows = pairs.filter("cosine_sim is not null").select("name_a", "name_b", "entity_a", *scores)
    turned = pairs.filter("cosine_sim is not null").select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), F.col("entity_b").alias("entity_a"), *scores)
    rows = rows.unionByName(turned)
    cut = lambda flag, order: first_n(rows.filter(flag), ["name_a"], order, per_anchor)
    place = lambda order: F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    p = cut(is_positive(high, null_too), [score.desc(), F.col("name_b")]).select(F.col("name_a").alias("anchor"), F.col("name_b").alias("positive"), F.col("entity_a").alias("anchor_group"), score.alias("g"), F.col("cosine_sim").alias("positive_cosine"))
    n = cut(is_hard_negative(low, cosine, null_too), [F.desc("cosine_sim"), F.col("name_b")]).select(F.col("name_a").alias("anchor"), F.col("name_b").alias("negative"), F.col("cosine_sim").alias("negative_cosine"))
    p = p.withColumn("i", place([F.desc("g"), F.col("positive")]))
    n = n.withColumn("j", place([F.desc("negative_cosine"), F.col("negative")]))
    made = first_n(p.join(n, "anchor"), ["anchor"], ["i", "j"], per_anchor)
    return made.select("anchor", "positive", "negative", "anchor_group", "positive_cosine", "negative_cosine")


def margins(mined: DataFrame) -> DataFrame:
    m = F.col("positive_cosine") - F.col("negative_cosine")
    return mined.agg(
        F.count(F.lit(1)).alias("triplets"), F.count_distinct("anchor").alias("anchors"), F.count_distinct("positive").alias("positives"), F.count_distinct("negative").alias("negatives"),
        F.min(m).alias("min_margin"), F.max(m).alias("max_margin"), F.avg(m).alias("mean_margin"),
        F.count_if(m < 0).alias("negative_margins"), F.try_divide(100.0 * F.count_if(m < 0), F.count(F.lit(1))).alias("negative_percent"),
    )


def script_pairs(pairs: DataFrame) -> DataFrame:
    """How often two scripts (``script_a, script_b``) meet, in either order."""
    return pairs.groupBy(F.least("script_a", "script_b").alias("script_x"), F.greatest("script_a", "script_b").alias("script_y")).agg(F.count(F.lit(1)).alias("n"))


def seeded(seed: int, *keys: str) -> Column:
    """An order that is the same in every engine: MD5 of a seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def numbered(pool: DataFrame, entity: str, name: str, by: list[str] | tuple[str, ...] = (), weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct names of a pool, numbered from 0 in each group of ``by`` so that
    an entity's are neighbours: ``by..., entity, name, place, weight``; and the
    entities: ``by..., entity, first, own, total`` (its first number, how many it
    has, how many there are). ``weighted``: a name takes as many numbers as it has
    rows in the pool, from ``place`` on; else one. Hashes deal entities and an entity's names into cells, whose
    totals give the offsets: no task orders all of them, nor all of an entity's."""
    by = list(by)
    cell = lambda c: F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 3)
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = pool.filter(F.col(entity).isNotNull() & F.col(name).isNotNull()).groupBy(*by, F.col(entity).alias("entity"), F.col(name).alias("name")).agg((F.count(F.lit(1)) if weighted else F.lit(1).cast("long")).alias("weight"))
    names = names.withColumn("_e", F.md5(F.col("entity").cast("string").cast("binary"))).withColumn("_n", F.md5(F.col("name").cast("binary"))).withColumn("_c", F.substring("_n", 1, 3))
    parts = names.groupBy(*by, "entity", "_e", "_c").agg(F.sum("weight").alias("n"))
    inside = parts.withColumn("_inside", earlier("n", Window.partitionBy(*by, "entity").orderBy("_c")))
    own = parts.groupBy(*by, "entity", "_e").agg(F.sum("n").alias("own")).withColumn("_k", F.substring("_e", 1, 3))
    cells = own.groupBy(*by, "_k").agg(F.sum("own").alias("n"))
    cells = cells.withColumn("_before", earlier("n", Window.partitionBy(*by).orderBy("_k"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    near = own.join(F.broadcast(cells.drop("n")), [*by, "_k"])
    entities = near.withColumn("first", F.col("_before") + earlier("own", Window.partitionBy(*by, "_k").orderBy("_e", "entity"))).select(*by, "entity", "first", "own", "total")
    nth = earlier("weight", Window.partitionBy(*by, "entity", "_c").orderBy("_n", "name"))
    rows = names.withColumn("_nth", nth).join(inside.select(*by, "entity", "_c", "_inside"), [*by, "entity", "_c"]).join(entities.select(*by, "entity", "first"), [*by, "entity"])
    return rows.select(*by, "entity", "name", (F.col("first") + F.col("_inside") + F.col("_nth")).alias("place"), "weight"), entities


def draw_others(rows: DataFrame, keys: list[str], pool: DataFrame, entity: str, name: str, n: int, seed: int, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with ``entity``), each ``n`` times with a ``negative`` of another
    entity in its group, all different, fewer only where the pool has fewer. The
    numbers of others are one range around the own ones, so a start and a stride
    in it, from a hash of ``keys``, draw without a miss; names join by number."""
    by = list(by)
    places, entities = numbered(pool, entity, name, by)
    whole = entities.groupBy(*by).agg(F.max("total").alias("_total"))
    known = rows.join(entities.select(*by, F.col("entity").alias("_entity"), "first", "own"), [*[rows[c].eqNullSafe(entities[c]) for c in by], F.col("entity") == F.col("_entity")], "left")
    for c in by:
        known = known.drop(entities[c])
    both = known.join(F.broadcast(whole), by) if by else known.crossJoin(F.broadcast(whole))
    others = F.col("_total") - F.coalesce("own", F.lit(0))
    h = F.conv(F.substring(seeded(seed, *keys), 1, 12), 16, 10).cast("long")
    both = both.withColumn("_others", others).filter("_others > 0")
    j = F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_others").cast("int")) - 1))
    stride = F.greatest(F.lit(1), F.expr(f"_others div {n}"))
    drawn = both.withColumn("j", j).withColumn("_at", F.pmod(h + F.col("j") * stride, F.col("_others")))
    drawn = drawn.withColumn("place", F.when(F.col("own").isNotNull() & (F.col("_at") >= F.col("first")), F.col("_at") + F.col("own")).otherwise(F.col("_at")))
    found = drawn.join(places.select(*by, "place", F.col("name").alias("negative")), [*by, "place"])
    return found.select(*rows.columns, "j", "negative")


#: Numbers of a pool that are joined on as one.
STRIDE = 16


def draw_weighted(rows: DataFrame, keys: list[str], pool: DataFrame, entity: str, name: str, n: int, seed: int) -> DataFrame:
    """``rows`` (with ``entity``), each ``n`` times with a ``negative`` of another
    entity, drawn with replacement: a name that is ``k`` times in the pool is drawn
    ``k`` times as often. Rows whose entity has the whole pool give none.

    A draw is a number among the others', from a hash of ``keys`` and the draw's;
    a name has a stretch of numbers, cut at every ``STRIDE``-th, so that numbers
    and stretches meet in an equi-join of at most that many rows each."""
    places, entities = numbered(pool, entity, name, weighted=True)
    whole = entities.agg(F.max("total").alias("_total"))
    known = rows.join(entities.select(F.col("entity").alias("_entity"), "first", "own"), F.col("entity") == F.col("_entity"), "left").crossJoin(F.broadcast(whole))
    drawn = known.withColumn("_others", F.col("_total") - F.coalesce("own", F.lit(0))).filter("_others > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    h = F.conv(F.substring(seeded(seed, *keys, "j"), 1, 12), 16, 10).cast("long")
    drawn = drawn.withColumn("_at", F.pmod(h, F.col("_others")))
    drawn = drawn.withColumn("_at", F.when(F.col("own").isNotNull() & (F.col("_at") >= F.col("first")), F.col("_at") + F.col("own")).otherwise(F.col("_at")))
    cuts = F.sequence(F.expr(f"place div {STRIDE}"), F.expr(f"(place + weight - 1) div {STRIDE}"))
    stretches = places.select(F.col("name").alias("negative"), "place", "weight", F.explode(cuts).alias("_cut"))
    found = drawn.withColumn("_cut", F.expr(f"_at div {STRIDE}")).join(stretches, "_cut").filter("_at >= place and _at < place + weight")
    return found.select(*rows.columns, "j", "negative")


def hard_positive_triplets(pairs: DataFrame, pool: DataFrame, n: int = 3, seed: int = 42, weighted: bool = False) -> DataFrame:
    """Hard positives, each with ``n`` negatives from ``pool`` (``entity, name``)
    of other entities, and each also the other way round. ``weighted``: names that
    come more often in the pool are drawn more often, and may be drawn again."""
    hard = pairs.filter(is_hard_positive()).withColumn("entity", F.col("entity_a")).select("name_a", "name_b", "entity")
    few = (draw_weighted if weighted else draw_others)(hard, ["name_a", "name_b"], pool, "entity", "name", n, seed)
    one = few.select(F.col("name_a").alias("anchor"), F.col("name_b").alias("positive"), "negative", F.col("entity").alias("anchor_group"))
    return one.unionByName(few.select(F.col("name_b").alias("anchor"), F.col("name_a").alias("positive"), "negative", F.col("entity").alias("anchor_group")))


def _leading(named: DataFrame, n: int) -> DataFrame:
    """Of each record's names, the first ``n`` rows of each of the ``n`` values
    that come up first."""
    few = first_n(named, ["record_id", "name"], ["idx"], n)
    firsts = first_n(few.groupBy("record_id", "name").agg(F.min("idx").alias("idx")), ["record_id"], ["idx"], n).select("record_id", "name")
    return few.join(firsts, ["record_id", "name"])


def alias_triplets(named: DataFrame, most: int = 5, seed: int = 42) -> DataFrame:
    """Triplets from records' own names (``record_id, record_type, idx, name``):
    the first ``most`` pairs i < j of different names of a record, each with the
    first name of another record of its type, drawn by hash.

    A record's first name has as many pairs as names differ from it; if these are
    ``most``, they are the first, and else all but that many names equal the first
    one. So the first ``most + 1`` names of each value, of the first ``most + 1``
    values to come up, hold all that can be asked for, and only they are joined."""
    named = _leading(named, most + 1)
    a = named.select("record_id", "record_type", F.col("idx").alias("i"), F.col("name").alias("anchor"))
    b = named.select("record_id", F.col("idx").alias("j"), F.col("name").alias("positive"))
    pairs = first_n(a.join(b, "record_id").filter("i < j and anchor <> positive"), ["record_id"], ["i", "j"], most)
    pairs = pairs.select(F.col("record_id").alias("entity"), "record_type", "i", F.col("j").alias("other"), "anchor", "positive")
    drawn = draw_others(pairs, ["entity", "i", "other"], named.filter("idx = 0"), "record_id", "name", 1, seed, ["record_type"])
    return drawn.select("anchor", "positive", "negative", "record_type", F.col("entity").alias("record_id"))
