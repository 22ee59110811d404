"""Commands over files: ``python -m nomina COMMAND INPUT OUTPUT [options]``.

Each reads JSON lines (or CSV), runs one workload and writes JSON lines. On a
cluster, submit this file with the cluster's own session settings.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scripts, vectors
from .operators import comparison, loading, pairs, records, resolution, sampling, scoring, stats
from .plans import pipelines
from .sources import readers, writers

ENTITY = "entity_id string, canonical string, aliases array<struct<name:string,language:string>>"
PAIR = "name_a string, name_b string, entity_a string, entity_b string, same_entity boolean, pair_type string, gnr_score int, gnr_bucket string, cosine_sim double"
JUDGED = "case_id string, record_type string, variant_type string, query_name_type string, expected_entity_id bigint"
REPORT = "test_set string, model_type string, model_path string, emb_accuracy double, emb_ndcg map<string,double>"
LOADED = "record_id string, name string, entity_id string"
CASE = "test_case_id string, record_id string, data_source string, record_type string, query_name string, query_name_type string, all_aliases array<string>, expected_entity_id bigint"


def _encoder(a: argparse.Namespace) -> vectors.Encoder:
    return vectors.onnx_encoder(a.model, a.tokenizer) if a.model else vectors.hash_encoder(256)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", F.concat_ws("|", "DATA_SOURCE", "RECORD_ID"))


def sample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A stratified sample of records, as they were read."""
    rows = records.analyzed(_keyed(readers.records(spark, a.input)))
    return sampling.stratified(rows, a.size, "_key", a.person_ratio, a.seed).select("raw")


def cases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Validation cases of sampled records."""
    rows = _keyed(records.of_type(readers.records(spark, a.input), a.filter))
    return records.test_cases(records.names(sampling.sample(rows, a.size, "_key", a.seed)), a.date)


def variants(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Variant cases of validation cases."""
    rows = readers.decoded(readers.scanned(spark, a.input), schema=CASE)
    if a.only == "manual":
        return pipelines.manual_variants(spark, rows)
    return pipelines.variants(rows, a.most) if a.only == "automated" else pipelines.all_variants(rows, a.most)


def aliases(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Triplets from records' own names."""
    rows = records.with_aliases(readers.records(spark, a.input), a.min_aliases)
    return pairs.alias_triplets(records.names(rows), a.most, a.seed)


def entities(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A sample of entities from rows of aliases, those across scripts first."""
    rows = readers.alias_csv(spark, a.input).withColumn("ord", F.monotonically_increasing_id())
    made = records.entities_from_rows(rows, a.min_aliases).withColumn("alias", F.explode("aliases"))
    sets = made.select("entity_id", scripts.script_set(F.col("alias.name")).alias("s")).groupBy("entity_id").agg(F.collect_list("s").alias("sets"))
    crossed = F.when(scripts.has_cross_script(F.col("sets")), scripts.cross_script_pairs(F.col("sets"))).otherwise(0)
    whole = records.entities_from_rows(rows, a.min_aliases).join(sets.select("entity_id", crossed.alias("cross_script_pairs")), "entity_id")
    if a.any_script:
        return sampling.sample(whole, a.size, "entity_id", a.seed)
    return sampling.priority_split(whole, a.size, "cross_script_pairs", "entity_id", seed=a.seed)


def prepare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entities as records to load."""
    return records.loader_records(readers.decoded(readers.scanned(spark, a.input), schema=ENTITY), a.source)


def align(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entities to scored pairs within and across them."""
    e = readers.decoded(readers.scanned(spark, a.input), schema=ENTITY)
    rows = e.select(F.col("entity_id").alias("entity"), F.posexplode("aliases").alias("ord", "a")).select("entity", "ord", F.col("a.name").alias("name"))
    rows = rows.filter("name is not null").withColumn("script", scripts.first_seen(F.col("name"))).withColumn("id", F.xxhash64("entity", "ord"))
    encoded = vectors.encode_names(rows, "name", _encoder(a), a.dim).withColumnRenamed("embedding", "v")
    numbered = encoded.withColumn("key", F.xxhash64("entity"))
    within = pairs.within_entity(encoded, a.within)
    cross = pairs.cross_entity(numbered.select("id", F.col("key").alias("entity"), "name", "v"), a.threshold, a.cross)
    back = numbered.select("key", "entity").distinct()
    for side in ("entity_a", "entity_b"):
        cross = cross.join(back.select(F.col("key").alias(side), F.col("entity").alias("_e")), side).drop(side).withColumnRenamed("_e", side)
    both = pairs.deduplicated(pairs.all_pairs(within, cross).withColumn("_ord", F.struct((~F.col("same_entity")).cast("int"), "name_a", "name_b", "entity_a", "entity_b")), "_ord").drop("_ord")
    return pairs.scored(both, encoded.select("name", "v").dropDuplicates(["name"]), encoded.select(F.col("entity").alias("entity_b")))


def _scored(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.decoded(readers.scanned(spark, a.input), schema=PAIR)


def analyze(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Correlation of both scores, and how well cosines part the classes."""
    p = _scored(spark, a)
    named = lambda one, c: one.withColumnRenamed("p_value", f"{c}_p_value")
    ranks = named(stats.spearman(p).drop("n"), "spearman").crossJoin(named(stats.kendall(p), "kendall"))
    return named(stats.pearson(p), "pearson").crossJoin(ranks).crossJoin(stats.roc_auc(p, "cosine_sim", "same_entity"))


def triplets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Training triplets from scored pairs."""
    return pairs.triplets(_scored(spark, a), a.most, a.positive, a.negative, a.cosine, a.include_null)


def hard(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Triplets around true pairs that vectors keep apart."""
    p = _scored(spark, a)
    pool = p.select(F.col("entity_a").alias("entity"), F.col("name_a").alias("name")).union(p.select("entity_b", "name_b"))
    return pairs.hard_positive_triplets(p, pool, a.most, a.seed)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Cases and search responses to the full report, a metric a line."""
    rows = readers.decoded(readers.scanned(spark, a.input), schema=JUDGED).drop("raw", "value")
    found = readers.decoded(readers.scanned(spark, a.responses), schema="case_id string, mode string, response string").drop("raw", "value")
    return pipelines.evaluate(rows, found, a.by)


def compare(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Models' reports beside each other, or the best of each test set alone."""
    rows = readers.reports(spark, a.input, REPORT)
    return comparison.best_models(rows) if a.best_only else comparison.compared(rows)


def retry(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A log of attempts to each record's last outcome."""
    rows = readers.decoded(readers.scanned(spark, a.input), schema="record_id string, attempt int, message string")
    return loading.final_outcomes(rows.select("record_id", "attempt", loading.error_type(F.col("message")).alias("error_type")), a.max_attempts)


def numbers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines with their ordinals, of files or of a pipe (``-``)."""
    return readers.standard_input(spark, sys.stdin) if a.input == "-" else readers.lines(spark, a.input)


def load(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Records to entities by their first names, on top of those that an earlier
    load gave (--stored); records without an id or a name go to --dead."""
    named = records.names(readers.records(spark, a.input)).filter("idx = 0")
    key = F.when(F.col("record_id").isNotNull(), F.concat_ws(":", "data_source", "record_id"))
    rows = named.select(key.alias("record_id"), "name")
    vector = F.lit(None).cast("array<double>").alias("v")
    if a.dead:
        every = readers.records(spark, a.input)
        lost = every.join(named.select(F.col("record_id").alias("RECORD_ID"), F.col("data_source").alias("DATA_SOURCE")).distinct(), ["DATA_SOURCE", "RECORD_ID"], "left_anti")
        writers.raw_lines(lost, a.dead)
    stored = readers.decoded(readers.scanned(spark, a.stored), schema=LOADED).select("record_id", "name", vector, "entity_id") if a.stored else None
    return resolution.resolve(rows.select("record_id", "name", vector), stored, share=a.share, least=a.score).drop("v")


def why(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Names against whole entities of a load (--entities): the best alias, its
    score and bucket, and the words that agree."""
    asked = readers.decoded(readers.scanned(spark, a.input), schema="name string, entity string").select("name", "entity")
    known = readers.decoded(readers.scanned(spark, a.entities), schema=LOADED).select(F.col("entity_id").alias("entity"), "name")
    return scoring.why(asked, known)


COMMANDS = {
    sample: {"--size": 10_000, "--person-ratio": 0.5, "--seed": 42},
    cases: {"--size": 100, "--filter": "both", "--seed": 42, "--date": ""},
    variants: {"--most": 3, "--only": "both"},
    aliases: {"--min-aliases": 2, "--most": 5, "--seed": 42},
    entities: {"--size": 20_000, "--min-aliases": 3, "--seed": 42, "--any-script": False},
    prepare: {"--source": "WIKIDATA"},
    align: {"--within": 6, "--cross": 5, "--threshold": 0.43, "--dim": 512, "--model": "", "--tokenizer": ""},
    analyze: {},
    triplets: {"--positive": 85, "--negative": 50, "--cosine": 0.5, "--most": 5, "--include-null": False},
    hard: {"--most": 3, "--seed": 42},
    evaluate: {"--responses": "", "--by": "score"},
    compare: {"--best-only": False},
    retry: {"--max-attempts": 3},
    numbers: {},
    load: {"--stored": "", "--dead": "", "--share": 0.4, "--score": 75},
    why: {"--entities": ""},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m nomina", description=__doc__)
    sub = top.add_subparsers(required=True)
    for fn, options in COMMANDS.items():
        one = sub.add_parser(fn.__name__, help=fn.__doc__)
        one.set_defaults(run=fn)
        one.add_argument("input")
        one.add_argument("output")
        for name, default in options.items():
            if default is False:
                one.add_argument(name, action="store_true")
            else:
                one.add_argument(name, type=type(default), default=default)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    out = a.run(spark, a)
    if out.columns == ["raw"]:
        writers.raw_lines(out, a.output)
    else:
        writers.json_lines(out, a.output)


if __name__ == "__main__":
    main()
