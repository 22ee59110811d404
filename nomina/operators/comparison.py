"""Comparing reports of models and of validation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .ranking import keep_first


def model_name(path: Column) -> Column:
    """The last part of a path; of the result of a packaged model, the folder."""
    return F.try_element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), F.lit(-1))


def model_id(biz: Column, name: Column) -> Column:
    """The folder of the business model, else of the name model, else unknown."""
    folder = lambda p: F.try_element_at(F.split(p, "/"), F.lit(-2))
    return F.coalesce(folder(F.nullif(biz, F.lit(""))), folder(F.nullif(name, F.lit(""))), F.lit("unknown"))


def best_models(reports: DataFrame) -> DataFrame:
    """The best report of each test set and model type by accuracy."""
    return keep_first(reports, ["test_set", "model_type"], [F.desc_nulls_last("emb_accuracy"), F.col("model_path")])


def compared(reports: DataFrame) -> DataFrame:
    """Reports in order of accuracy within their test set, with NDCG under its
    string keys and how far each is behind the best."""
    best = reports.groupBy("test_set", "model_type").agg(F.max("emb_accuracy").alias("best"))
    rows = reports.join(best, ["test_set", "model_type"])
    return rows.select("test_set", "model_type", "model_path", "emb_accuracy", F.try_element_at("emb_ndcg", F.lit("10")).alias("ndcg_10"), (F.col("best") - F.col("emb_accuracy")).alias("behind"))


# The least cosine that a converted model's vectors may have.
FLOORS = {"fp32": 0.999, "fp16": 0.99, "int8": 0.95}


def conversion_check(exact: DataFrame, converted: DataFrame, kind: str) -> DataFrame:
    """``rows, min_cosine, max_difference, ok``: two tables of vectors (``id, v``)
    of the same names, before and after a model was converted. ``ok``: no cosine
    is at or below the floor of its kind. Vectors that one side lacks, and null
    or zero ones, count as cosine 0."""
    both = exact.select("id", vectors.doubles(F.col("v")).alias("a")).join(converted.select("id", vectors.doubles(F.col("v")).alias("b")), "id", "full")
    cosine = F.coalesce(F.try_divide(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")) * vectors.norm(F.col("b"))), F.lit(0.0))
    gap = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.min(cosine).alias("min_cosine"), F.max(gap).alias("max_difference"), (F.min(cosine) > FLOORS[kind]).alias("ok"))
