"""Registered queries over the driver's tables, with DuckDB SQL beside each."""

from . import base, evaluation, files, ingest, names, pairs, resolution, search, streams

ALL = base.merged(search.QUERIES, names.QUERIES, ingest.QUERIES, evaluation.QUERIES, pairs.QUERIES, streams.QUERIES, files.QUERIES, resolution.QUERIES)
