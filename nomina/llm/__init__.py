"""Training-data operators: search, filtering, deduplication, mixing and packing.

Nothing outside this subpackage imports it. Operators take and return
DataFrames; ``queries`` holds the thin registered queries with production
parameters and, where SQL can say it, the same result as DuckDB SQL.
"""
