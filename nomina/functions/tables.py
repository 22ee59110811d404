"""Name rules as table functions of SQL.

The rules are column expressions; a table function's body is their SQL text, so
that Spark puts the same expressions in place of each call and names stay in the
JVM. No rule is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text

#: A string literal, or an operator that is called like a function.
_TOKEN = re.compile(r"('(?:[^'\\]|\\.|'')*')|(<=>|>=|<=|<>|!=|=|<|>|!|\+|\*|/|%|-|\b(?:and|or|not)\b)(?=\()")


def sql_of(column: Column) -> str:
    """A column's text as SQL; operators become calls of quoted functions."""
    return _TOKEN.sub(lambda m: m[1] or f"`{m[2]}`", column._jc.node().sql())


#: Rules by the name of their table function.
RULES = {
    "person_variants": text.person_variants, "business_variants": text.business_variants,
    "personal_triplet_variants": lambda name: text.synthetic_variants(name, "personal"), "business_triplet_variants": lambda name: text.synthetic_variants(name, "business"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to the session, and say their names. Each
    takes a name and returns ``nth`` (from 0), ``variant`` and ``variant_type``:

        SELECT id, v.* FROM people, LATERAL person_variants(people.name) AS v
    """
    for function, rule in RULES.items():
        body = sql_of(rule(F.col("name")))
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(name STRING) RETURNS TABLE (nth INT, variant STRING, variant_type STRING) "
            f"RETURN SELECT nth, v.variant, v.variant_type FROM (SELECT posexplode({body}) AS (nth, v))"
        )
    return list(RULES)
