"""Name rewriting and script detection queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scripts, tables, text
from ..operators.ranking import keep_first
from .base import WITH_NAMES, Query, names, rounded

# SQL twins of the shared pieces.
_W = r"list_filter(string_split_regex(name, '\s+'), lambda w: w <> '')"
_PUNCT = r"[^\p{L}\p{M}\p{N}_\s]"


def _join(parts: str) -> str:
    return f"array_to_string({parts}, ' ')"


def _suffix_sql() -> str:
    cases = []
    for s in sorted(text.LEGAL_SUFFIXES, key=len, reverse=True):
        p = "(?i)" + text.legal_pattern(s)
        left = rf"regexp_replace(regexp_replace(name, '{p}', ''), '^\s+|\s+$', '', 'g')"
        cases.append(f"WHEN regexp_matches(name, '{p}') AND {left} <> '' THEN {left}")
    return "CASE " + " ".join(cases) + " ELSE name END"


def _mapped_sql(table: dict[str, str]) -> str:
    keys = ", ".join(f"'{k}'" for k in table)
    values = ", ".join(f"'{v}'" for v in table.values())
    key = "rtrim(upper(w), '.,')"
    hit = f"len(list_filter({_W}, lambda w: list_contains([{keys}], {key}))) > 0"
    return f"CASE WHEN {hit} THEN {_join(f'list_transform({_W}, lambda w: coalesce(([{values}])[list_position([{keys}], {key})], w))')} ELSE name END"


_PREP = "[" + ", ".join(f"'{p}'" for p in text.PREPOSITIONS) + "]"
_REST = f"list_filter({_W}, lambda w: NOT list_contains({_PREP}, upper(w)))"
_N = f"len({_W})"
_FIRST, _LAST = f"({_W})[1]", f"({_W})[-1]"

RULES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "complexity": (text.complexity, f"CASE WHEN name = '' THEN 'empty' WHEN NOT regexp_matches(name, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]') AND {_N} <= 2 THEN 'simple' WHEN NOT regexp_matches(name, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]') AND {_N} <= 4 THEN 'medium' ELSE 'complex' END"),
    "legal_suffix": (text.remove_legal_suffix, _suffix_sql()),
    "abbreviate": (text.abbreviate, _mapped_sql(text.ABBREVIATIONS)),
    "expand": (text.expand, _mapped_sql({v: k.capitalize() for k, v in text.ABBREVIATIONS.items()})),
    "prepositions": (text.remove_prepositions, f"CASE WHEN {_N} > 2 AND len({_REST}) BETWEEN 1 AND {_N} - 1 THEN {_join(_REST)} ELSE name END"),
    "drop_words": (text.drop_words, f"CASE WHEN {_N} > 3 THEN {_join(f'list_concat(({_W})[1 : {_N} // 2], ({_W})[{_N} // 2 + 2 :])')} WHEN {_N} > 2 THEN {_join(f'({_W})[1 : {_N} - 1]')} ELSE name END"),
    "patronymic": (text.drop_patronymic, f"CASE WHEN {_N} > 2 THEN {_FIRST} || ' ' || {_LAST} ELSE name END"),
    "reverse_order": (text.reverse_name_order, f"CASE WHEN {_N} >= 2 THEN {_LAST} || ' ' || {_FIRST} ELSE name END"),
    "display_truncation": (lambda c: text.truncated(c, 20), "CASE WHEN length(name) > 20 THEN left(name, 17) || '...' ELSE name END"),
}


def _legal_entity_sql() -> str:
    out = "name"
    for p in text.LEGAL_PATTERNS:
        out = f"regexp_replace({out}, '{p}', '', 'gi')"
    return f"trim({out}, ' ,\"')"


def _rule(fn: Callable[[Column], Column]) -> Callable:
    return lambda spark, d: names(spark, d).select("id", "name", fn(F.col("name")).alias("result"))


def _kinds(rules: list[tuple[str, str, str]]) -> str:
    """SQL for variants: (type, value, condition) in order, with their place."""
    parts = [f"SELECT id, name, {i} AS rule, {v} AS variant, '{kind}' AS variant_type FROM names WHERE {when}" for i, (kind, v, when) in enumerate(rules)]
    return (
        f"WITH {WITH_NAMES}, v AS (" + " UNION ALL ".join(parts) + "), k AS (SELECT * FROM v WHERE variant IS NOT NULL AND variant <> name AND variant <> '') "
        "SELECT id, name, CAST(row_number() OVER (PARTITION BY id ORDER BY rule) - 1 AS INTEGER) AS nth, variant, variant_type FROM k"
    )


def _exploded(fn: Callable[[Column], Column]) -> Callable:
    return lambda spark, d: names(spark, d).select("id", "name", F.posexplode(fn(F.col("name"))).alias("nth", "v")).select("id", "name", "nth", "v.variant", "v.variant_type")


_BUSINESS = [
    ("legal_suffix_removed", RULES["legal_suffix"][1], "true"), ("words_abbreviated", RULES["abbreviate"][1], "true"), ("abbreviations_expanded", RULES["expand"][1], "true"),
    ("prepositions_removed", RULES["prepositions"][1], "true"), ("word_dropped", RULES["drop_words"][1], f"{_N} > 3"),
]
_PERSON = [("patronymic_dropped", RULES["patronymic"][1], f"{_N} > 2"), ("name_order_reversed", RULES["reverse_order"][1], f"{_N} >= 2")]
_INITIAL = f"left({_FIRST}, 1)"
_ABBREVIATED = [
    ("synthetic_abbreviated_initial_last", f"{_INITIAL} || ' ' || {_LAST}", f"{_N} >= 2"), ("synthetic_abbreviated_initial_period", f"{_INITIAL} || '. ' || {_LAST}", f"{_N} >= 2"),
    ("synthetic_abbreviated_middle_initial", f"{_FIRST} || ' ' || left(({_W})[2], 1) || ' ' || {_LAST}", f"{_N} >= 3"),
]
_PLAIN = f"regexp_replace(name, '{_PUNCT}', '', 'g')"
_FUZZY = [
    ("synthetic_fuzzy_no_punctuation", _PLAIN, "true"), ("synthetic_fuzzy_normalized_spaces", _join(_W), f"{_join(_W)} <> {_PLAIN}"),
    ("synthetic_fuzzy_hyphen_to_space", "replace(name, '-', ' ')", "contains(name, '-')"),
]
_PARTIAL = [("synthetic_partial_first_last", f"{_FIRST} || ' ' || {_LAST}", f"{_N} >= 3"), ("synthetic_partial_last_only", _LAST, f"{_N} >= 2")]


def variants_all(spark, d):
    """Persons' and organisations' generated variants, two at most for a name,
    and of equal queries the first."""
    rows = names(spark, d).withColumn("v", F.when(F.col("record_type") == "PERSON", text.person_variants(F.col("name"))).otherwise(text.business_variants(F.col("name"))))
    few = rows.select("id", F.posexplode(F.slice("v", 1, 2)).alias("nth", "v")).select("id", "nth", "v.variant", "v.variant_type")
    return keep_first(few, [F.lower("variant")], ["id", "nth"])


def variants_lateral(spark, d):
    """The same, by table functions in SQL."""
    tables.register(spark)
    names(spark, d).createOrReplaceTempView("nomina_names")
    few = spark.sql("""SELECT id, v.* FROM nomina_names AS n, LATERAL person_variants(n.name) AS v WHERE n.record_type = 'PERSON' AND v.nth < 2
        UNION ALL SELECT id, v.* FROM nomina_names AS n, LATERAL business_variants(n.name) AS v WHERE n.record_type <> 'PERSON' AND v.nth < 2""")
    return keep_first(few, [F.lower("variant")], ["id", "nth"])


_ALL_SQL = (
    f"WITH {WITH_NAMES}, v AS ("
    + " UNION ALL ".join(f"SELECT id, {i} AS rule, {v} AS variant, '{k}' AS variant_type, name FROM names WHERE record_type {op} 'PERSON' AND {w}" for op, rules in (("=", _PERSON), ("<>", _BUSINESS)) for i, (k, v, w) in enumerate(rules))
    + "), k AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rule) - 1 AS INTEGER) AS nth, variant, variant_type FROM v WHERE variant <> name AND variant <> ''), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY lower(variant) ORDER BY id, nth) AS n FROM k WHERE nth < 2) SELECT id, nth, variant, variant_type FROM f WHERE n = 1"
)


def triplet_variants(spark, d):
    rows = names(spark, d).filter("record_type = 'PERSON'").withColumn("aliases", F.array(F.upper("name"), F.col("name")))
    made = text.triplet_variants(F.col("name"), F.col("aliases"), "personal")
    return rows.select("id", F.explode(made).alias("v")).groupBy("v.variant_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v.variant").alias("distinct_variants"))


_TRIPLET_SQL = (
    f"WITH {WITH_NAMES}, p AS (SELECT * FROM names WHERE record_type = 'PERSON'), v AS (SELECT name AS variant, 'exact' AS variant_type FROM p UNION ALL SELECT upper(name), 'alias' FROM p WHERE upper(name) <> name"
    + "".join(f" UNION ALL SELECT variant, variant_type FROM (SELECT {v} AS variant, '{k}' AS variant_type, name FROM p WHERE {w}) WHERE variant <> name AND variant <> ''" for k, v, w in _ABBREVIATED + _FUZZY + _PARTIAL)
    + ") SELECT variant_type, count(*) AS n, count(DISTINCT variant) AS distinct_variants FROM v GROUP BY variant_type"
)


# Script rules in SQL, from the same code-point classes.
def _count(chars: str, value: str = "name") -> str:
    return f"len(regexp_extract_all({value}, '[{chars}]'))"


def _sq(chars: str) -> str:
    return chars.replace("'", "''").replace(r"\"", '"')


def _five_sql() -> str:
    counts = {k: _count(v) for k, v in scripts.FIVE.items()} | {"other": _count(r"^\s" + "".join(scripts.FIVE.values()))}
    most = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN name = '' THEN 'empty' WHEN {most} = 0 THEN 'latin' " + " ".join(f"WHEN {n} = {most} THEN '{k}'" for k, n in counts.items()) + " END"


def _majority_sql() -> str:
    total = " + ".join(_count(v) for v in scripts.MAJORITY.values())
    return f"CASE WHEN {total} = 0 THEN 'Unknown' " + " ".join(f"WHEN {_count(v)} > 0.6 * ({total}) THEN '{k}'" for k, v in scripts.MAJORITY.items()) + " ELSE 'Mixed' END"


def _first_sql(classes: dict[str, str], default: str, value: str = "name") -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS script, {_count(_sq(c), value)} AS n, length(regexp_replace({value}, '(?s)[{_sq(c)}].*', '')) AS pos" for k, c in classes.items())
    return f"coalesce((SELECT script FROM ({parts}) WHERE n > 0 ORDER BY n DESC, pos LIMIT 1), '{default}')"


_OTHER = rf"^\s{scripts.FIRST_SEEN_SKIPS}{''.join(scripts.FIRST_SEEN.values())}"
_LETTERS = r"regexp_replace(name, '[^\p{L}]', '', 'g')"


def _script(fn: Callable[[Column], Column], sql: str) -> Query:
    return Query(lambda spark, d: names(spark, d).select("id", "name", fn(F.col("name")).alias("script")), f"WITH {WITH_NAMES} SELECT id, name, {sql} AS script FROM names")


_SETS = {"CJK": r"\p{Han}\p{Hiragana}\p{Katakana}", "Korean": r"\p{Hangul}", "Cyrillic": r"\p{Cyrillic}", "Arabic": r"\p{Arabic}", "Hebrew": r"\p{Hebrew}", "Thai": r"\p{Thai}", "Indic": r"\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}", "Greek": r"\p{Greek}", "Latin": r"\p{Latin}", "Other": r"\p{Georgian}"}


def script_sets(spark, d):
    return names(spark, d).select("id", F.array_join(scripts.script_set(F.col("name")), "+").alias("scripts"))


#: Words that tell the tables apart, besides the names.
_WORDS = ("İstanbul", "ĞÜŞ", "日本", "㐀豈", "、。", "…!?", "—", "ＡＢｃ", "ёлка", "їжак", "ўсё", "हिन्दी", "தமிழ்", "한글", "ｶﾅ", "かな", "ไทย", "שלום", "اردو", "ᾳ", "a1", "")


def script_alphabets(spark, d):
    words = spark.createDataFrame([(f"w{i}", w) for i, w in enumerate(_WORDS)], "id string, name string")
    rows = names(spark, d).select("id", "name").unionByName(words)
    return rows.select("id", *[scripts.within(F.col("name"), k).alias(f"in_{k.lower()}") for k in scripts.TABLES])


# The members of ``scripts.TABLES``, as the oracle's patterns have them.
_MEMBERS = {
    "Latin": r"A-Za-zＡ-Ｚａ-ｚ", "CJK": r"\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF61}-\x{FF64}",
    "Cyrillic": r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C8F}\x{1E030}-\x{1E08F}",
    "Greek": r"\x{370}-\x{3E1}\x{3F0}-\x{3FF}\x{1F00}-\x{1FFF}", "Han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "Hiragana": r"\x{3040}-\x{309F}", "Katakana": r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}",
    "Hangul": r"\x{AC00}-\x{D7FF}\x{1100}-\x{11FF}\x{A960}-\x{A97F}\x{3130}-\x{318F}\x{FFA0}-\x{FFDF}",
    "Arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{870}-\x{8FF}\x{10EC0}-\x{10EFF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "Hebrew": r"\x{590}-\x{5FF}", "Devanagari": r"\x{900}-\x{97F}\x{A8E0}-\x{A8FF}\x{11B00}-\x{11B5F}", "Thai": r"\x{E00}-\x{E7F}",
    "Turkish": r"A-PR-VYZa-pr-vyzÇçĞğİıÖöŞşÜü", "ascii": r"\x00-\x7F", "indic": r"\x{900}-\x{DFF}\x{A830}-\x{A83F}",
    "punctuation": r"\x00-@\[-`{-¿\x{2000}-\x{206F}！-＠［-｀｛-\x{FF65}\x{FFE0}-\x{FFEE}",
    "russian": r"ЁёА-я", "only_russian": r"ЁёЪъЫыЭэ", "ukrainian": r"ЄєІіЇїҐґА-ЩЬЮ-щьюя", "only_ukrainian": r"ЄєЇїҐґ",
    "belarusian": r"ЁёІіЎўА-ШЫ-зй-шы-я", "only_belarusian": r"Ўў",
}


def cross_script(spark, d):
    """Names in pairs by the set rule and the first-seen rule: names with the
    same scripts are counted first, and only kinds of names meet."""
    kinds = names(spark, d).withColumn("s", scripts.script_set(F.col("name"))).withColumn("f", scripts.first_seen(F.col("name")))
    kinds = kinds.groupBy(F.array_join("s", "+").alias("kind"), "s", "f").agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: kinds.select(*[F.col(c).alias(f"{c}_{x}") for c in ("kind", "s", "f", "n")])
    both = side("a").join(F.broadcast(side("b")), (F.col("kind_a") < F.col("kind_b")) | ((F.col("kind_a") == F.col("kind_b")) & (F.col("f_a") <= F.col("f_b"))))
    same = (F.col("kind_a") == F.col("kind_b")) & (F.col("f_a") == F.col("f_b"))
    pairs = F.when(same, F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    return both.select("kind_a", "f_a", "kind_b", "f_b", pairs.alias("pairs"), scripts.cross_script(F.col("s_a"), F.col("s_b")).alias("no_common_script"), scripts.differs(F.col("f_a"), F.col("f_b")).alias("differs"))


def entity_scripts(spark, d):
    """Names in groups of four as entities' aliases."""
    number = F.floor(F.substring("id", 2, 20).cast("bigint") / 4).cast("string")
    rows = names(spark, d).withColumn("entity", F.concat(F.substring("id", 1, 1), number)).withColumn("s", scripts.script_set(F.col("name")))
    sets = rows.groupBy("entity").agg(F.collect_list("s").alias("sets"))
    return sets.select("entity", scripts.has_cross_script(F.col("sets")).alias("has_cross"), scripts.cross_script_pairs(F.col("sets")).cast("long").alias("pairs"))


_SET_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(name, '[{c}]') AND regexp_matches(name, '\\p{{L}}') THEN '{k}' END" for k, c in _SETS.items()) + "], lambda x: x IS NOT NULL))"
_FIRST_SEEN_SQL = _first_sql(scripts.FIRST_SEEN | {"OTHER": _OTHER}, "UNKNOWN")


def lexical_score(spark, d):
    rows = names(spark, d).withColumn("other", text.drop_words(text.remove_legal_suffix(F.col("name"))))
    s = text.lexical_score(F.col("name"), F.col("other"))
    return rows.select("id", s.alias("score"), text.bucket(s).alias("bucket"), text.bucket(s, "BIZNAME").alias("biz_bucket"), text.validity(s).alias("validity"))


_SCORED = f"s AS (SELECT id, name, {RULES['drop_words'][1].replace('name', 'bare')} AS other FROM (SELECT id, name, {RULES['legal_suffix'][1]} AS bare FROM names))"
_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> ''))"
_A, _B = _TOKENS.format("name"), _TOKENS.format("other")


def _bucket_sql(feature: str) -> str:
    return "CASE " + " ".join(f"WHEN score >= {low} THEN '{b}'" for b, low in zip(text.BUCKET_NAMES, text.BUCKETS[feature], strict=True)) + " END"


#: Boundaries are ASCII in the oracle's dialect: letters beyond it go between
#: underscores, which count as word characters, and lose them afterwards.
_MARKED = r"regexp_replace(name, '([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]|[^\x00-\x7F\P{N}])', '_\1_', 'g')"
_UNMARK = r"regexp_replace({}, '_([^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{M}}]|[^\x00-\x7F\P{{N}}])_', '\1', 'g')"


QUERIES = {
    **{k: Query(_rule(fn), f"WITH {WITH_NAMES} SELECT id, name, {sql} AS result FROM names") for k, (fn, sql) in RULES.items()},
    "eval_no_legal_entity": Query(_rule(text.without_legal_entity), f"WITH {WITH_NAMES}, m AS (SELECT id, name AS whole, {_MARKED} AS name FROM names) SELECT id, whole AS name, {_UNMARK.format(_legal_entity_sql())} AS result FROM m"),
    "variants_business": Query(_exploded(text.business_variants), _kinds(_BUSINESS)),
    "variants_person": Query(_exploded(text.person_variants), _kinds(_PERSON)),
    "eval_abbrev": Query(_exploded(text.abbreviated_person), _kinds(_ABBREVIATED)),
    "eval_fuzzy": Query(_exploded(text.fuzzy_variants), _kinds(_FUZZY)),
    "eval_partial": Query(_exploded(text.partial_variants), _kinds(_PARTIAL)),
    "variants_all": Query(variants_all, _ALL_SQL),
    "variants_lateral": Query(variants_lateral, _ALL_SQL),
    "variants_triplet": Query(triplet_variants, _TRIPLET_SQL),
    "script_detect_v1": _script(scripts.dominant_of_five, _five_sql()),
    "script_detect_v2": _script(scripts.majority, _majority_sql()),
    "script_detect_v3": Query(script_sets, f"WITH {WITH_NAMES} SELECT id, array_to_string({_SET_SQL}, '+') AS scripts FROM names"),
    "script_detect_v4": _script(scripts.first_seen, _FIRST_SEEN_SQL),
    "script_detect_v5": _script(scripts.dominant_letters, _first_sql(scripts.LETTERS, "Other", _LETTERS)),
    "script_detect_v6": Query(script_alphabets, f"WITH {WITH_NAMES} SELECT id, " + ", ".join(f"regexp_matches(name, '\\A[{v}]*\\z') AS in_{k.lower()}" for k, v in _MEMBERS.items()) + " FROM (SELECT id, name FROM names UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('w{i}', '{w}')" for i, w in enumerate(_WORDS)) + ") w(id, name))"),
    "cross_script": Query(cross_script, f"""WITH {WITH_NAMES}, s AS (SELECT {_SET_SQL} AS s, {_FIRST_SEEN_SQL} AS f FROM names), k AS (SELECT array_to_string(s, '+') AS kind, s, f, count(*) AS n FROM s GROUP BY ALL)
SELECT x.kind AS kind_a, x.f AS f_a, y.kind AS kind_b, y.f AS f_b, CAST(CASE WHEN x.kind = y.kind AND x.f = y.f THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS BIGINT) AS pairs, len(list_intersect(x.s, y.s)) = 0 AS no_common_script,
  x.f <> y.f AND x.f <> 'UNKNOWN' AND y.f <> 'UNKNOWN' AS differs FROM k x JOIN k y ON x.kind < y.kind OR (x.kind = y.kind AND x.f <= y.f)"""),
    "entity_scripts": Query(entity_scripts, f"""WITH {WITH_NAMES}, s AS (SELECT substr(id, 1, 1) || (CAST(substr(id, 2) AS BIGINT) // 4) AS entity, {_SET_SQL} AS s FROM names)
SELECT entity, bool_or(list_contains(s, 'Latin')) AND bool_or(len(list_filter(s, lambda x: x NOT IN ('Latin', 'Other'))) > 0) AS has_cross, count(*) FILTER (len(s) = 1 AND s[1] = 'Latin') * count(*) FILTER (NOT list_contains(s, 'Latin')) AS pairs FROM s GROUP BY entity"""),
    "lexical_score": Query(lexical_score, f"""WITH {WITH_NAMES}, {_SCORED}, c AS (SELECT id, len(list_intersect({_A}, {_B})) AS n, len(list_distinct(list_concat({_A}, {_B}))) AS m FROM s),
k AS (SELECT id, CASE WHEN n > 0 THEN CAST(floor(100.0 * n / m) AS INTEGER) END AS score FROM c)
SELECT id, score, {_bucket_sql("NAME")} AS bucket, {_bucket_sql("BIZNAME")} AS biz_bucket, CASE WHEN score IS NULL THEN 'NO GNR' WHEN score >= 85 THEN 'PASS' ELSE 'FAIL' END AS validity FROM k"""),
}
