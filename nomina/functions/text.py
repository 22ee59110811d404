"""Name rewriting rules as column expressions; all of them plan-time Python
over built-in functions, so that names never leave the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes, abbreviations and prepositions.
LEGAL_SUFFIXES = (
    "LIMITED", "LTD", "LTD.", "LLC", "L.L.C.", "INC", "INC.", "INCORPORATED",
    "CORP", "CORP.", "CORPORATION", "PLC", "P.L.C.", "SA", "S.A.",
    "COMPANY", "CO", "CO.", "AG", "GMBH", "N.V.", "B.V.",
    "PUBLIC COMPANY", "JOINT-STOCK COMPANY", "JSC", "OJSC", "CJSC",
)
ABBREVIATIONS = {
    "MANAGEMENT": "MGMT", "INTERNATIONAL": "INTL", "CORPORATION": "CORP", "COMPANY": "CO", "LIMITED": "LTD",
    "INCORPORATED": "INC", "ENTERPRISE": "ENTERPR", "INVESTMENT": "INVEST", "INVESTMENTS": "INVESTS",
    "DEVELOPMENT": "DEV", "TECHNOLOGIES": "TECH", "MANUFACTURING": "MFG", "SERVICES": "SVCS",
}
PREPOSITIONS = ("OF", "THE", "AND", "&", "FOR", "TO", "IN", "AT", "BY", "WITH")
#: Deleted anywhere in a business name, one after the other.
LEGAL_PATTERNS = (
    r"\bLimited Liability Company\b", r"\bLLC\b", r"\bLtd\.?\b", r"\bInc\.?\b",
    r"\bCorporation\b", r"\bCorp\.?\b", r"\bCompany\b", r"\bCo\.?\b",
    r"\bLimited\b", r"\bLLP\b", r"\bL\.L\.C\.\b", r"\bIncorporated\b",
)
#: Lower cut-offs of the buckets same, close, likely, plausible and unlikely.
BUCKETS = {"BIZNAME": (80, 60, 43, 30, 20), "NAME": (80, 50, 30, 20, 10)}
BUCKET_NAMES = ("same", "close", "likely", "plausible", "unlikely")


def words(name: Column) -> Column:
    """A name's words, cut at any white space."""
    return F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def stripped(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def complexity(name: Column) -> Column:
    n, special = F.size(words(name)), name.rlike(r"(?U)[^\w\s-]")
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(~special & (n <= 2), "simple")
        .when(~special & (n <= 4), "medium")
        .otherwise("complex")
    )


def legal_pattern(suffix: str) -> str:
    """A suffix, possibly before a mark, at the end of a name."""
    return r"\b" + suffix.replace(".", r"\.") + r"[.,]?\s*$"


def remove_legal_suffix(name: Column) -> Column:
    """A name without the longest suffix that leaves something of it."""

    def attempt(suffix: str) -> Column:
        pattern = "(?iuU)" + legal_pattern(suffix)
        left = stripped(F.regexp_replace(name, pattern, ""))
        return F.when(name.rlike(pattern) & (left != ""), left)

    by_length = sorted(LEGAL_SUFFIXES, key=len, reverse=True)
    return F.coalesce(*map(attempt, by_length), name)


def _mapped(name: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    parts = words(name)
    key = lambda w: F.rtrim(F.upper(w), F.lit(".,"))
    hit = F.exists(parts, lambda w: F.map_contains_key(pairs, key(w)))
    return F.when(hit, joined(F.transform(parts, lambda w: F.coalesce(F.try_element_at(pairs, key(w)), w)))).otherwise(name)


def abbreviate(name: Column) -> Column:
    """Business words in short, in capitals; unchanged without any."""
    return _mapped(name, ABBREVIATIONS)


def expand(name: Column) -> Column:
    """The reverse of ``abbreviate``, in title case."""
    return _mapped(name, {v: k.capitalize() for k, v in ABBREVIATIONS.items()})


def remove_prepositions(name: Column) -> Column:
    parts = words(name)
    rest = F.filter(parts, lambda w: ~F.upper(w).isin(*PREPOSITIONS))
    short = (F.size(parts) > 2) & (F.size(rest) > 0) & (F.size(rest) < F.size(parts))
    return F.when(short, joined(rest)).otherwise(name)


def drop_words(name: Column, n: int = 1) -> Column:
    """Without ``n`` words: from the middle if more than ``n + 2``, else the
    last ones; too short names stay."""
    parts = words(name)
    size = F.size(parts)
    middle = F.floor(size / 2).cast("int")
    cut = F.concat(F.slice(parts, F.lit(1), middle), F.slice(parts, middle + n + 1, F.greatest(size - middle - n, F.lit(0))))
    last = F.slice(parts, F.lit(1), F.greatest(size - n, F.lit(0)))
    return F.when(size > n + 2, joined(cut)).when(size > n + 1, joined(last)).otherwise(name)


def _first(parts: Column) -> Column:
    return F.get(parts, F.lit(0))


def _last(parts: Column) -> Column:
    return F.try_element_at(parts, F.lit(-1))


def drop_patronymic(name: Column) -> Column:
    parts = words(name)
    return F.when(F.size(parts) > 2, F.concat_ws(" ", _first(parts), _last(parts))).otherwise(name)


def reverse_name_order(name: Column) -> Column:
    """Last word, then first; those between are lost."""
    parts = words(name)
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", _last(parts), _first(parts))).otherwise(name)


def _variants(name: Column, rules: list[tuple[str, Column, Column]]) -> Column:
    """``(variant, variant_type)`` of the rules that apply and change something."""
    made = F.array(*[F.struct(F.when(when, v).alias("variant"), F.lit(kind).alias("variant_type")) for kind, v, when in rules])
    return F.filter(made, lambda x: x["variant"].isNotNull() & (x["variant"] != name) & (x["variant"] != ""))


def business_variants(name: Column) -> Column:
    always = F.lit(True)
    return _variants(name, [
        ("legal_suffix_removed", remove_legal_suffix(name), always),
        ("words_abbreviated", abbreviate(name), always),
        ("abbreviations_expanded", expand(name), always),
        ("prepositions_removed", remove_prepositions(name), always),
        ("word_dropped", drop_words(name), F.size(words(name)) > 3),
    ])


def person_variants(name: Column) -> Column:
    n = F.size(words(name))
    return _variants(name, [
        ("patronymic_dropped", drop_patronymic(name), n > 2),
        ("name_order_reversed", reverse_name_order(name), n >= 2),
    ])


def abbreviated_person(name: Column) -> Column:
    parts = words(name)
    first, last, n = _first(parts), _last(parts), F.size(parts)
    initial = F.left(first, F.lit(1))
    return _variants(name, [
        ("synthetic_abbreviated_initial_last", F.concat_ws(" ", initial, last), n >= 2),
        ("synthetic_abbreviated_initial_period", F.concat_ws(" ", F.concat(initial, F.lit(".")), last), n >= 2),
        ("synthetic_abbreviated_middle_initial", F.concat_ws(" ", first, F.left(F.get(parts, F.lit(1)), F.lit(1)), last), n >= 3),
    ])


def without_legal_entity(name: Column) -> Column:
    bare = reduce(lambda c, p: F.regexp_replace(c, "(?iU)" + p, ""), LEGAL_PATTERNS, name)
    return F.trim(bare, F.lit(' ,"'))


def abbreviated_business(name: Column) -> Column:
    return _variants(name, [("synthetic_abbreviated_no_legal_entity", without_legal_entity(name), F.lit(True))])


def fuzzy_variants(name: Column) -> Column:
    plain = F.regexp_replace(name, r"(?U)[^\w\s]", "")
    spaced = joined(words(name))
    return _variants(name, [
        ("synthetic_fuzzy_no_punctuation", plain, F.lit(True)),
        ("synthetic_fuzzy_normalized_spaces", spaced, spaced != plain),
        ("synthetic_fuzzy_hyphen_to_space", F.replace(name, F.lit("-"), F.lit(" ")), F.contains(name, F.lit("-"))),
    ])


def partial_variants(name: Column) -> Column:
    parts = words(name)
    return _variants(name, [
        ("synthetic_partial_first_last", F.concat_ws(" ", _first(parts), _last(parts)), F.size(parts) >= 3),
        ("synthetic_partial_last_only", _last(parts), F.size(parts) >= 2),
    ])


def synthetic_variants(name: Column, kind: str) -> Column:
    """All generated variants of a ``personal`` or ``business`` name, in order."""
    if kind == "personal":
        return F.concat(abbreviated_person(name), fuzzy_variants(name), partial_variants(name))
    if kind == "business":
        return F.concat(abbreviated_business(name), fuzzy_variants(name))
    raise ValueError(f"kind must be personal or business, not {kind}")


def triplet_variants(anchor: Column, aliases: Column, kind: str) -> Column:
    """``exact``, then aliases other than the anchor, then generated variants."""
    exact = F.array(F.struct(anchor.alias("variant"), F.lit("exact").alias("variant_type")))
    others = F.transform(F.filter(aliases, lambda a: a != anchor), lambda a: F.struct(a.alias("variant"), F.lit("alias").alias("variant_type")))
    return F.concat(exact, others, synthetic_variants(anchor, kind))


def bucket(score: Column, feature: str = "NAME") -> Column:
    """A score's bucket by the feature's cut-offs; null below all of them."""
    out = F.when(score.isNull(), None)
    for name, low in zip(BUCKET_NAMES, BUCKETS[feature], strict=True):
        out = out.when(score >= low, name)
    return out


def validity(score: Column) -> Column:
    return F.when(score.isNull(), "NO GNR").when(score >= 85, "PASS").otherwise("FAIL")


def truncated(text: Column, width: int = 60) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def hhmmss(seconds: Column) -> Column:
    s = seconds.cast("long")
    parts = (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.format_string("%02d:%02d:%02d", *[p.cast("long") for p in parts])


def probabilistic_or(name: Column, embedding: Column) -> Column:
    """Two scores of 0 to 100 as if either could prove the match."""
    return 100.0 * (1.0 - (1.0 - name / 100.0) * (1.0 - embedding / 100.0))


def lexical_score(a: Column, b: Column) -> Column:
    """The public stand-in for a name scorer, 0 to 100: the share of common
    words among all distinct lower-cased words, rounded down; null if none is
    common. It is not any product's score; tables may bring their own."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    common, all_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(common > 0, F.floor(100.0 * common / all_).cast("int"))


def iso_utc(at: Column) -> Column:
    """A timestamp in UTC with ``Z``; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def threshold_distance(theta: Column) -> Column:
    """The largest cosine distance that a similarity threshold admits."""
    return 1.0 - theta
