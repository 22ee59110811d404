"""Writing-script detection: six rules that differ on purpose. All but the
Unicode-name one are column expressions that count code-point classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code-point classes of each rule, in order of precedence.
FIVE = {
    "latin": r"\x{41}-\x{7A}\x{C0}-\x{24F}", "cyrillic": r"\x{400}-\x{4FF}", "arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}",
    "cjk": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}",
}
MAJORITY = {
    "Latin": r"\x{41}-\x{7A}\x{C0}-\x{FF}", "Cyrillic": r"\x{400}-\x{4FF}", "Georgian": r"\x{10A0}-\x{10FF}",
    "Arabic": r"\x{600}-\x{6FF}", "Chinese": r"\x{4E00}-\x{9FFF}",
}
FIRST_SEEN = {
    "CJK": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{30A0}-\x{30FF}\x{3040}-\x{309F}",
    "KOREAN": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "CYRILLIC": r"\x{400}-\x{52F}", "ARABIC": r"\x{600}-\x{6FF}\x{750}-\x{77F}",
    "HEBREW": r"\x{590}-\x{5FF}", "DEVANAGARI": r"\x{900}-\x{97F}", "TAMIL": r"\x{B80}-\x{BFF}", "THAI": r"\x{E00}-\x{E7F}",
    "GREEK": r"\x{370}-\x{3FF}", "LATIN": r"\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}",
}
FIRST_SEEN_SKIPS = r".,;:!?()\[\]{}\"'\-"
# Membership tables by script and language, and those of letters no
# relative has.
TABLES = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "CJK": ((0x4E00, 0x9FFF), (0x3000, 0x303F), (0xFF61, 0xFF64)),
    "Cyrillic": ((0x400, 0x4FF), (0x500, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0x1C80, 0x1C8F), (0x1E030, 0x1E08F)),
    "Greek": ((0x370, 0x3E1), (0x3F0, 0x3FF), (0x1F00, 0x1FFF)),
    "Han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)),
    "Hiragana": ((0x3040, 0x309F),),
    "Katakana": ((0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF65, 0xFF9F)),
    "Hangul": ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3130, 0x318F), (0xFFA0, 0xFFDF)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0x870, 0x89F), (0x10EC0, 0x10EFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Hebrew": ((0x590, 0x5FF),),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF), (0x11B00, 0x11B5F)),
    "Thai": ((0xE00, 0xE7F),),
    "Turkish": (
        (0x41, 0x50), (0x61, 0x70), (0x52, 0x56), (0x72, 0x76), (0x59, 0x5A), (0x79, 0x7A), (0xC7, 0xC7), (0xE7, 0xE7),
        (0x11E, 0x11F), (0x130, 0x131), (0xD6, 0xD6), (0xF6, 0xF6), (0x15E, 0x15F), (0xDC, 0xDC), (0xFC, 0xFC),
    ),
    "ascii": ((0x0, 0x7F),),
    "indic": ((0x900, 0xDFF), (0xA830, 0xA83F)),
    "punctuation": ((0x0, 0x40), (0x5B, 0x60), (0x7B, 0x7F), (0x80, 0xBF), (0x2000, 0x206F), (0xFF01, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEE)),
    "russian": ((0x401, 0x401), (0x410, 0x44F), (0x451, 0x451)),
    "only_russian": ((0x401, 0x401), (0x42A, 0x42B), (0x42D, 0x42D), (0x44A, 0x44B), (0x44D, 0x44D), (0x451, 0x451)),
    "ukrainian": (
        (0x404, 0x404), (0x406, 0x407), (0x410, 0x429), (0x42C, 0x42C), (0x42E, 0x449), (0x44C, 0x44C), (0x44E, 0x44F),
        (0x454, 0x454), (0x456, 0x457), (0x490, 0x491),
    ),
    "only_ukrainian": ((0x404, 0x404), (0x407, 0x407), (0x454, 0x454), (0x457, 0x457), (0x490, 0x491)),
    "belarusian": (
        (0x401, 0x401), (0x406, 0x406), (0x40E, 0x40E), (0x410, 0x428), (0x42B, 0x437), (0x439, 0x448), (0x44B, 0x44F),
        (0x451, 0x451), (0x456, 0x456), (0x45E, 0x45E),
    ),
    "only_belarusian": ((0x40E, 0x40E), (0x45E, 0x45E)),
}


def chars(ranges: tuple[tuple[int, int], ...]) -> str:
    """Ranges as the inside of a regular expression's class."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def _without(ranges: tuple, others: tuple) -> tuple:
    """What is left of some ranges after others."""
    for c, d in others:
        ranges = tuple((x, y) for a, b in ranges for x, y in ((a, min(b, c - 1)), (max(a, d + 1), b)) if x <= y) if ranges else ()
    return ranges


def _first_of(names: tuple[str, ...]) -> dict[str, str]:
    """Classes of the tables in order; a code point of two belongs to the first."""
    before: tuple = ()
    out = {}
    for name in names:
        out[name] = chars(_without(TABLES[name], before))
        before += TABLES[name]
    return out


LETTERS = _first_of(("Latin", "CJK", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Devanagari", "Thai", "Turkish"))


def _n(text: Column, members: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{members}]"))


def _leader(counts: dict[str, Column], default: str) -> Column:
    """The first name with the largest count; ``default`` if all are zero."""
    most = F.greatest(*counts.values())
    out = F.when(most == 0, default)
    for name, n in counts.items():
        out = out.when(n == most, name)
    return out


def dominant_of_five(text: Column) -> Column:
    """latin, cyrillic, arabic, cjk or other, ties to the first; digits count as
    other, white space alone is latin, the empty string empty."""
    counts = {k: _n(text, v) for k, v in FIVE.items()}
    counts["other"] = F.regexp_count(text, F.lit(rf"(?U)[^\s{''.join(FIVE.values())}]"))
    return F.when(text.isNull() | (text == ""), "empty").otherwise(_leader(counts, "latin"))


def majority(text: Column) -> Column:
    """The script of over six tenths of the letters, else Mixed or Unknown."""
    counts = {k: _n(text, v) for k, v in MAJORITY.items()}
    total = sum(counts.values(), F.lit(0))
    out = F.when(text.isNull() | (total == 0), "Unknown")
    for name, n in counts.items():
        out = out.when(n > 0.6 * total, name)
    return out.otherwise("Mixed")


def _seen_first(text: Column, classes: dict[str, str], default: str) -> Column:
    """The most frequent class, ties to the one that comes first in the text."""
    ranked = [F.struct(_n(text, c).alias("n"), (-F.length(F.regexp_replace(text, f"(?s)[{c}].*", ""))).alias("at"), F.lit(k).alias("name")) for k, c in classes.items()]
    best = F.array_max(F.array(*ranked))
    return F.when(text.isNull() | (best["n"] == 0), default).otherwise(best["name"])


def first_seen(text: Column) -> Column:
    """The most frequent of ten scripts and OTHER, ties to the first in the
    text; UNKNOWN without anything but white space and common marks."""
    other = rf"^\s{FIRST_SEEN_SKIPS}{''.join(FIRST_SEEN.values())}"
    return _seen_first(text, FIRST_SEEN | {"OTHER": other}, "UNKNOWN")


def dominant_letters(text: Column) -> Column:
    """The most frequent script among letters; a code point that two tables hold
    belongs to the first."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return _seen_first(letters, LETTERS, "Other")


def within(text: Column, alphabet: str) -> Column:
    """Whether every character is in a table; true for the empty string."""
    return text.rlike(rf"\A[{chars(TABLES[alphabet])}]*\z")


# Parts of Unicode names, in order.
_NAMED = (
    (("CJK", "HIRAGANA", "KATAKANA"), "CJK"), (("HANGUL",), "Korean"), (("CYRILLIC",), "Cyrillic"), (("ARABIC",), "Arabic"),
    (("HEBREW",), "Hebrew"), (("THAI",), "Thai"), (("DEVANAGARI", "BENGALI", "TAMIL", "TELUGU"), "Indic"), (("GREEK",), "Greek"),
)
_memo: dict[str, str] = {}


def _script(char: str) -> str:
    if char not in _memo:
        name = unicodedata.name(char, "")
        hit = next((s for parts, s in _NAMED if any(p in name for p in parts)), None)
        _memo[char] = hit or ("Latin" if "LATIN" in name or char.isascii() else "Other")
    return _memo[char]


@F.pandas_udf(T.ArrayType(T.StringType()))
def script_set(text: pd.Series) -> pd.Series:
    """The scripts of a text's letters by Unicode name, sorted. No built-in
    function knows character names, hence an Arrow UDF."""
    return text.map(lambda t: sorted({_script(c) for c in t if c.isalpha()}) if t is not None else None)


def cross_script(a: Column, b: Column) -> Column:
    """Two script sets without a common one; true for two empty ones."""
    return F.size(F.array_intersect(a, b)) == 0


def differs(a: Column, b: Column) -> Column:
    """Two ``first_seen`` scripts that differ, both known."""
    return (a != b) & (a != "UNKNOWN") & (b != "UNKNOWN")


def has_cross_script(sets: Column) -> Column:
    """An array of script sets with Latin and another script but Other."""
    scripts = F.array_distinct(F.flatten(sets))
    return F.array_contains(scripts, "Latin") & (F.size(F.array_except(scripts, F.array(F.lit("Latin"), F.lit("Other")))) > 0)


def cross_script_pairs(sets: Column) -> Column:
    """Purely Latin names times names without Latin."""
    latin = F.size(F.filter(sets, lambda s: (F.size(s) == 1) & F.array_contains(s, "Latin")))
    return latin * F.size(F.filter(sets, lambda s: ~F.array_contains(s, "Latin")))
