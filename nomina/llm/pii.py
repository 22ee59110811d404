"""Personal data by weak supervision.

Patterns propose spans, five labelers vote on each (valid form, regular
structure, gazetteer, context, free-standing), expectation-maximisation
estimates how reliable each labeler is for present and absent personal data, and
a logistic span classifier learns from the posteriors. Votes and shapes are few,
so the model is fitted on the counts of their combinations over the whole
corpus, a table whose size does not grow with it.

The base spans, fixed by rule, always stay; the classifier adds spans that the
base rules miss and that overlap none of theirs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, map_rows

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("valid", "structure", "gazetteer", "context", "alone")

# Base rules. The lookbehinds and possessive runs accept what the plain patterns
# accept, without starting anew inside a run that has failed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider proposals.
_WIDE = {
    "email": re.compile(r"[\w.%+-]{1,64}\s?[(\[{]\s?(?:at|AT|@)\s?[)\]}]\s?[\w-]{1,63}(?:\s?(?:\.|[(\[{]\s?(?:dot|DOT)\s?[)\]}])\s?[\w-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?P<s>[ .-]?)[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}(?!\w)"),
    "phone": re.compile(r"(?<![\w.-])(?:\+|00)?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
}
# What each of them needs somewhere in the text.
_AT = re.compile(r"[(\[{]\s?(?:at|AT|@)\s?[)\]}]")
_GATE = {"email": _AT.search, "ip": lambda t: t.count(".") >= 3 or t.count(":") >= 7, "card": lambda t: True, "phone": lambda t: True}
_DIGIT = re.compile(r"[0-9]{2}|[0-9][.:]")
# What the gazetteer and the context labelers know.
_TLDS = frozenset("com org net edu gov io de fr es it uk eu us ca au jp info biz dev app".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
_FOR = {
    "email": frozenset("mail email e-mail contact write reach courriel correo kontakt".split()),
    "ip": frozenset("ip host server address addr ping login adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte iban".split()),
    "phone": frozenset("phone tel call mobile cell fax telephone ring dial anruf llamar appelez".split()),
}
_AGAINST = frozenset("version isbn issn doi sha md5 token key password serial sku part order invoice build commit id article section".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)``, sorted; kind by its place in ``KINDS``."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _vote(text: str, kind: str, start: int, end: int) -> str:
    """Votes of the labelers (+ for, - against, 0 abstaining) and the shape."""
    span = text[start:end]
    digits = _digits(span)
    words = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])[-4:] + _WORD.findall(text[end : end + 24])[:2]]
    if kind == "email":
        valid, structure = "+", "+" if "." in span or "dot" in span.lower() else "-"
        gazetteer = "+" if re.split(r"\W+", span.lower().rstrip(")]}"))[-1] in _TLDS else "0"
    elif kind == "ip":
        four = "." in span
        valid = "+" if not four or _octets(span) else "-"
        structure = "-" if four and any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else "+"
        gazetteer = "-" if four and span.startswith(("0.", "255.")) else "0"
    elif kind == "card":
        valid = "+" if 12 <= len(digits) <= 19 and luhn(digits) else "-"
        structure = "+" if len(digits) in (15, 16) else "0"
        gazetteer = "+" if digits.startswith(_ISSUERS) else "-"
    else:
        n = len(digits)
        valid = "+" if 9 <= n <= 15 else "-"
        structure = "+" if span[0] == "+" or span.startswith("00") or "(" in span else "0" if n == 10 else "-"
        gazetteer = "-" if digits[-10:-7][:1] in ("0", "1") else "0"
    context = "+" if _FOR[kind].intersection(words) else "-" if _AGAINST.intersection(words) else "0"
    before, after = text[start - 1 : start], text[end : end + 1]
    alone = "+" if (not before or before.isspace() or before in "(<[\"':,") and (not after or after.isspace() or after in ")>]\"',.;:!?") else "-"
    shape = f"{min(9, len(span) // 4)}{min(4, sum(c in ' .-()' for c in span))}"
    return valid + structure + gazetteer + context + alone + shape


def _covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the stretches that spans, sorted by start, cover."""
    begins: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)
    return begins, ends


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, votes)`` of proposals, the base spans among them."""
    found = [(s, k, e, _vote(text, KINDS[k], s, e)) for s, k, e in base]
    begins, ends = _covered(base)
    numbers = _DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if not _GATE[kind](text) or kind != "email" and not numbers:
            continue
        for m in _WIDE[kind].finditer(text):
            s, e = m.span()
            at = bisect_left(begins, e)  # stretches are apart: the last that begins before the end is the one to meet
            if not at or ends[at - 1] <= s:
                found.append((s, k, e, _vote(text, kind, s, e)))
    return found


@dataclass
class Model:
    """The span classifier, as the probability of each combination it has seen."""

    prob: dict[tuple[int, str], float]
    reliability: dict[str, tuple[float, float]]

    def adds(self, kind: int, votes: str) -> bool:
        return self.prob.get((kind, votes), 0.0) >= 0.5


_VOTE = {"+": 0, "0": 1, "-": 2}


def _posterior(votes: np.ndarray, kinds: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene over votes (rows x labelers, 0 for, 1 abstaining, 2 against):
    the posteriors and, for absent and present, each labeler's vote
    probabilities. Pseudo-counts say that labelers beat chance."""
    lean = (votes == 0).sum(1) - (votes == 2).sum(1)
    p = np.clip(0.5 + 0.15 * lean, 0.05, 0.95)
    prior = 20 * np.array([[0.15, 0.5, 0.35], [0.4, 0.5, 0.1]])
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for y, q in ((0, 1 - p), (1, p)):
            for j in range(votes.shape[1]):
                n = np.bincount(votes[:, j], q * weight, 3) + prior[y]
                table[y, j] = n / n.sum()
        share = np.array([(p * weight)[kinds == k].sum() + 1 for k in range(len(KINDS))]) / np.array([weight[kinds == k].sum() + 2 for k in range(len(KINDS))])
        score = np.log(share / (1 - share))[kinds]
        for j in range(votes.shape[1]):
            score = score + np.log(table[1, j, votes[:, j]]) - np.log(table[0, j, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, table


def _features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    one = [np.ones(len(kinds))]
    one += [(kinds == k).astype(float) for k in range(len(KINDS))]
    one += [(votes[:, j] == v).astype(float) for j in range(votes.shape[1]) for v in (0, 2)]
    one += [(kinds == k) * shapes[:, j] / 5.0 for k in range(len(KINDS)) for j in range(2)]
    return np.stack(one, 1)


def fit(counts: dict[tuple[int, str], int]) -> Model:
    """Reliabilities and the span classifier from the counts of (kind, votes)."""
    if not counts:
        return Model({}, {})
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], float)
    kinds = np.array([k for k, _ in keys])
    votes = np.array([[_VOTE[c] for c in v[: len(LABELERS)]] for _, v in keys])
    shapes = np.array([[int(c) for c in v[len(LABELERS) :]] for _, v in keys], float)
    target, table = _posterior(votes, kinds, weight)
    x = _features(kinds, votes, shapes)
    w = weight / weight.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (target - p)) - 1e-3 * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(curve, gradient), -2, 2)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    # A span that its own validity check refuses is never added.
    prob = {k: float(v) if k[1][0] == "+" else 0.0 for k, v in zip(keys, p, strict=True)}
    return Model(prob, {name: (float(table[1, j, 0]), float(table[0, j, 2])) for j, name in enumerate(LABELERS)})


def train(docs: DataFrame) -> Model:
    """The model of a corpus, from the counts of (kind, votes) over all of it;
    each task sends one row for each combination it has met."""

    def run(columns: list[list]) -> list:
        tally: Counter = Counter()
        for t in columns[1]:
            if t:
                tally.update((k, v) for _, k, _, v in candidates(t, base_spans(t)))
        return [[k for k, _ in tally], [v for _, v in tally], list(tally.values())]

    part = map_rows(docs.select("doc_id", "text"), run, "kind int, votes string, n long", step=4096, size=16_000_000)
    counts = part.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return fit({(r["kind"], r["votes"]): r["n"] for r in counts})


def spans(text: str | None, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text, as ``(start, kind, end)``."""
    if not text:
        return [], []
    base = base_spans(text)
    mine, more = set(base), []
    for s, k, e, v in sorted(candidates(text, base), key=lambda x: (x[0], -x[2], x[1])):
        # Those before it are apart and sorted, so the last reaches furthest.
        if (s, k, e) not in mine and model.adds(k, v) and (not more or more[-1][2] <= s):
            more.append((s, k, e))
    return base, more


def say(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` for each row of
    ``docs``: how many base spans of each kind, and ``kind:start:end`` (code
    points, end exclusive) of the base spans and of all spans, by start, then
    kind, comma-joined.

    A null or empty text has none. Null ids and repeated rows are treated like
    any other row; a model of no proposals adds nothing. Only ``doc_id`` and
    ``text`` are read.
    """

    def run(columns: list[list]) -> list:
        both = [spans(t, model) for t in columns[1]]
        counts = [[sum(k == kind for _, k, _ in base) for base, _ in both] for kind in range(len(KINDS))]
        return [columns[0], *counts, [say(b) for b, _ in both], [say(b + m) for b, m in both]]

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string"
    return map_rows(docs.select("doc_id", "text"), run, schema)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """A text with each span replaced by its kind; where spans overlap, by the
    first one's, over the whole of them."""
    out, at = [], 0
    for start, kind, end in sorted(found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the spans of every text replaced by their kinds, all other
    columns as they are and no row moved; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in cuts(batch.num_rows, batch.column(at)):
                part = batch.slice(start, n)
                texts = [t if t is None else redact(t, sum(spans(t, model), [])) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
