"""Toxic passages as maximum-scoring segments.

Words score the log-odds of occurring in toxic rather than clean documents,
under Dirichlet priors in proportion to all labelled text (Monroe et al., 2008);
words that the labels say little about score as their longest telling prefix
does. All maximal segments of a text come from one linear scan (Ruzzo and Tompa,
1999). A segment's score S becomes lambda * S - ln(K * n) by the extreme-value
theory of such scores (Karlin and Altschul, 1990), and the segments above zero,
the significant ones, make up a document's evidence, which a logistic curve
turns into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, map_rows, remainder

_TOKEN = re.compile(r"\w+")
#: Prefix lengths a word falls back on, longest first.
PREFIXES = (7, 6, 5, 4)
DRIFT = 0.1
#: Least scores that words may be asked for.
CUTS = (0.0, 1.5, 3.0, 4.0)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def scored(text: str | None, memo: dict[str, float]) -> np.ndarray:
    """A score for each word, at each of its places."""
    words = tokens(text)
    return np.fromiter(map(memo.__getitem__, words), float, len(words))


class _Scores(dict):
    """Word to score by its longest telling prefix; forgets all when full."""

    def __init__(self, nodes: dict[str, float]):
        self.nodes = nodes

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        score = self.nodes.get(word + "$")
        for k in PREFIXES:
            if score is not None:
                break
            if len(word) >= k:
                score = self.nodes.get(word[:k])
        self[word] = made = (score or 0.0) - DRIFT
        return made


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences ``(start, end, score)``, end exclusive,
    in order, in linear time."""
    total = 0.0
    found: list[list] = []  # start, end, sum before it, sum through it, nearest earlier one with a smaller sum before
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        start, low, high = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, i + 1, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """``segments`` of an array; runs of words that score nothing are skipped in
    one step, as segments begin and end at positive scores."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.r_[0.0, np.cumsum(scores)]
    gaps = sums[at[1:]] - sums[at[:-1] + 1]
    short = np.empty(2 * len(at) - 1)
    short[0::2] = scores[at]
    short[1::2] = np.minimum(gaps, 0.0)
    return [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, s) for a, b, s in segments(short.tolist())]


@dataclass
class Model:
    nodes: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (-10.0, 0.0, 0.0)

    def evidence(self, text: str | None, memo: _Scores) -> tuple[list[tuple[int, int, float]], float, float, int]:
        """The passages (as word positions) above the level that chance reaches,
        the best one's and their summed excess, and the number of words."""
        scores = scored(text, memo)
        if not len(scores):
            return [], 0.0, 0.0, 0
        level = math.log(self.k * len(scores))
        found = [(a, b, self.lam * s - level) for a, b, s in passages(scores)]
        found = [x for x in found if x[2] > 0]
        return found, max((x[2] for x in found), default=0.0), sum(x[2] for x in found), len(scores)

    def probability(self, best: float, whole: float) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(best) + self.curve[2] * math.log1p(whole)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def counted(docs: DataFrame) -> DataFrame:
    """``word, clean, toxic``: documents with a word, over labelled ``docs``
    (``toxic``). Documents rather than occurrences, as words come in bursts."""

    def run(columns: list[list]) -> list:
        ids, texts, toxic = columns
        sums = (Counter(), Counter())
        for t, y in zip(texts, toxic):
            sums[y > 0].update(set(tokens(t)))
        words = list(sums[0].keys() | sums[1].keys())
        return [words, [sums[0][w] for w in words], [sums[1][w] for w in words]]

    part = map_rows(docs.select("doc_id", "text", "toxic"), run, "word string, clean long, toxic long", step=4096, size=16_000_000)
    return part.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def weigh(counts: DataFrame, prior: float = 0.01, z: float = 3.0) -> dict[str, float]:
    """Scores of words (marked ``$``) and prefixes whose log-odds differ from
    zero by ``z`` deviations. A score is what is left of the log-odds after one
    deviation. The words are those of a bounded sample of rows, and so are the
    scores that reach the driver."""
    counts = checkpoint(counts)
    total = counts.agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).first()
    if not total["a"] or not total["b"]:
        return {}
    parts = F.array(F.concat("word", F.lit("$")), *[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in PREFIXES])
    nodes = counts.select(F.explode(parts).alias("node"), "clean", "toxic").filter("node is not null")
    nodes = nodes.groupBy("node").agg(F.sum("clean").cast("double").alias("a"), F.sum("toxic").cast("double").alias("b"))
    a, b = float(total["a"]), float(total["b"])
    alpha = 0.5 + prior * (F.col("a") + F.col("b"))
    pa, pb = alpha * (a / (a + b)), alpha * (b / (a + b))
    x, y = F.col("a") + pa, F.col("b") + pb
    odds = F.log(y / (b * (1 + prior) - y)) - F.log(x / (a * (1 + prior) - x))
    scored = nodes.select("node", odds.alias("d"), F.sqrt(1 / y + 1 / x).alias("se"))
    kept = scored.filter(F.abs("d") >= z * F.col("se"))
    return {r["node"]: math.copysign(abs(r["d"]) - r["se"], r["d"]) for r in kept.collect()}


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1 for clean words; needs
    a negative mean and some positive score."""
    p = weights / weights.sum()
    if not (values > 0).any() or (p * values).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * values, 500))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * values, 500))).sum() > 1 else (mid, high)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - 0.01 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        beta = beta + np.clip(np.linalg.solve(curve, gradient), -3, 3)
    return tuple(beta.tolist())


def _above(nodes: dict[str, float], cut: float) -> dict[str, float]:
    """Scores with positive ones below ``cut`` set to zero. The words stay, so
    that none falls back on a prefix instead."""
    return {k: 0.0 if 0 < v < cut else v for k, v in nodes.items()}


def _calibrated(nodes: dict[str, float], rows: list, clean: list) -> tuple[Model, float]:
    """A model with its levels and curve from the calibrating texts, and its mean
    log loss over them."""
    model = Model(nodes)
    if clean:
        model.lam = _lambda(np.array([r["score"] for r in clean]), np.array([float(r["n"]) for r in clean]))
    # K from the segments of clean texts that pass the level of a text of one word.
    beyond = [(sum(model.lam * s > 1 for s in r["found"]), r["m"]) for r in rows if r["y"] == 0]
    model.k = max(1e-3, sum(n for n, _ in beyond) / max(1.0, sum(m for _, m in beyond) * math.exp(-1)))
    x, y = [], []
    for r in rows:
        over = [model.lam * s - math.log(max(1e-9, model.k * max(1, r["m"]))) for s in r["found"]]
        over = [s for s in over if s > 0]
        x.append((max(over, default=0.0), sum(over)))
        y.append(float(r["y"]))
    if len(set(y)) == 2:
        model.curve = _logistic(np.log1p(np.array(x)), np.array(y))
    p = np.clip([model.probability(*v) for v in x], 1e-6, 1 - 1e-6) if x else np.zeros(0)
    return model, float(-np.mean(np.where(np.array(y) > 0, np.log(p), np.log(1 - p)))) if x else math.inf


def fit(labelled: DataFrame, bound: int = 50_000) -> Model:
    """A model from ``doc_id, text, toxic`` rows, at most ``bound`` of them.
    Seven tenths of the rows, by a hash of the id, teach the words; the rest
    calibrates segments and probabilities, and chooses from which score on a word
    counts at all: weak ones follow a language or a source rather than a tone.
    Rows of one class alone teach nothing: then every probability is near zero."""
    rows = labelled.withColumn("_fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)))
    nodes = weigh(counted(rows.filter("_fold < 7")))
    if not nodes:
        return Model()

    def run(columns: list[list]) -> list:
        memos = [_Scores(_above(nodes, c)) for c in CUTS]
        out: list[list] = [[], [], [], [], [], [], []]
        for key, t, y in zip(*columns):
            for i, memo in enumerate(memos):
                scores = scored(t, memo)
                rounded, n = np.unique(np.round(scores, 1), return_counts=True)
                for c, v in zip(out, (key, i, int(y > 0), len(scores), [s for _, _, s in passages(scores)], rounded.tolist(), n.tolist())):
                    c.append(v)
        return out

    schema = "row long, cut int, y int, m long, found array<double>, score array<double>, n array<long>"
    row = F.xxhash64("doc_id", "text", "toxic")
    held = checkpoint(map_rows(rows.filter("_fold >= 7").select(row.alias("row"), "text", "toxic"), run, schema), compact=True)
    clean = held.filter("y = 0").select("cut", F.explode(F.arrays_zip("score", "n")).alias("x")).groupBy("cut", "x.score").agg(F.sum("x.n").alias("n")).collect()
    # Ids that repeat may make more rows than ids were drawn: the same ones stay on every run.
    few = held.select("row", "cut", "y", "m", "found").orderBy("row", "cut").limit(len(CUTS) * bound).collect()
    of = lambda found, i: [r for r in found if r["cut"] == i]
    models = [_calibrated(_above(nodes, c), of(few, i), of(clean, i)) for i, c in enumerate(CUTS)]
    return min(models, key=lambda m: m[1])[0]


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 50_000) -> DataFrame:
    """``doc_id, text, toxic`` of at most ``bound`` labelled documents outside
    the held-out quarter; a row labelled twice is toxic if either label says so.
    The sample's ids are broadcast, so no text is shuffled."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(remainder("doc_id", 4) != 2)
    few = bounded_sample(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", bound)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def score(docs: DataFrame, model: Model, cutoff: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, passages`` for each row of ``docs``: the
    probability of the toxic label, whether it reaches ``cutoff``, and the
    significant passages (first word, last word exclusive, excess).

    Null and empty texts have no evidence and get the curve's lowest value. Null
    ids and repeated rows are scored like others; only ``doc_id`` and ``text``
    are read.
    """

    def run(columns: list[list]) -> list:
        memo = _Scores(model.nodes)
        out: list[list] = [[], [], []]
        for t in columns[1]:
            found, best, whole, _ = model.evidence(t, memo)
            p = model.probability(best, whole)
            for c, v in zip(out, (p, int(p >= cutoff), [{"first": a, "end": b, "excess": e} for a, b, e in found])):
                c.append(v)
        return [columns[0], *out]

    schema = "doc_id long, score double, predicted int, passages array<struct<first:int,end:int,excess:double>>"
    return map_rows(docs.select("doc_id", "text"), run, schema)
