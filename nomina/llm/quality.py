"""Quality rules and an isolation forest over their statistics.

Trees grow on subsamples of all labelled good documents, over their statistics in
robust units. A cell is split anywhere within its bounds, and the first cell
reaches beyond the sample on every side; so a document unlike the good ones soon
falls into a part without any, by one statistic far out or by several that are
each a little out, and its mean path is short. The threshold on the path lengths
is calibrated on all labelled rows that no tree may see.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, cuts, map_rows, raw

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on, all free of a text's language.
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "long_word", "variety")
#: Least unit of a statistic, where good documents hardly vary in it.
UNIT = 0.05
#: Steps of a score from 0 to 1 that calibration tells apart.
LEVELS = 10_000
#: Levels of a tree; splits beyond the sample part nothing, so more than log2.
HEIGHT = 16

_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)
_UPPER = np.arange(65, 91)
_LETTERS = np.r_[_UPPER, np.arange(97, 123)]
_DIGITS = np.arange(48, 58)
_MARKS = np.frombuffer(b"!?\"'()[]{}:;=@^_`~\\/+-", np.uint8)
_CONTINUED = np.arange(0x80, 0xC0)


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The rule counts of a text, exactly, and its forest features."""
    text = text or b""
    words = text.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(seen[_CONTINUED].sum()) - int(seen[_SPACES].sum())
    symbols = int(seen[_SYMBOLS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeats = _repeats(order, len(ids)) if n >= 3 else 0
    letters = max(1, int(seen[_LETTERS].sum()))
    m = max(1, n)
    features = [
        chars / m, symbols / m, dup / max(1, len(lines)), repeats / m, int(seen[_UPPER].sum()) / letters,
        int(seen[_MARKS].sum()) / m, int(seen[_DIGITS].sum()) / m,
        math.log1p(max(map(len, ids), default=0)), len(ids) / m ** 0.8,
    ]
    return [n, chars, symbols, dup, repeats], features


def _repeats(ids: np.ndarray, kinds: int) -> int:
    if kinds < 1 << 20:
        windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        windows = pairs * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    w = windows[order]
    same = w[1:] == w[:-1]
    twice = np.zeros(len(w), bool)
    twice[order] = np.r_[False, same] | np.r_[same, False]
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= twice
    return int(hit.sum())


@dataclass(frozen=True)
class Rules:
    """The base rule: fewer than ``min_words`` words, or over ``max_repeat``
    percent of them in repeated three-word windows, fail."""

    min_words: int = 50
    max_repeat: int = 50

    def fail(self, counts: list[int]) -> bool:
        return counts[0] < self.min_words or 100 * counts[4] > self.max_repeat * counts[0]


@dataclass
class Forest:
    """Isolation trees as flat arrays. A node's children are ``left`` and the one
    after it; a leaf is its own left child and splits at infinity."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray  # path length at a leaf, with what its rows would add
    centre: np.ndarray  # median and unit of the good rows, by feature
    unit: np.ndarray
    usual: float = 1.0
    threshold: float = math.inf

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path lengths."""
        out = np.zeros(len(x))
        for at in range(0, len(x), 2048):
            z = robust(x[at : at + 2048], self.centre, self.unit)
            rows = np.arange(len(z))[:, None]
            node = np.repeat(self.roots[None, :], len(z), axis=0)
            for _ in range(HEIGHT):
                node = self.left[node] + (z[rows, self.feature[node]] >= self.split[node])
            out[at : at + 2048] = self.length[node].mean(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / usual length): a half for good documents,
        near 1 for anomalies."""
        return 2.0 ** (-self.paths(x) / self.usual)


def expected(n: int) -> float:
    """What ``n`` rows left in a leaf would add to a path, on average."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def robust(x: np.ndarray, centre: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Distances from the centre in units, logarithmic beyond some of them."""
    z = (x - centre) / unit
    return np.sign(z) * np.log1p(np.abs(z))


def grow(good: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 42) -> Forest:
    """An isolation forest of good rows; each tree sees ``rows`` random ones.
    The first cell is three times as wide as its sample, two units more at
    least; a split takes any feature and any place within the cell."""
    rng = np.random.default_rng(seed)
    low, centre, high = np.percentile(good, [2.5, 50, 97.5], axis=0)
    drawn = [good[rng.choice(len(good), min(rows, len(good)), replace=False)] for _ in range(trees)]
    forest = planted(drawn, centre, np.maximum(high - low, UNIT), seed)
    forest.usual = max(1e-9, float(np.median(forest.paths(good))))
    return forest


def planted(samples: list[np.ndarray], centre: np.ndarray, unit: np.ndarray, seed: int = 42) -> Forest:
    """A tree for each sample of rows, as ``grow`` says; paths are not yet
    compared with usual ones."""
    rng = np.random.default_rng(seed)
    feature: list[int] = []
    split: list[float] = []
    left: list[int] = []
    length: list[float] = []

    def add() -> int:
        left.append(len(left))
        feature.append(0)
        split.append(math.inf)
        length.append(0.0)
        return len(left) - 1

    roots = []
    for sample in samples:
        part = robust(sample, centre, unit)
        low, high = part.min(axis=0), part.max(axis=0)
        margin = np.maximum(high - low, 1.0)
        roots.append(add())
        stack = [(roots[-1], part, low - margin, high + margin, 0)]
        while stack:
            k, part, low, high, depth = stack.pop()
            if depth == HEIGHT or len(part) < 2:
                length[k] = depth + expected(len(part))
                continue
            f = int(rng.integers(part.shape[1]))
            s = float(rng.uniform(low[f], high[f]))
            above = part[:, f] >= s
            feature[k], split[k], left[k] = f, s, add()
            add()
            low2, high2 = low.copy(), high.copy()
            low2[f] = high2[f] = s
            stack += [(left[k], part[~above], low, high2, depth + 1), (left[k] + 1, part[above], low2, high, depth + 1)]
    return Forest(*map(np.array, (roots, feature, split, left, length)), centre, unit)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, spare: float) -> Forest:
    """Set the threshold that ``best_threshold`` finds on rows."""
    forest.threshold = best_threshold(forest.scores(x), good, np.ones(len(x), int), spare)
    return forest


def best_threshold(scores: np.ndarray, good: np.ndarray, n: np.ndarray, spare: float, step: float = 0.0) -> float:
    """The threshold that best tells good rows from bad ones (largest sum of the
    shares told right), ``n`` for each score, among those that reject at most
    ``spare`` of the good, and in the middle of the scores that tell the same;
    scores may stand for those less than ``step`` above them. Infinity without bad rows: nothing is rejected."""
    good, best, threshold = np.asarray(good, bool), 0.0, math.inf
    values, at = np.unique(scores, return_inverse=True)
    fine, bad = (np.cumsum(np.bincount(at[side], n[side], len(values))[::-1])[::-1] for side in (good, ~good))
    for below, t, f, b in zip(np.r_[values[:1], values[:-1]], values, fine, bad):
        lost, gain = f / max(1, fine[0]), b / max(1, bad[0])
        if lost <= spare and gain - lost > best:
            best, threshold = gain - lost, min(float(t), float((below + step + t) / 2))
    return threshold


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), spare: float = 0.015, trees: int = 100, size: int = 256) -> Forest | None:
    """A forest from all labelled documents that pass the base rule. Trees grow on
    the good ones of one half, by a hash of the id, and the other half
    calibrates, every row of it. Units are percentiles of all good rows that may
    grow, to a thousandth of their rank. What the method samples is what a tree
    sees: ``size`` rows, those with the smallest hashes of its number and their id
    among all that may grow. Those rows, and the scores' counts in ``LEVELS``
    steps, are what the driver gets. A row labelled twice counts as bad if either
    label is. None without labelled good rows to grow on."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))

    def run(columns: list[list]) -> list:
        both = [statistics(t) for t in columns[1]]
        ok = [i for i, b in enumerate(both) if not rules.fail(b[0])]
        return [[columns[0][i] for i in ok], [both[i][1] for i in ok]]

    # Statistics are joined, since texts would be moved.
    told = map_rows(docs.select("doc_id", raw("text").alias("t")).filter("doc_id is not null"), run, "doc_id long, features array<double>")
    rows = told.join(marks, "doc_id").select("doc_id", "features", (F.col("q") > 0).alias("good"))
    rows = checkpoint(rows.withColumn("grows", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)) == 0))
    grow_on = rows.filter("good and grows")
    points = [F.percentile_approx(F.get("features", F.lit(k)), [0.025, 0.5, 0.975], 1000).alias(f"p{k}") for k in range(len(FEATURES))]
    told = grow_on.agg(F.count(F.lit(1)).alias("n"), *points).first()
    if not told["n"]:
        return None
    low, centre, high = np.array([told[f"p{k}"] for k in range(len(FEATURES))], float).T
    # A row is among a tree's with this chance or a little more; the rest is cut by hash.
    chance = min(1.0, (size + 8 * math.sqrt(size)) / told["n"])
    tries = grow_on.select("doc_id", "features", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("h", F.xxhash64(F.lit(42), "tree", "doc_id", "features"))
    drawn = tries.filter(F.col("h") <= F.lit(int(-(2**63) + chance * (2**64 - 1)) if chance < 1 else 2**63 - 1))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id", "features"))
    seen = drawn.withColumn("nth", nth).filter(F.col("nth") <= size).select("tree", "nth", "features").collect()
    parts: dict[int, list] = {}
    for r in sorted(seen, key=lambda r: (r["tree"], r["nth"])):
        parts.setdefault(r["tree"], []).append(r["features"])
    forest = planted([np.array(p) for p in parts.values()], centre, np.maximum(high - low, UNIT))

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(forest.paths(x)), batch.column(1), batch.column(2)], names=["path", "good", "grows"])

    paths = checkpoint(rows.select("features", "good", "grows").mapInArrow(path, "path double, good boolean, grows boolean"))
    forest.usual = max(1e-9, paths.filter("good and grows").agg(F.percentile_approx("path", 0.5, 1000)).first()[0])
    score = F.pow(F.lit(2.0), -F.col("path") / forest.usual)
    level = F.floor(score * LEVELS) / LEVELS
    found = paths.filter("not grows").groupBy(level.alias("level"), "good").agg(F.count(F.lit(1)).alias("n")).collect()
    forest.threshold = best_threshold(*(np.array([r[c] for r in found]) for c in ("level", "good", "n")), spare, 1 / LEVELS)
    return forest


def _verdicts(texts: list[bytes | None], forest: Forest | None, rules: Rules) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    both = [statistics(t) for t in texts]
    failed = np.array([rules.fail(b[0]) for b in both], bool)
    score = forest.scores(np.array([b[1] for b in both])) if forest and both else np.zeros(len(both))
    limit = forest.threshold if forest else math.inf
    return [b[0] for b in both], failed, score, ~failed & (score < limit)


def judge(docs: DataFrame, forest: Forest | None, rules: Rules = Rules()) -> DataFrame:
    """``doc_id``, the rule counts, ``base_failed``, ``anomaly`` (double, 0 to 1)
    and ``kept`` for each row of ``docs``.

    Texts that pass the base rules are kept unless the forest's score reaches its
    threshold; without a forest the base rules alone decide. A null text counts
    as no words. Null ids and repeated rows are judged like any other; only
    ``doc_id`` and ``text`` are read.
    """

    def run(columns: list[list]) -> list:
        counts, failed, score, kept = _verdicts(columns[1], forest, rules)
        return [columns[0], *([c[k] for c in counts] for k in range(len(COUNTS))), failed, score, kept]

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return map_rows(docs.select("doc_id", raw("text").alias("t")), run, schema)


def keep(docs: DataFrame, forest: Forest | None, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and
    without moving any. A null or empty text fails the rules and goes; ids play no
    part, so rows that repeat one are judged each, and equal rows share their
    fate."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in cuts(batch.num_rows, batch.column(at)):
                part = batch.slice(start, n)
                texts = [t.encode() if t is not None else None for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(_verdicts(texts, forest, rules)[3]))

    return docs.mapInArrow(run, docs.schema)
