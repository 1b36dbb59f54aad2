"""Quality rules: document statistics, a plain base rule, and gradient-boosted trees over the statistics.

The trees are grown on histograms in numpy, with monotonic constraints on features whose direction is known (more symbols,
repeated lines or repeated words never raise the score), and flattened into node arrays that score a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import settle

from . import common

#: Labelled rows that the trees are grown on, at most.
ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper"]
#: Feature by feature: its name, and whether the score may only rise (1) or fall (-1) with it.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "line_length": 0, "distinct_share": 0, "digit_share": 0, "upper_share": 0}
TREES, DEPTH, RATE, BINS, LEAST_IN_LEAF, PENALTY = 80, 3, 0.15, 64, 20, 1.0
KEEP = 0.5

_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that the text has twice or more, and the number of different words."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = len(known)
    if len(ids) < 4:
        return 0, size
    if size < 1 << 21:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0, size
    hit = np.isin(windows, twice)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum()), size


def statistics(text: str) -> list[int]:
    """STATISTICS of a whole text, in order."""
    data = text.encode()
    words = data.split()
    lines = [l for l in data.split(b"\n") if l.strip()]
    repeated, distinct = repeat_words(words)
    without = lambda signs: len(data) - len(data.translate(None, signs))
    return [len(words), len(text) - sum(map(text.count, common.SPACES)), without(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), distinct, without(_DIGITS), without(_UPPER)]


def measured(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """STATISTICS, all long, beside the columns of docs; columns of these names give way. Null texts have none of anything."""

    def make():
        return lambda texts: [list(c) for c in zip(*map(statistics, texts))] or [[] for _ in STATISTICS]

    return common.map_texts(docs, make, [T.StructField(c, T.LongType()) for c in STATISTICS], text=text, keep=keep)


def features(columns: list[np.ndarray]) -> np.ndarray:
    words, chars, symbols, dups, repeats, lines, distinct, digits, upper = (c.astype(np.float64) for c in columns)
    share = lambda a, b: a / np.maximum(b, 1)
    return np.stack([np.log1p(words), share(chars, words), share(symbols, chars), share(dups, lines), share(repeats, words), share(words, lines), share(distinct, words), share(digits, chars), share(upper, chars)], 1)


@dataclass
class Trees:
    """Flattened trees: a node's feature (-1 at a leaf), threshold, children and value; where each tree begins; the bias."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows go down a tree together, a level at a time."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.feature[at] >= 0
                below = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Boosted trees for the log-loss. A split whose sides run against a feature's direction is not taken, and below a split on such a
    feature each side stays on its side of the middle, so the sum is monotonic."""
    nodes: list[list] = []
    roots: list[int] = []
    mean = min(max(y.mean() if len(y) else 1.0, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        none = np.zeros(0, np.int64)
        return Trees(none, np.zeros(0), none, none, np.zeros(0), none, bias if len(y) else 4.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    total = np.full(len(y), bias)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + PENALTY), low, high))
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, value * RATE])
        if depth == DEPTH or len(rows) < 2 * LEAST_IN_LEAF:
            total[rows] += value * RATE
            return me
        best = (1e-6, -1, 0, 0.0, 0.0)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            size = len(e) + 1
            left_g, left_h, left_n = (np.cumsum(np.bincount(binned[rows, f], w, size))[:-1] for w in (g[rows], h[rows], None))
            a = np.clip(-left_g / (left_h + PENALTY), low, high)
            b = np.clip(-(whole_g - left_g) / (whole_h - left_h + PENALTY), low, high)
            loss = lambda v, gg, hh: -(gg * v + 0.5 * (hh + PENALTY) * v * v)
            gain = loss(a, left_g, left_h) + loss(b, whole_g - left_g, whole_h - left_h) - loss(value, whole_g, whole_h)
            fair = (left_n >= LEAST_IN_LEAF) & (len(rows) - left_n >= LEAST_IN_LEAF) & ((b - a) * directions[f] >= 0)
            gain = np.where(fair, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        _, f, k, a, b = best
        if f < 0:
            total[rows] += value * RATE
            return me
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
        goes = binned[rows, f] <= k
        left = build(rows[goes], g, h, depth + 1, *bounds[0])
        right = build(rows[~goes], g, h, depth + 1, *bounds[1])
        nodes[me] = [f, float(edges[f][k]), left, right, 0.0]
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    c = list(zip(*nodes))
    return Trees(np.array(c[0]), np.array(c[1]), np.array(c[2]), np.array(c[3]), np.array(c[4]), np.array(roots), bias)


def fit(found: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id") -> Trees:
    """Trees for `labels.quality` over measured documents: ROWS labelled ids at most, by hash, none held out. Nulls are left out;
    of labels that contradict each other the lower one holds. Without labels of both kinds every document gets the same score."""
    named = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__quality"))
    ruled = named.filter(F.col("__id").isNotNull() & F.col("__quality").isin(0, 1) & ~common.held_out("__id")).groupBy("__id").agg(F.min("__quality").alias("__quality"))
    chosen = common.sample(ruled, ROWS, F.col("__id"))
    rows = sorted(tuple(r) for r in found.select(common.quoted(doc_id).cast("long").alias("__id"), *STATISTICS).join(chosen, "__id").collect())
    table = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS) + 2)
    return grow(features(list(table[:, 1:-1].T)), table[:, -1], list(FEATURES.values()))


def base_failed() -> "F.Column":
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(found: DataFrame, trees: Trees) -> DataFrame:
    """`score`, `base_failed` and `kept` beside the columns of measured documents: kept if the base rule holds and the trees' score reaches KEEP."""
    names = [c for c in found.columns if c not in ("score", "base_failed", "kept")]
    base = found.select(*[common.quoted(c) for c in names])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features([b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in STATISTICS])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(trees.score(x), pa.float64())], [*names, "score"])

    scored = base.mapInArrow(run, schema).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    found = settle(measured(docs, keep=["doc_id"]), "statistics")  # texts are read once
    kept = judged(found, fit(found, common.table(spark, folder, "labels")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
