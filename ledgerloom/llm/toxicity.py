"""Toxicity by subword bags: words are the mean of the vectors of their character n-grams, windows of words the mean of their
words, and a linear softmax tells the two classes apart. Vectors and softmax are trained jointly in numpy. A misspelt word
shares most n-grams with the word it stands for and so inherits its score.

A document is as toxic as its worst window, since a few words among thousands would vanish in a mean over all. Training
follows that: each round the worst window of each document, as the model then sees it, carries the document's label.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the training sample: labelled rows of each class at most, whole texts.
ROWS = {1: 2000, 0: 4000}
BUCKETS, DIMENSIONS, WINDOW = 1 << 17, 8, 2
#: Sizes of n-grams anywhere in a word, and of those at its start, where a stem shows before its many endings.
SIZES, STEMS = (3, 4, 5), (6, 7, 8, 9)
FIRST, ROUNDS, RATE = 10, 60, 0.1
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}|…«»“”‘’-*#$%&<>"
WORDS_KEPT = 250_000


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bag(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, its ends marked; signs around it are left off."""
    bare = word.strip(EDGES) or word
    marked = f"<{bare[:200]}>"
    raw = [marked, *(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)), *(marked[:n] for n in STEMS if n < len(marked))]
    if len(bare) > 200:  # a word without end counts by its parts as well
        raw += [bare[i : i + 4] for i in range(200, len(bare) - 3)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in raw]


@dataclass
class Model:
    """What scoring needs of the trained vectors and softmax: the log-odds that each bucket adds, and the bias."""

    weight: np.ndarray
    bias: float


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.weight = model.weight.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        parts, weight = bag(word), self.weight
        score = sum([weight[b] for b in parts]) / len(parts)
        if len(word) <= 64:
            self[word] = score
        return score


def _windows(scores: np.ndarray) -> np.ndarray:
    """Means over each run of WINDOW words; one over all words of shorter texts."""
    if len(scores) <= WINDOW:
        return scores.mean(keepdims=True)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


def scorer(model: Model):
    known = _Scores(model)

    def score(text: str) -> float:
        words = words_of(text)
        worst = _windows(np.fromiter(map(known.__getitem__, words), np.float64, len(words))).max() if words else 0.0
        return float(1 / (1 + np.exp(-np.clip(worst + model.bias, -30, 30))))

    return score


def train(texts: list[str], labels: list[int], share: float | None = None, rounds: int = ROUNDS) -> Model:
    """Vectors and softmax by Adam on the worst windows; share is how common label 1 is outside the sample. One class only: a constant."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if labels and labels[0] else -4.0)
    known: dict[str, int] = {}
    docs = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int32) for t in texts]
    del texts
    parts, lengths = array("i"), array("i")  # compact: the driver holds some million n-grams
    for word in known:
        one = bag(word)
        parts.extend(one)
        lengths.append(len(one))
    known.clear()
    sizes, flat = np.array(lengths, np.int64), np.frombuffer(parts, np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("v", vectors), ("s", softmax), ("b", bias))}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)

    def step(name: str, value: np.ndarray, gradient: np.ndarray, t: int) -> None:
        m, v = state[name]
        m += 0.1 * (gradient - m)
        v += 0.02 * (gradient * gradient - v)
        value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-7)

    for t in range(1, rounds + 1):
        weight = vectors @ (softmax[:, 1] - softmax[:, 0])
        scores = np.add.reduceat(weight[flat], starts) / sizes
        picked, owner = [], []
        for d, ids in enumerate(docs):
            if not len(ids):
                continue
            if t <= FIRST:  # nothing is known yet about which window is the worst
                window = rng.choice(ids, min(len(ids), 12), replace=False)
            else:
                at = int(_windows(scores[ids]).argmax())
                window = ids[at : at + WINDOW]
            picked.append(window)
            owner.append(np.full(len(window), d, np.int32))
        word, doc = np.concatenate(picked), np.concatenate(owner)
        length = np.maximum(np.bincount(doc, minlength=len(docs)), 1)
        part = 1 / (length[doc] * sizes[word])
        counts = sizes[word]
        offsets = np.repeat(starts[word] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        buckets, rows, share_of = flat[offsets], np.repeat(doc, counts), np.repeat(part, counts).astype(np.float32)
        means = np.stack([np.bincount(rows, share_of * vectors[buckets, k], len(docs)) for k in range(DIMENSIONS)], 1).astype(np.float32)
        logits = means @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = p.copy()
        error[:, 1] -= y
        error[:, 0] -= 1 - y
        error *= balance[:, None] / len(docs)
        back = error @ softmax.T
        spread = np.stack([np.bincount(buckets, share_of * back[rows, k], BUCKETS) for k in range(DIMENSIONS)], 1).astype(np.float32)
        step("s", softmax, means.T @ error, t)
        step("b", bias, error.sum(0), t)
        step("v", vectors, spread, t)
    prior = np.log(share / (1 - share)) if share and 0 < share < 1 else 0.0  # the balanced loss stands for even odds
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]) + 0.5 * prior)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn `labels.toxic` from a bounded sample of rows that are not held out: ROWS of each class, by the hash of their ids.

    Nulls in labels are left out; of labels that contradict each other the toxic one holds. The sampled ids, bounded by
    ROWS, are sent to the documents; texts are never shuffled.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    ruled = named.filter(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & ~common.held_out("__id")).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    have = {r[0]: r[1] for r in ruled.groupBy("__toxic").count().collect()}
    rate = {k: min(1.0, ROWS[k] / n) for k, n in have.items()}
    limit = F.when(F.col("__toxic") == 1, F.lit(int(rate.get(1, 0) * (1 << 30)))).otherwise(F.lit(int(rate.get(0, 0) * (1 << 30))))
    chosen = ruled.filter(F.pmod(F.xxhash64(F.lit(7), "__id"), F.lit(1 << 30)) < limit)
    both = docs.select(common.quoted(doc_id).cast("long").alias("__id"), common.quoted(text).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = both.select("__id", "__toxic", F.coalesce("__text", F.lit("")).alias("__text")).toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])
    total = sum(have.values())
    return train(rows.column("__text").to_pylist(), rows.column("__toxic").to_pylist(), have.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """A column from 0 to 1 beside those of docs: how likely label 1 is for the whole text; null and empty texts get the bias alone.

    Only the text is looked at. A column that already has the name gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = scorer(shared.value)
        return lambda texts: [[one(t) for t in texts]]

    return common.map_texts(docs, make, [T.StructField(name, T.DoubleType())], text=text)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, common.table(spark, folder, "labels")))
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
