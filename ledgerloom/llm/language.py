"""Language identification by language-bitmask n-gram filters.

Each slot of the filter holds a mask with one bit a language, so the Bloom filters of all languages lie side by side, cut
by bits: the slots of an n-gram's hashes, and-ed, give at once every language that contains it. A text gets a count of n-grams
by language, corrected for the share of a language's counts that a Bloom filter of its fill returns by chance.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The training sample: labelled rows of a language at most, whole texts.
ROWS = 800
SLOTS_LOG2, NGRAMS = 21, (3, 4)
#: An n-gram counts for a language if it has this share at least of the frequency that it has in the language using it most.
SHARE, LEAST = 0.1, 3
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")
_FACTORS = {3: (0x9E3779B1, 0x85EBCA77), 4: (0xC2B2AE3D, 0x27D4EB2F)}
STEP = 1 << 20


def letters(text: str) -> bytes:
    """Lower-case words between single spaces, nothing else; empty if no letter is left."""
    bare = _NO_LETTER.sub(" ", text.lower()).strip()
    return f" {bare} ".encode() if any(map(str.isalpha, bare)) else b""


def ngrams(data: bytes, n: int) -> np.ndarray:
    """All runs of n bytes, packed into integers."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(raw) < n:
        return np.zeros(0, np.uint32)
    packed = raw[: len(raw) - n + 1].copy()
    for k in range(1, n):
        packed |= raw[k : len(raw) - n + 1 + k] << np.uint32(8 * k)
    return packed


def slots(packed: np.ndarray, n: int) -> list[np.ndarray]:
    return [(packed * np.uint32(f)) >> np.uint32(32 - SLOTS_LOG2) for f in _FACTORS[n]]


@dataclass
class Filters:
    """`masks` by n-gram size and plane of up to 64 languages; `chance` by size and language: how often a stranger passes."""

    languages: list[str]
    masks: dict[int, list[np.ndarray]]
    chance: dict[int, np.ndarray]


def train(texts: list[str], languages: list[str]) -> Filters:
    names = sorted(set(languages))
    filters = Filters(names, {}, {})
    for n in NGRAMS:
        counts = []
        for name in names:
            seen = np.concatenate([ngrams(letters(t), n) for t, l in zip(texts, languages) if l == name] or [np.zeros(0, np.uint32)])
            counts.append(np.unique(seen, return_counts=True))
        every = np.unique(np.concatenate([g for g, _ in counts])) if counts else np.zeros(0, np.uint32)
        most = np.zeros(len(every))
        for grams, c in counts:
            at = np.searchsorted(every, grams)
            most[at] = np.maximum(most[at], c / max(1, c.sum()))
        width = next(w for w in (8, 16, 32, 64) if min(len(names), 64) <= w)
        planes = [np.zeros(1 << SLOTS_LOG2, f"u{width // 8}") for _ in range(math.ceil(len(names) / 64))]
        filters.chance[n] = np.zeros(len(names))
        for k, (grams, c) in enumerate(counts):
            own = (c >= LEAST) & (c / max(1, c.sum()) >= SHARE * most[np.searchsorted(every, grams)])
            bit, plane = planes[0].dtype.type(1 << (k % 64)), planes[k // 64]
            for s in slots(grams[own], n):
                plane[s] |= bit
            filters.chance[n][k] = ((plane & bit) != 0).mean() ** len(_FACTORS[n])
        filters.masks[n] = planes
    return filters


def counted(text: str, filters: Filters) -> np.ndarray:
    """By language: the n-grams of a text that its filter holds, less those expected by chance."""
    data, total = letters(text), np.zeros(len(filters.languages))
    for n in NGRAMS:
        hits, number = np.zeros(len(total)), max(0, len(data) - n + 1)
        for at in range(0, number, STEP):  # memory stays bounded for texts of any length
            first, second = slots(ngrams(data[at : at + STEP + n - 1], n), n)
            for p, plane in enumerate(filters.masks[n]):
                held = plane[first] & plane[second]
                values, times = (np.arange(256), np.bincount(held, minlength=256)) if held.dtype.itemsize == 1 else np.unique(held, return_counts=True)
                for k in range(64 * p, min(64 * p + 64, len(total))):
                    hits[k] += times[(values >> (k % 64)) & 1 == 1].sum() if held.dtype.itemsize < 8 else times[(values >> np.uint64(k % 64)) & np.uint64(1) == 1].sum()
        total += np.maximum(0, (hits - number * filters.chance[n]) / (1 - filters.chance[n] + 1e-12))
    return total


def predict(text: str, filters: Filters) -> tuple[str, float]:
    """The language with the highest corrected count, ties to the first in order, and its share of all counts."""
    if not filters.languages or not letters(text):
        return UNKNOWN, 0.0
    total = counted(text, filters)
    best = int(total.argmax())
    return filters.languages[best], float(total[best] / total.sum()) if total.sum() > 0 else 1 / len(total)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Learn from ROWS labelled texts of each language at most, by the hash of their ids, none of them held out."""
    known = docs.select(common.quoted(doc_id).cast("string").alias("i"), common.quoted(text).alias("t"), common.quoted(lang).cast("string").alias("l"), common.held_out(doc_id).alias("h"))
    usable = known.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.col("h"))
    have = {r[0]: r[1] for r in usable.groupBy("l").count().collect()}  # one row a language
    if not have:
        return train([], [])
    limits = docs.sparkSession.createDataFrame([(l, int(min(1.0, ROWS / n) * (1 << 30))) for l, n in have.items()], "l string, most long")
    chosen = usable.join(F.broadcast(limits), "l").filter(F.pmod(F.xxhash64(F.lit(9), "i"), F.lit(1 << 30)) < F.col("most"))
    rows = sorted(chosen.select("l", "t").collect())
    return train([r[1] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """`lang_pred` and `score` (0 to 1) beside the columns of docs, from whole texts alone.

    Null texts and texts without a letter are `und` with score 0; so is every text when nothing was learned.
    Columns that already have these names give way. The filters have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def make():
        one = shared.value

        def run(texts: list[str]) -> list[list]:
            found = [predict(t, one) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return run

    return common.map_texts(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text=text)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
