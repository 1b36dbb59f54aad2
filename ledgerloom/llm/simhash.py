"""Near duplicates by SimHash, with pigeonring filtering of fingerprint pairs.

Cut two fingerprints that differ in at most t bits into m segments around a ring. Then there is a segment from which every
chain of l consecutive segments differs in at most l * t / m bits. With t = 2 and m = 3: one segment is equal, it and
the next differ in at most one bit, all three in at most two. So two segments, the second with at most one bit flipped,
serve as a join key of 42 bits: hardly any pair of strangers gets through to the full Hamming check.
A key that very many fingerprints share is not paired out: there the chain is carried on over the third segment, and
the few hundred fingerprints that it allows are looked up one by one. No pair is lost either way, and the work for a
fingerprint has a fixed bound.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import settle

from . import common
from .components import components

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 2, 3
#: A key with more fingerprints than this is looked up by full chains: about as many as those.
CROWD = 256
CHUNK = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str) -> int:
    """64 bits, signed: bit by bit the majority among the hashes of a text's shingles; a tie gives 0, no words give 0."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space as the contract has it
    if not words:
        return 0
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    joined = b" ".join(words)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(SHINGLE, len(words)) - 1 :]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(2048, np.int64), len(last)
    for k in range(0, n, CHUNK):
        part = last[k : k + CHUNK]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], part)), np.uint64, len(part))
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    ones = np.einsum("bv,vi->bi", counts.reshape(8, 256), _BITS).ravel()
    return int(_POWERS[2 * ones > n].sum().astype(np.int64))


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`fp` beside the columns of docs. Null texts count as empty; a column called fp gives way."""

    def make():
        return lambda texts: [[fingerprint(t) for t in texts]]

    return common.map_texts(docs, make, [T.StructField("fp", T.LongType())], text=text, keep=keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segments(m: int = SEGMENTS) -> list[list[int]]:
    """The bits of each segment; widths differ by one at most."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def flips(bits: list[int], most: int) -> list[int]:
    """All masks of at most so many of these bits."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)]


def chains(distance: int = DISTANCE, m: int = SEGMENTS) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """By start: its number, the mask of all segments but the last one of the ring, and the flips within budget of that
    chain, each with the flips that the budget leaves for the last segment."""
    found, parts = [], segments(m)
    for i in range(m):
        ring = parts[i:] + parts[:i]
        chain = [0]
        for l, bits in enumerate(ring[:-1], 1):
            chain = [c | f for c in chain for f in flips(bits, l * distance // m - c.bit_count())]
        key = sum(1 << b for s in ring[:-1] for b in s)
        found.append((i, key, [(c, flips(ring[-1], distance - c.bit_count())) for c in chain]))
    return found


def links(prints: DataFrame, *, distance: int = DISTANCE, m: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b): all pairs of fingerprints, given as one row (fp) each, that differ in at most `distance` bits.

    Each pair comes at least once. Nothing is capped: crowded keys are looked up by full chains instead of pairs.
    What is exploded is joined by merging: Spark knows none of the lengths, and would broadcast 69 rows a fingerprint as if they were one.
    """
    if m < 2 or m * (distance + 1) > 64:
        raise ValueError("a ring needs two segments at least, and each more bits than the distance")
    plan = chains(distance, m)
    long = lambda x: F.lit(_signed(x)).cast("long")
    entries = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(long(key)).alias("key")) for i, key, _ in plan])
    base = prints.select("fp", F.inline(entries))
    by_start = F.array(*[F.array(*[long(c) for c, _ in ways]) for _, _, ways in plan])
    masks = F.array(*[long(key) for _, key, _ in plan])
    tries = prints.select("fp", F.posexplode(by_start).alias("start", "ways")).select("fp", "start", F.posexplode("ways").alias("way", "flip"))
    probe = tries.select("fp", "start", "way", "flip", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.get(masks, F.col("start"))).alias("key"))
    crowded = settle(base.groupBy("start", "key").count().filter(F.col("count") > crowd).select("start", "key"), "crowded")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    few = base.join(crowded, ["start", "key"], "left_anti")
    cold = probe.alias("a").join(few.alias("b").hint("merge"), ["start", "key"]).filter((F.col("a.fp") != F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if crowded.isEmpty():
        return cold
    rest = F.array(*[F.array(*[F.array(*[long(f) for f in left]) for _, left in ways]) for _, _, ways in plan])
    looked = probe.join(crowded, ["start", "key"], "left_semi").select(F.col("fp").alias("own"), "flip", F.explode(F.get(F.get(rest, F.col("start")), F.col("way"))).alias("more"))
    wanted = looked.select("own", F.col("own").bitwiseXOR(F.col("flip")).bitwiseXOR(F.col("more")).alias("fp")).filter(F.col("fp") != F.col("own"))
    return cold.union(wanted.join(prints, "fp", "left_semi").select("own", "fp"))


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, class_fp) and the columns to carry: one row a document; component_id is the smallest id reached over links, itself included.
    class_fp is a fingerprint of the class, the same for all of it and for no other.

    Copies share a fingerprint and are one node; only fingerprints that differ are compared. Texts without words have
    fingerprint 0 and link like others. Rows without an id are no part of any class: their component_id is null.
    Of rows with the same id each has the class that its own fingerprint reaches.
    """
    ids = docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.quoted(text).alias("text"), *carry)
    marked = settle(fingerprints(ids, keep=["doc_id", *carry]), "fingerprints")
    prints = settle(marked.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints.select("fp"), distance=distance)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("class_fp"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), "class_fp", *carry)


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays: the one with the smallest id. Rows without an id all stay.

    A row goes by its id and text: two texts under one id that are copies of nothing both stay, and that another text under its id is a
    copy of something does not touch a row. Of several texts of a class under its smallest id the one whose hash is smallest stays, of rows
    that repeat an id and a text one. Columns keep whatever names they have.
    """
    packed = docs.select(F.struct(*[quoted_as(c) for c in docs.columns]).alias("doc"), common.quoted(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(common.quoted(text), F.lit(""))).alias("same"))
    marked = classes(docs.select(common.quoted(doc_id).alias("doc_id"), common.quoted(text).alias("text"), F.xxhash64(F.coalesce(common.quoted(text), F.lit(""))).alias("same")), carry=("same",))
    first = marked.filter(F.col("doc_id") == F.col("component_id")).groupBy("class_fp").agg(F.min("doc_id").alias("id"), F.min("same").alias("same"))
    # Dealt by id and text, as dropDuplicates needs it too.
    stay = packed.join(first.select("id", "same").distinct(), ["id", "same"], "left_semi").dropDuplicates(["id", "same"])
    return stay.select("doc").union(packed.filter(F.col("id").isNull()).select("doc")).select("doc.*")


def quoted_as(name: str) -> Column:
    return common.quoted(name).alias(name)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the component that links of two bits put it in."""
    found = classes(common.table(spark, folder, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
