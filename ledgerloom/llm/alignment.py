"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both token sequences of a text are arrays of byte ends. While both tokenizers cut alike, end i of the one equals end i + shift of the
other: stretches of doubled length are compared at the current shift, and a stretch that differs is halved down to the first end that
does. There the ends are walked one by one until both meet again; that irregular group sets the next shift. Every step of the walk is
one pair of tokens whose bytes overlap.

An id pair's count is the number of documents that hold it. Counts are a table; the pairs that most documents hold, a list of bounded
size, are looked up where the documents lie, all others by a join, so that no pair is a hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import settle

from . import common

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs on the list that goes to every worker, 24 bytes each. It decides where a pair is looked up, not what comes out.
FREQUENT = 1 << 16
#: Pairs that a task adds up before it hands them on.
HELD = 1 << 21
#: The shortest stretch that is compared as a whole.
STRIDE = 8
#: An id pair in one number: id of the one times SPAN and id of the other.
SPAN = 1 << 31


Runs = list[tuple[int, int, int]]


def walk(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Runs, list[tuple[int, int, int, int]], list[int], list[int]]:
    """Runs, groups and the positions of overlapping pairs within groups, of two strictly increasing arrays that end alike.

    A run (i, j, n) is n one-to-one groups from i and j on; a group (i, j, m, n) has m tokens of the one and n of the other.
    """
    a, b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    one, two = ends_a.tolist(), ends_b.tolist()
    runs, groups, left, right = [], [], [], []
    i = j = 0
    total, other = len(one), len(two)
    while i < total:
        begin, n = i, STRIDE
        while i + n <= total and j + n <= other and a[4 * i : 4 * (i + n)] == b[4 * j : 4 * (j + n)]:
            i, j, n = i + n, j + n, 2 * n
        while n > STRIDE:
            n //= 2
            if i + n <= total and j + n <= other and a[4 * i : 4 * (i + n)] == b[4 * j : 4 * (j + n)]:
                i, j = i + n, j + n
        while i < total and one[i] == two[j]:  # fewer than a stride
            i += 1
            j += 1
        if i > begin:
            runs.append((begin, j - (i - begin), i - begin))
        if i == total:
            break
        x, y, p, q = i, j, one[i], two[j]
        left.append(x)
        right.append(y)
        while p != q:
            if p < q:
                x += 1
                p = one[x]
            else:
                y += 1
                q = two[y]
            left.append(x)
            right.append(y)
        groups.append((i, j, x + 1 - i, y + 1 - j))
        i, j = x + 1, y + 1
    return runs, groups, left, right


def linked_places(runs: Runs, left: list[int], right: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all overlapping pairs: those of runs behind those of groups."""
    i, j, n = np.array(runs, np.int64).reshape(-1, 3).T
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate((np.array(left, np.int64), np.repeat(i, n) + step)), np.concatenate((np.array(right, np.int64), np.repeat(j, n) + step))


def spelt(runs: Runs, groups: list[tuple[int, int, int, int]], one: list[str], two: list[str]) -> str:
    """Groups as text, in order: ids of the one, a bar, ids of the other; semicolons between groups."""
    parts: list[str] = []
    at = 0
    for i, j, n in runs:
        while at < len(groups) and groups[at][0] < i:
            x, y, m, k = groups[at]
            parts.append(f"{','.join(one[x : x + m])}|{','.join(two[y : y + k])}")
            at += 1
        parts.extend(map("|".join, zip(one[i : i + n], two[j : j + n])))
    parts.extend(f"{','.join(one[x : x + m])}|{','.join(two[y : y + k])}" for x, y, m, k in groups[at:])
    return ";".join(parts)


class ByteLevel:
    """Byte-level BPE from a vocabulary file of the tokenizers library, run by tiktoken, which is several times as fast.

    Both give the same ids where ids follow the order of merges and the text is split by the common pattern; other files are refused.
    """

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        merged = [ranks["".join(m if isinstance(m, list) else m.split(" ")).translate({ord(c): b for c, b in byte.items()}).encode("latin-1")] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of this vocabulary do not follow its merges")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.inner = tiktoken.Encoding("left", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.inner.encode_ordinary(" " + text)


class Pieces:
    """Pieces of the sentencepiece library, which puts the space before the text itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.inner = SentencePieceProcessor(model_proto=data)
        n = self.inner.get_piece_size()
        names = [self.inner.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(s[3:5], 16)]) if self.inner.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]

    def ids(self, text: str) -> list[int]:
        return self.inner.encode(text, num_threads=1)


class Aligner:
    def __init__(self, left: bytes, right: bytes):
        self.key = (left, right)
        self.a, self.b = ByteLevel(left), Pieces(right)
        self.sizes = [np.fromiter(map(len, t.tokens), np.int64, len(t.tokens)) for t in (self.a, self.b)]
        self.names = [list(map(str, range(len(t.tokens)))) for t in (self.a, self.b)]

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups, different id pairs and how often each is linked; zeros if a tokenizer does not give back the text's bytes."""
        none, whole = np.zeros(0, np.int64), (" " + text).encode()
        a, b = (self.a.ids(text), self.b.ids(text)) if text else ([], [])
        # The one's tokens are cut out of the text's bytes; the other's may stand for others.
        if not text or b"".join(map(self.b.tokens.__getitem__, b)) != whole:
            return 0, 0, 0, 0, "", none, none
        one, two = np.array(a, np.int64), np.array(b, np.int64)
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (one, two))]
        if ends[0][-1] != len(whole):
            return 0, 0, 0, 0, "", none, none
        runs, groups, left, right = walk(*ends)
        x, y = linked_places(runs, left, right)
        codes, times = np.unique(one[x] * SPAN + two[y], return_counts=True)
        text = spelt(runs, groups, *[list(map(n.__getitem__, ids)) for n, ids in zip(self.names, (a, b))])
        return len(a), len(b), len(groups) + sum(n for _, _, n in runs), len(x), text, codes, times


_KEPT: list[Aligner] = []


def aligner(left: bytes, right: bytes) -> Aligner:
    if not _KEPT or _KEPT[0].key != (left, right):
        _KEPT[:] = [Aligner(left, right)]
    return _KEPT[0]


def read(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.BinaryType()),
    T.StructField("times", T.BinaryType()),
]


def aligned(docs: DataFrame, left: bytes, right: bytes, *, text: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Beside the columns kept: n_a, n_b (tokens), n_groups, n_links, groups (text, or its SHA-256 with digest) and the text's different
    id pairs, packed (`pairs`, and `times`: how often each is linked).

    Null and empty texts, and those whose bytes a tokenizer does not give back, have no tokens: zeros, empty strings. Columns of
    these names give way. Nothing is shuffled; the two tokenizer files, of a fixed size, go to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast((left, right))

    def make():
        one = aligner(*shared.value)

        def run(texts: list[str]) -> list[list]:
            rows = []
            for t in texts:
                *counts, groups, codes, times = one.align(t)
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                rows.append((*counts, groups, codes.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
            return list(zip(*rows)) if rows else [[] for _ in FIELDS]

        return run

    return common.map_texts(docs, make, FIELDS, text=text, keep=keep)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, n, best): in how many rows each id pair is linked, and whether that is the most of all pairs of its left id.

    Tasks add up what they hold before they hand it on; there are at most as many pairs as ids times ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(np.frombuffer(packed, "<i8"))
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    counts = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = settle(counts.withColumn("a", F.shiftright("pair", 31)), "pair-counts")
    return settle(counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


def linked(docs: DataFrame, left: bytes, right: bytes, *, text: str = "text", keep: list[str] | None = None, digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """The columns of `aligned` without the packed ones, and n_best (links whose pair no other pair of the same left id exceeds in
    documents) and count_sum (over all links).

    Repeated rows each count as a document. The list of frequent pairs has at most `frequent` of them.
    """
    spark = docs.sparkSession
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in {"n_best", "count_sum", "__row"}]
    rows = aligned(docs, left, right, text=text, keep=names, digest=digest)
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            out = []
            for packed, many in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                codes, times = np.frombuffer(packed, "<i8"), np.frombuffer(many, "<i4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                at, here = at[hit], times[hit]
                out.append((int(here[best[at]].sum()), int((here * n[at]).sum()), codes[~hit].tolist(), times[~hit].tolist()))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["__row", "best", "total", "codes", "many"])

    near = rows.select("__row", "pairs", "times").mapInArrow(run, "__row long, best long, total long, codes array<long>, many array<long>")
    near = settle(near, "pairs-found")
    rest = near.select("__row", F.explode(F.arrays_zip("codes", "many")).alias("p")).select("__row", F.col("p.codes").alias("pair"), F.col("p.many").alias("times"))
    looked = rest.join(counts, "pair").select("__row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"), (F.col("times") * F.col("n")).alias("total"))
    sums = near.select("__row", "best", "total").union(looked).groupBy("__row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return rows.join(sums, "__row").select(*[common.quoted(c) for c in names], "n_best", "count_sum")


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by both tokenizers, cut into groups, with its links weighed by corpus-wide counts."""
    found = linked(common.table(spark, folder, "documents"), read(LEFT), read(RIGHT), keep=["doc_id"], digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_alignment": op12_alignment}
ORACLES: dict[str, str] = {}
