r"""Ranked lexical search with per-term geometric blocking.

An index holds shards of documents. In a shard each term has a posting list, and a list is clustered by the similarity of its documents:
some of them are drawn as centres, the others go to the nearest one, and each cluster is a block. A block keeps the coordinatewise
maximum of its documents' vectors over the terms that are no rarer than its own, rounded up to steps of one byte, so the bound that it
gives to any question is exact: no document of the block scores above it. A document that holds several terms of a question is found in
the list of the rarest of them, which is why no more coordinates are needed. A block is passed over only if its bound lies below
the score that the worst of the best documents has by then; blocks come in the order of their bounds.

Questions are taken in blocks of a bounded number of terms, each against all documents; the index has the terms of one block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import settle

from . import common

#: Results for a question; documents that a block of a list has on average; lists shorter than this have no blocks and are read whole.
TOP, BLOCK, SHORT = 10, 32, 8
#: Pairs of question and term in a block of questions; cells (documents x terms) of a shard.
PAIRS, CELLS = 1 << 17, 1 << 21
#: Dimensions of the random projection that says which documents are alike, and shards that give the first bars.
DIMENSIONS, FIRST = 24, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes as terms have them: separators are spaces, A-Z are lowered, everything beyond ASCII stays.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // words
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Statistics:
    """Of a corpus and a block's terms: documents with a term, their terms with repeats, and by term, rarest first, its old number and weight."""

    documents: int
    words: int
    order: np.ndarray
    weights: np.ndarray

    @property
    def place(self) -> np.ndarray:
        """By old number: the place in the order, -1 for terms that no document holds."""
        found = np.full(len(self.weights), -1, np.int64)
        found[self.order] = np.arange(len(self.order))
        return found


class Shard:
    """Documents with their vectors, and a blocked list for each term."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, values: np.ndarray, width: int):
        self.ids, self.sizes, self.ranks, self.values, self.width = ids, sizes, ranks, values, width
        self.dense = np.zeros((len(ids), width), np.int32)
        self.dense[np.repeat(np.arange(len(ids)), sizes), ranks] = values

    def block(self, per_block: int = BLOCK, short: int = SHORT) -> Shard:
        """Cluster every list and sum its blocks up."""
        rows = np.repeat(np.arange(len(self.ids)), self.sizes)
        by_term = np.argsort(self.ranks, kind="stable")
        lists, cuts = rows[by_term], np.searchsorted(self.ranks[by_term], np.arange(self.width + 1))
        draw = np.random.default_rng(11)
        alike = self.dense.astype(np.float32) @ draw.standard_normal((self.width, DIMENSIONS), np.float32)
        alike /= np.maximum(np.linalg.norm(alike, axis=1, keepdims=True), 1e-9)
        self.steps = -(-self.dense.max(0, initial=0).astype(np.int64) // 255)
        members, starts, heads, summaries = [], [], [], []
        for t in np.flatnonzero(np.diff(cuts)).tolist():
            docs = lists[cuts[t] : cuts[t + 1]]
            if len(docs) < short:
                members.append(docs)
                heads.append((t, len(docs), 0))
                continue
            centres = draw.choice(docs, -(-len(docs) // per_block), replace=False)
            near = np.argmax(alike[docs] @ alike[centres].T, 1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            begin = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            most = np.maximum.reduceat(self.dense[docs, t:], begin)
            summaries.append(np.where(most > 0, -(-most // np.maximum(self.steps[t:], 1)), 0).astype(np.uint8).ravel())
            members.append(docs)
            starts.append(begin)
            heads.append((t, len(docs), len(begin)))
        none = np.zeros(0, np.int64)
        self.members, self.starts = np.concatenate(members or [none]), np.concatenate(starts or [none])
        self.heads, self.summary = np.array(heads, np.int64).reshape(-1, 3), np.concatenate(summaries or [np.zeros(0, np.uint8)])
        return self

    KINDS = {"ids": "<i8", "sizes": "<i4", "ranks": "<i4", "values": "<i4", "members": "<i4", "starts": "<i4", "heads": "<i4", "summary": "<u1", "steps": "<i4"}

    def pack(self) -> dict[str, bytes]:
        return {c: np.ascontiguousarray(getattr(self, c)).astype(kind).tobytes() for c, kind in self.KINDS.items()}

    @classmethod
    def unpack(cls, row: dict[str, bytes], width: int) -> Shard:
        x = {c: np.frombuffer(row[c], kind).astype(np.uint8 if kind == "<u1" else np.int64) for c, kind in cls.KINDS.items()}
        one = cls(x["ids"], x["sizes"], x["ranks"], x["values"], width)
        one.members, one.starts, one.heads, one.summary, one.steps = x["members"], x["starts"], x["heads"].reshape(-1, 3), x["summary"], x["steps"]
        return one.open()

    def open(self) -> Shard:
        """Lists and blocks by term."""
        self.lists, m, s, y = {}, 0, 0, 0
        for t, docs, blocks in self.heads.tolist():
            size = blocks * (self.width - t)
            self.lists[t] = (self.members[m : m + docs], np.append(self.starts[s : s + blocks], docs), self.summary[y : y + size].reshape(blocks, -1) if blocks else None)
            m, s, y = m + docs, s + blocks, y + size
        return self

    def search(self, asked: np.ndarray, weights: np.ndarray, top: int, bar: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """Documents (by place) and scores of the best for a question, given as places of terms in ascending order and their weights.

        All documents that score at least `bar` and are among the best `top` are found. Also: blocks read and blocks in all.
        """
        scores = np.full(len(self.ids), -1, np.int64)
        seen, best, least = [], np.zeros(0, np.int64), max(bar, 1)

        def read(docs: np.ndarray) -> None:
            nonlocal best, least
            docs = np.unique(docs[scores[docs] < 0])
            scores[docs] = self.dense[np.ix_(docs, asked)].astype(np.int64) @ weights
            seen.append(docs)
            best = np.sort(np.concatenate((best, scores[docs])))[-top:]
            if len(best) == top:
                least = max(least, int(best[0]))

        bounds, blocks, whole = [], [], []
        for k, t in enumerate(asked.tolist()):
            docs, starts, summary = self.lists.get(t, (None, None, None))
            if docs is None:
                continue
            if summary is None:
                whole.append(docs)
                continue
            bounds.append(summary[:, asked[k:] - t].astype(np.int64) @ (self.steps[asked[k:]] * weights[k:]))
            blocks += [docs[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        if whole:
            read(np.concatenate(whole))
        bound = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
        order, at = np.argsort(-bound, kind="stable"), 0
        while len(more := order[at : at + 8]) and len(more := more[bound[more] >= least]):
            read(np.concatenate([blocks[b] for b in more.tolist()]))
            at += len(more)
        found = np.concatenate(seen) if seen else np.zeros(0, np.int64)
        found = found[scores[found] >= least]
        first = found[np.lexsort((self.ids[found], -scores[found]))[:top]]
        return first, scores[first], (at, len(bound))


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf): terms of each text with repeats, and the numbers and occurrences of those that are asked for, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    fields = [T.StructField("n", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("tf", T.BinaryType())]

    def make():
        known = shared.value

        def run(texts: list[str]) -> list[list]:
            rows = []
            for text in texts:
                words = terms(text)
                held = sorted((known[t], k) for t, k in Counter(words).items() if t in known)
                both = np.array(held, "<i4").reshape(-1, 2)
                rows.append((len(words), both[:, 0].tobytes(), both[:, 1].tobytes()))
            return list(zip(*rows)) if rows else [[], [], []]

        return run

    return common.map_texts(docs, make, fields, keep=["doc_id"]).filter(F.col("n") > 0)


def statistics(rows: DataFrame, width: int) -> Statistics:
    """Over all rows of `counted`; the driver gets two numbers and one a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width + 2, np.int64)
        for batch in batches:
            held[width] += batch.num_rows
            held[width + 1] += int(np.asarray(batch.column(0)).sum())
            held[:width] += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), minlength=width)[:width]
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["at", "k"])

    sums = rows.select("n", "at").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()
    held = np.zeros(width + 2, np.int64)
    held[sums.column("at").to_numpy()] = sums.column("k").to_numpy()
    documents, words, df = int(held[width]), int(held[width + 1]), held[:width]
    order = np.lexsort((np.arange(width), df))
    weights = np.array([weight(documents, int(k)) for k in df], np.int64)
    return Statistics(documents, words, order[df[order] > 0], weights)


def index(rows: DataFrame, stats: Statistics) -> DataFrame:
    """Shards of the rows of `counted`, a row each, as they lie: nothing is shuffled. Rows without an id are in no shard."""
    shared = rows.sparkSession.sparkContext.broadcast(stats)
    most = max(16, CELLS // max(len(stats.order), 1))
    schema = "shard long, " + ", ".join(f"{c} binary" for c in Shard.KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = shared.value, []
        place = s.place

        def out() -> pa.RecordBatch:
            ids, n, at, tf = zip(*held)
            sizes = np.array([len(x) // 4 for x in at], np.int64)
            ranks, times = place[np.frombuffer(b"".join(at), "<i4")], np.frombuffer(b"".join(tf), "<i4").astype(np.int64)
            values = impacts(times, np.repeat(np.array(n, np.int64), sizes), s.documents, s.words)
            packed = Shard(np.array(ids, np.int64), sizes, ranks, values, len(s.order)).block().pack()
            return pa.RecordBatch.from_pylist([{"shard": int(ids[0]), **packed}], schema=pa.schema([("shard", pa.int64()), *[(c, pa.binary()) for c in packed]]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) >= most:
                    yield out()
                    held = []
        if held:
            yield out()

    wanted = rows.filter(F.col("doc_id").isNotNull() & (F.length("at") > 0)).select(F.col("doc_id").cast("long"), "n", "at", "tf")
    return wanted.mapInArrow(run, schema)


def found(shards: DataFrame, stats: Statistics, questions: list[np.ndarray], bars: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): of each shard the best documents for each question (places of terms, ascending) that reach its bar."""
    shared = shards.sparkSession.sparkContext.broadcast((questions, [stats.weights[stats.order[q]] for q in questions], bars, len(stats.order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, least, width = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                one, out = Shard.unpack(row, width), []
                for item, (q, w) in enumerate(zip(asked, weights)):
                    docs, scores, _ = one.search(q, w, top, int(least[item]))
                    out.append((np.full(len(docs), item, np.int32), one.ids[docs], scores))
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item int, doc_id long, score long")


def ranked(rows: DataFrame, by: str, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `top` documents with the highest scores above 0, ties by smaller id.

    Every row of docs with a term counts in the statistics; those without an id are never found, those that repeat an id are documents
    of their own. Items without an id take no part; rows with the same item id are one item with the terms of all. Null and empty
    texts have no terms. The first bars are the scores that about FIRST shards reach: what lies below them is not among the best.
    """
    spark = docs.sparkSession
    base = docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.quoted(text).alias("text"))

    def make():
        return lambda texts: [[sorted({t.decode() for t in terms(x)}) for x in texts]]

    wanted = items.filter(common.quoted(item_id).isNotNull()).select(common.quoted(item_id).alias("item_id"), common.quoted(text).alias("text"))
    asked = common.map_texts(wanted, make, [T.StructField("terms", T.ArrayType(T.StringType()))], keep=["item_id"])
    asked = settle(asked.select("item_id", F.explode("terms").alias("term")).distinct(), "asked")
    blocks = max(1, -(-asked.count() // pairs))
    results = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").toArrow()
        if not part.num_rows:
            continue
        vocabulary = sorted(set(part.column("term").to_pylist()))
        number = {t.encode(): i for i, t in enumerate(vocabulary)}
        ids = part.column("item_id").to_pylist()
        names = sorted(set(ids))
        rows = settle(counted(base, number), "counted-terms")
        stats = statistics(rows, len(vocabulary))
        shards = settle(index(rows, stats), "lexical-index")
        place, of = stats.place, {n: i for i, n in enumerate(names)}
        questions: list[list[int]] = [[] for _ in names]
        for i, t in zip(ids, part.column("term").to_pylist()):
            if (p := int(place[number[t.encode()]])) >= 0:
                questions[of[i]].append(p)
        arrays = [np.array(sorted(q), np.int64) for q in questions]
        bars, many = np.zeros(len(names), np.int64), shards.count()
        if many > FIRST:
            some = shards.filter(F.pmod(F.xxhash64("shard"), F.lit(max(1, many // FIRST))) == 0)
            for row in ranked(found(some, stats, arrays, bars, top), "item", top).filter(F.col("rank") == top).toLocalIterator():
                bars[row["item"]] = row["score"]
        best = ranked(found(shards, stats, arrays, bars, top), "item", top)
        labels = spark.createDataFrame([(i, n) for i, n in enumerate(names)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", asked.schema["item_id"].dataType)]))
        results.append(settle(best.join(labels, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not results:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.union, results)


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return search(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


ORACLE = rf"""
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
lengths AS (SELECT doc_id, 10 + (90 * n * docs) // words AS m FROM sizes, whole),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES: dict[str, str] = {"op11_lexical_search": ORACLE}
