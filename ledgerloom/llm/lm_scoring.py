"""Language-model scoring by cross-entropy difference: a target and a background bigram model over one vocabulary; a document's
score is the mean over its words of the loss under the target model less that under the background model.

All words and pairs of the corpus are counted, each for itself: a word is known by 64 bits, a pair by the 128 bits of its two words.
So the counts grow with the corpus, and no process ever holds them all. A block of documents asks once for each of its words and pairs: they
are dealt out by word, so that one task sees all places where a word stands and hence its count and the counts of its pairs, and the counts
come back to the block, which sums up its own documents. So what moves grows with the words, and a document has one sum.
Frequent words and pairs are a short list of bounded size; they are counted exactly beforehand and scored where the text is read, so no
key is hot. The background's counts are scaled to the target's number of words: smoothing then acts alike on both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import settle

from . import common

#: Even mass: FLOOR / WORDS for any word, whatever the vocabulary. Pairs of a word count as much as its single words when it was seen so often.
FLOOR, WORDS, TRUST = 0.05, 1 << 18, 20.0
WORDS_KEPT = 250_000
#: Most words and pairs on the list of frequent ones, which is drawn up from about SAMPLE documents. It decides where work is done, not what comes out.
FREQUENT, SAMPLE = (1 << 16, 1 << 17), 8_000
#: Words that a task counts at a time; about as many go to a task that counts those dealt to it, and half as many are a block that asks.
HELD = 2_000_000
#: Stands before a frequent word that is listed by itself; no word has it.
START = np.uint64(0)
ROW = "__row"


class _Classes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        found += 2 * (found < 2)
        if len(word) <= 64:
            self[word] = found
        return found


def pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64 bits of a pair; they say where it is counted. Pairs are told apart by both words."""
    mixed = before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def classes(text: str, known: _Classes) -> np.ndarray:
    """The 64 bits of each word of a text, A-Z in lower case."""
    words = text.encode().lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys, -1 for those that are not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


class Frequent:
    """Frequent words and pairs of them, sorted, at most as many as FREQUENT says (and the words of these pairs)."""

    def __init__(self, words: np.ndarray, couples: np.ndarray):
        self.words = np.unique(np.concatenate((words, couples.ravel())))
        before, after = (_found(self.words, couples[:, k]) for k in (0, 1))
        self.couples = np.unique(before * len(self.words) + after)

    def find(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place among the words, and the place among the pairs of it and the word before; -1: not there. first: where texts begin."""
        word = _found(self.words, ids)
        before = np.concatenate(([-1], word[:-1])) if len(word) else word
        before[first] = -1
        couple = np.full(len(ids), -1, np.int64)
        both = np.flatnonzero((word >= 0) & (before >= 0))
        couple[both] = _found(self.couples, before[both] * len(self.words) + word[both])
        return word, couple


@dataclass
class _Texts:
    """Texts one behind the other: words, their texts' numbers, where texts begin and end (those without words left out)."""

    ids: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        ends = np.cumsum(self.sizes)
        self.of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.first, self.last = (ends - self.sizes)[self.sizes > 0], ends[self.sizes > 0] - 1


def _read(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[_Texts, list[np.ndarray]]]:
    """Texts of (text, others ...) rows with the other columns, about `held` words at a time."""
    known, parts, others, size = _Classes(), [], [], 0

    def out():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return _Texts(np.concatenate(parts), sizes), [np.array(x) for x in zip(*others)]

    for b in batches:
        for text, *other in zip(*[c.to_pylist() for c in b.columns]):
            parts.append(classes(text or "", known))
            others.append(other)
            size += len(parts[-1])
            if size >= held or len(parts) >= held:
                ready, parts, others, size = out(), [], [], 0
                yield ready
                del ready
    if parts:
        yield out()


@dataclass
class _Targets:
    """One bit a document: numbers of 64 documents and their bits."""

    keys: np.ndarray
    bits: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        at = _found(self.keys, rows >> 6)
        if not len(self.keys):
            return np.zeros(len(rows), bool)
        return (at >= 0) & ((self.bits[at] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Models:
    """What a corpus says of its words: exact totals and counts of frequent words and pairs; those of all others are worked out while scoring."""

    def __init__(self, docs: DataFrame, corpus: DataFrame, targets, frequent: Frequent, counted: np.ndarray):
        self.docs, self.corpus, self.targets, self.frequent, self.counted = docs, corpus, targets, frequent, counted
        self.total = counted[:, 0]
        self.scale = self.total[0] / self.total[1] if self.total[0] and self.total[1] else 1.0

    @cached_property
    def table(self) -> DataFrame:
        """(word, n_target, n_background), a row a word, for a look at the counts."""
        return settle(word_counts(self.corpus, self.targets), "word-counts")

    @property
    def words(self) -> tuple[_Looked, _Looked]:
        return _Looked(self, "n_target", 1.0), _Looked(self, "n_background", self.scale)


@dataclass
class _Looked:
    models: Models
    name: str
    factor: float

    def __getitem__(self, word: int) -> float:
        row = self.models.table.filter(F.col("word") == (word - (1 << 64) if word >> 63 else word)).first()
        return row[self.name] * self.factor if row else 0.0


class Scorer:
    """Parts of a loss difference, from counts of the target and of the background."""

    def __init__(self, models: Models):
        self.total, self.scale, self.frequent = models.total, models.scale, models.frequent
        n = len(self.frequent.words)
        #: The places of START, of END and of the first word that is not frequent.
        self.places = n, n + 1, n + 2
        words = models.counted[:, 1 : 1 + n]
        self.alone = self.chance(words)
        self.behind = self.seen(words)
        self.begins = self.start(self.alone)
        self.couples = self.pair(models.counted[:, 1 + n :], self.alone[:, self.frequent.couples % max(n, 1)])

    def chance(self, words: np.ndarray) -> np.ndarray:
        return (1 - FLOOR) * words / np.maximum(self.total, 1e-9)[:, None] + FLOOR / WORDS

    def seen(self, words: np.ndarray) -> np.ndarray:
        """What the word before adds to the difference."""
        return np.log(words[0] + TRUST) - np.log(words[1] * self.scale + TRUST)

    def pair(self, counts: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """What a word adds behind another one."""
        return np.log(counts[1] * self.scale + TRUST * alone[1]) - np.log(counts[0] + TRUST * alone[0])

    def start(self, alone: np.ndarray) -> np.ndarray:
        return np.log(alone[1]) - np.log(alone[0])


def word_counts(corpus: DataFrame, targets) -> DataFrame:
    """(word, n_target, n_background) of a corpus (text, row), a row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (rows,) in _read(batches, HELD):
            words, at = np.unique(texts.ids, return_inverse=True)
            target = targets.value.of(rows)[texts.of]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(at[target], minlength=len(words))), pa.array(np.bincount(at, minlength=len(words)))], ["word", "n_target", "n_background"])

    return corpus.mapInArrow(run, "word long, n_target long, n_background long").groupBy("word").agg(F.sum("n_target").alias("n_target"), F.sum("n_background").alias("n_background"))


def _frequent(corpus: DataFrame, most: tuple[int, int], rows: int) -> Frequent:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _read(batches, HELD):
            after = np.ones(len(texts.ids), bool)
            after[texts.first] = False
            at = np.flatnonzero(after)
            words, n = np.unique(texts.ids, return_counts=True)
            both, m = np.unique(np.stack((texts.ids[at - 1], texts.ids[at]), 1), axis=0, return_counts=True)
            often, many = n > 2, m > 2
            before = np.concatenate((np.full(often.sum(), START), both[many, 0]))
            columns = before.view(np.int64), np.concatenate((words[often], both[many, 1])).view(np.int64), np.concatenate((n[often], m[many]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["before", "after", "n"])

    if min(most) <= 0:
        return Frequent(np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    seen = common.sample(corpus, rows, F.col(ROW)).mapInArrow(run, "before long, after long, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))
    seen = settle(seen, "frequent")
    lists = []
    for alone, limit in ((True, most[0]), (False, most[1])):
        top = seen.filter((F.col("before") == 0) == F.lit(alone)).orderBy(F.desc("n"), "before", "after").limit(limit).toArrow()
        lists.append(np.stack([top.column(k).to_numpy().astype(np.int64).view(np.uint64) for k in (0, 1)], 1))
    return Frequent(lists[0][:, 1], lists[1])


def _counted(corpus: DataFrame, targets, frequent) -> np.ndarray:
    """(2, 1 + words + pairs) exact counts over all texts, target and background: all words, each frequent word, each frequent pair."""
    n, m = len(frequent.value.words), len(frequent.value.couples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + n + m), np.int64)
        for texts, (rows,) in _read(batches, HELD // 8):
            word, couple = frequent.value.find(texts.ids, texts.first)
            target = targets.value.of(rows)[texts.of]
            for k, which in ((0, target), (1, slice(None))):
                w, c = word[which], couple[which]
                held[k, 0] += len(w)
                held[k, 1 : 1 + n] += np.bincount(w[w >= 0], minlength=n)
                held[k, 1 + n :] += np.bincount(c[c >= 0], minlength=m)
        seen = np.flatnonzero(held[1])
        for at in range(0, len(seen), 50_000):
            part = seen[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[0, part]), pa.array(held[1, part])], ["at", "n_target", "n_background"])

    table = corpus.mapInArrow(run, "at long, n_target long, n_background long").groupBy("at").agg(F.sum("n_target"), F.sum("n_background")).toArrow()
    found = np.zeros((2, 1 + n + m))
    found[:, table.column(0).to_numpy()] = table.column(1).to_numpy(), table.column(2).to_numpy()
    return found


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number each, written once: a number that the scan makes up would change with its splits."""
    return settle(common.without(docs, [ROW]).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def fit(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", frequent: tuple[int, int] = FREQUENT) -> Models:
    """Models over all documents; target documents are those whose id is in targets (doc_id).

    The driver and the workers get the counts of frequent words and pairs and one bit for each document in 64 that have a target among them.
    """
    spark = docs.sparkSession
    numbered = _numbered(docs)
    wanted = targets.select(F.col("doc_id").cast("long").alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    rows = numbered.select(common.quoted(doc_id).cast("long").alias("__id"), ROW).join(wanted.hint("merge"), "__id", "left_semi")
    bits = rows.groupBy(F.shiftright(ROW, 6).alias("key")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({ROW} & 63 AS int))")).alias("bits")).orderBy("key").toArrow()
    chosen = spark.sparkContext.broadcast(_Targets(*[bits.column(k).to_numpy().astype(np.int64).view(kind) for k, kind in ((0, np.int64), (1, np.uint64))]))
    corpus = numbered.select(common.quoted(text).alias("text"), ROW)
    found = _frequent(corpus, frequent, SAMPLE)
    return Models(numbered, corpus, chosen, found, _counted(corpus, chosen, spark.sparkContext.broadcast(found)))


#: A packet: of one block of texts for one part. Words that are not frequent, pairs by their places, counts, how often scored texts hold each pair, and in which of the block's.
_ASKED = ["words", "befores", "afters", "n_target", "n_all", "times", "texts"]
#: The answer to it: counts over the whole corpus instead, of these words and of the pairs.
_TOLD = ["word_target", "word_all", "kinds", "afters", "n_target", "n_all", "times", "texts"]
#: Beside the packets of a block: its scored texts with their numbers of words and what was summed up where they were read.
_OWN = ["rows", "sizes", "sums"]


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all lowest bytes, then the next ones, as many as the largest needs."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)
    planes = planes[1:].reshape(planes[0], -1)
    numbers = np.zeros((planes.shape[1], 8), np.uint8)
    numbers[:, : len(planes)] = planes.T
    return numbers.view("<i8").ravel()


def _rows(packets: Iterator[dict], keys: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Packets as batches of some MB."""
    held, size = [], 0

    def out():
        arrays = [pa.array([x[k] for x in held], pa.int64()) for k in keys] + [pa.array([x.get(c) for x in held], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, [*keys, *columns])

    for x in packets:
        held.append(x)
        size += sum(len(x[c]) for c in columns if c in x)
        if size >= 1 << 22:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        columns = {name: b.column(name) for name in b.schema.names}
        for at in range(b.num_rows):
            yield {c: (x[at].as_buffer() if x.type == pa.binary() else x[at].as_py()) for c, x in columns.items() if x[at].is_valid}


def _unlisted(one: Scorer, t: _Texts, scored: np.ndarray) -> tuple[np.ndarray, ...]:
    """What frequent words and pairs add to each text; all other words with the places of themselves and of the word before, and their texts.

    A place is that among the frequent words, then the one before a text and the one behind it, then those among the other words, given last.
    """
    start, end, rest = one.places
    word, couple = one.frequent.find(t.ids, t.first)
    starts, lasts = np.zeros(len(t.ids), bool), np.zeros(len(t.ids), bool)
    starts[t.first], lasts[t.last] = True, True
    often, listed = word >= 0, couple >= 0
    value = np.zeros(len(t.ids))
    value[listed] += one.couples[couple[listed]]
    del couple
    value[often & ~lasts] += one.behind[word[often & ~lasts]]
    value[often & starts] += one.begins[word[often & starts]]
    sums = np.bincount(t.of, value, len(t.sizes))
    del value
    table, word[~often] = np.unique(t.ids[~often], return_inverse=True)
    word[~often] += rest
    # The last word is not the word before of any: what it would add as such is taken off, by a pair that counts nothing.
    go, ends = np.flatnonzero(~listed & ~(often & starts)), np.flatnonzero(lasts & ~often & scored[t.of])
    before = word[go - 1]
    before[starts[go]] = start
    return sums, np.concatenate((word[go], word[ends])), np.concatenate((before, np.full(len(ends), end))), np.concatenate((t.of[go], t.of[ends])), table


def _asked(texts: DataFrame, targets, scorer, parts: int, held: int) -> DataFrame:
    """(part, block, ...) of texts (text, row, counted, scored): what a block of texts holds of each part's words and pairs.

    Frequent pairs are scored here. A word that is not frequent goes by itself, with the pairs that it is in, a pair of frequent ones by the pair.
    Places of words that are not frequent are those among the words of the packet.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        one: Scorer = scorer.value
        _, end, rest = one.places
        for t, (rows, counted, scored) in _read(batches, held):
            sums, after, before, of, table = _unlisted(one, t, scored)
            whole = np.flatnonzero(scored)
            block = int(rows[whole[0]]) if len(whole) else -1
            if len(whole):
                yield {"part": block % parts, "block": block, "rows": rows[whole].tobytes(), "sizes": t.sizes[whole].tobytes(), "sums": sums[whole].tobytes()}
            del t
            if not len(after):
                continue
            spread = pairs(before, after)
            for side in (before, after):
                rare = side >= rest
                spread[rare] = pairs(np.zeros(rare.sum()), table[side[rare] - rest])
            part = (spread % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
            del spread
            key = after * (rest + len(table)) + before
            del before, after
            order = np.lexsort((key, part))
            key, of = key[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            kept = np.flatnonzero(new)
            part = part[order[kept]]
            after, before = np.divmod(key[kept], rest + len(table))
            del key, order, new
            n = [np.add.reduceat(x[of].astype(np.int64), kept) * (before != end) for x in (counted & targets.value.of(rows), counted)]
            times, of = np.add.reduceat(scored[of].astype(np.int64), kept), (np.cumsum(scored) - 1)[of[scored[of]]]
            upto = np.concatenate(([0], np.cumsum(times)))
            found, cuts = np.unique(part, return_index=True)
            for p, a, b in zip(found.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                mine = np.unique(np.concatenate([x[a:b][x[a:b] >= rest] for x in (before, after)]))
                places = [np.where(x[a:b] >= rest, rest + np.searchsorted(mine, x[a:b]), x[a:b]) for x in (before, after)]
                yield {
                    "part": p, "block": block, "words": table[mine - rest].tobytes(), "befores": _packed(places[0]), "afters": _packed(np.diff(places[1], prepend=0)),
                    "n_target": _packed(n[0][a:b]), "n_all": _packed(n[1][a:b]), "times": _packed(times[a:b]), "texts": _packed(of[upto[a] : upto[b]]),
                }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(blocks(batches), ["part", "block"], _ASKED + _OWN)

    return texts.mapInArrow(run, "part long, block long, " + ", ".join(f"{c} binary" for c in _ASKED + _OWN))


def _told(asked: DataFrame, scorer) -> DataFrame:
    """(block, ...): each packet with counts over all texts. All places of a word that is not frequent, or of a pair, are in one part."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        start, end, rest = scorer.value.places
        held = []
        for x in _packets(batches):
            if "rows" in x:
                yield {"block": x["block"]} | {c: x[c].to_pybytes() for c in _OWN}
            else:
                kept = {c: x[c].to_pybytes() for c in ("afters", "times", "texts")} if x["block"] >= 0 else {}
                words, before, after = np.frombuffer(x["words"], np.uint64).copy(), _unpacked(x["befores"]), np.cumsum(_unpacked(x["afters"]))
                held.append((x["block"], kept, words, before.astype(np.int32), after.astype(np.int32), *[_unpacked(x[c]).astype(np.int32) for c in ("n_target", "n_all")]))
        if not held:
            return
        blocks, kept, tables, *columns = zip(*held)
        ends, firsts = (np.cumsum([0, *map(len, x)]) for x in (columns[0], tables))
        before, after, *n = (np.concatenate(x) for x in columns)
        del held, columns
        words, at = np.unique(np.concatenate(tables), return_inverse=True)
        shift = np.repeat(firsts[:-1] - rest, np.diff(ends))
        before, after = before.astype(np.int64), after.astype(np.int64)
        for side in (before, after):
            rare = side >= rest
            side[rare] = rest + at[side[rare] + shift[rare]]
        del shift
        rare = after >= rest
        of_words = [np.bincount(after[rare] - rest, x[rare], len(words)).astype(np.int64) for x in n]
        kinds = (before == start) + 2 * (before == end)
        _, pair = np.unique(after * (rest + len(words)) + before, return_inverse=True)
        del before, after, rare
        of_pairs = [np.bincount(pair, x).astype(np.int64) for x in n]
        for k, block in enumerate(blocks):
            if block >= 0:
                mine, own = pair[ends[k] : ends[k + 1]], at[firsts[k] : firsts[k + 1]]
                counts = {"word_target": of_words[0][own], "word_all": of_words[1][own], "kinds": kinds[ends[k] : ends[k + 1]], "n_target": of_pairs[0][mine], "n_all": of_pairs[1][mine]}
                yield {"block": block} | kept[k] | {c: _packed(x) for c, x in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(answers(batches), ["block"], _TOLD + _OWN)

    return asked.mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in _TOLD + _OWN))


def _summed(told: DataFrame, scorer) -> DataFrame:
    """(row, n_words, total), one row a text: all packets of a block are in one task, and only its texts' sums are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Scorer = scorer.value
        _, _, rest = one.places
        owns, totals = {}, {}
        for x in _packets(batches):
            block = x["block"]
            if "rows" in x:
                owns[block] = [np.frombuffer(x[c].to_pybytes(), kind) for c, kind in zip(_OWN, (np.int64, np.int64, np.float64))]
                continue
            kinds, after, times = _unpacked(x["kinds"]), np.cumsum(_unpacked(x["afters"])), _unpacked(x["times"])
            words, couples = (np.stack([_unpacked(x[c]) for c in names]).astype(np.float64) for names in (("word_target", "word_all"), ("n_target", "n_all")))
            rare = after >= rest
            alone, behind = np.empty(couples.shape), np.zeros(len(after))
            # A frequent word's share as the word before was added where the text was read.
            alone[:, ~rare] = one.alone[:, after[~rare]]
            alone[:, rare], behind[rare] = one.chance(words)[:, after[rare] - rest], one.seen(words)[after[rare] - rest]
            value = np.where(kinds == 2, -behind, np.where(kinds == 1, one.start(alone), one.pair(couples, alone)) + behind)
            total, had = np.bincount(_unpacked(x["texts"]), np.repeat(value, times)), totals.get(block, np.zeros(0))
            more, less = (total, had) if len(total) > len(had) else (had, total)
            more[: len(less)] += less
            totals[block] = more
        for block, (rows, sizes, sums) in owns.items():
            added = totals.get(block, np.zeros(0))
            sums = sums + np.concatenate((added, np.zeros(len(sums) - len(added))))
            for k in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (rows, sizes, sums)], ["row", "n_words", "total"])

    return told.mapInArrow(run, "row long, n_words long, total double")


def score(docs: DataFrame, models: Models, *, text: str = "text", keep: list[str] | None = None, held: int = HELD) -> DataFrame:
    """`n_words` and `score` beside the columns of docs; below 0 the text is more like the target than like the corpus.

    Texts without words, empty and null ones have score 0. Without target texts both models are the same even one and all scores lean
    to the background. Columns of these names give way. `models.docs` is the corpus itself: its words are then dealt out once.
    """
    spark = docs.sparkSession
    if docs is models.docs:
        numbered, size = docs, models.total[1]
        texts = models.corpus.select("text", ROW, F.lit(True).alias("counted"), F.lit(True).alias("scored"))
    else:
        numbered = _numbered(docs)
        other = numbered.select(common.quoted(text).alias("text"), F.col(ROW))
        size = models.total[1] + (other.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 4
        texts = models.corpus.select("text", ROW, F.lit(True).alias("counted"), F.lit(False).alias("scored"))
        texts = texts.union(other.select("text", ROW, F.lit(False), F.lit(True)))
    scorer = spark.sparkContext.broadcast(Scorer(models))
    parts = max(1, int(-(-size // held)))
    asked = _asked(texts, models.targets, scorer, parts, -(-held // 2)).repartitionById(parts, F.col("part").cast("int"))
    told = _told(asked, scorer).repartition(parts, "block")
    sums = _summed(told, scorer).select(F.col("row").alias(ROW), F.col("n_words").alias("__n"), F.col("total").alias("__total"))
    names = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("n_words", "score", ROW)]
    joined = numbered.select(*[common.quoted(c) for c in names], ROW).join(sums, ROW, "left")
    n = F.coalesce("__n", F.lit(0).cast("long"))
    return joined.select(*[common.quoted(c) for c in names], n.alias("n_words"), F.when(n > 0, F.col("__total") / n).otherwise(F.lit(0.0)).alias("score"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every document by how much closer it is to texts labelled as good than to the whole corpus; held-out labels are not used."""
    docs = common.table(spark, folder, "documents")
    labels = common.table(spark, folder, "labels")
    models = fit(docs.select("doc_id", "text"), labels.filter((F.col("quality") == 1) & ~common.held_out()).select("doc_id"))
    return score(models.docs, models, keep=["doc_id"]).select("doc_id", common.held_out().alias("held_out"), "n_words", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES: dict[str, str] = {}
