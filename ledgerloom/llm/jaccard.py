"""Join of word n-gram sets by Jaccard similarity, with signature trees.

Equal sets are one node. Nodes of about one size that share a hash live in a tree, split by hash beyond TREE of them. A tree's levels hold
OR-combined bitmaps of hashes and size ranges. Two trees are traversed together, level by level, and a pair of tree nodes is followed
only while the overlap that bitmaps and sizes still allow could reach the threshold. Bitmaps go first, they are a small part of the sets;
only sets that are left at the leaves move, and are compared themselves. Trees that lie within one component already do not meet again:
only connections are asked for.

Which trees meet: sets similar enough share a hash among the first few in any one order of hashes. Frequent hashes, a list of bounded
size, come last in that order, so that a passage which many documents share brings no strangers together. At the first hash that two sets
have in common, what either has from there on must still hold the overlap; a hash at which places and sizes rule that out brings no trees together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import settle

from . import common
from .components import components

WORDS, PERCENT = 4, 85
#: Nodes of a tree, children of a tree node, and bits of the widest bitmap as a power of two.
TREE, FAN, WIDEST = 256, 8, 14
#: Most hashes on the list of frequent ones, which is drawn up from one in SHARE documents. It decides where sets meet, not what comes out.
FREQUENT, SHARE = 1 << 17, 6
WORDS_KEPT = 250_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    """64 bits of each word seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str, known: _Hashes, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes: runs of so many words, or the whole sequence if there are fewer."""
    parts = text.encode().lower().split()  # bytes: A-Z only, and white space as the contract has it
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(each))
    h = np.full(len(each) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mixed(h * _M3 + each[k : len(each) - width + 1 + k])
    return np.unique(h)


def set_hash(hashes: np.ndarray) -> int:
    """64 bits of a set, signed."""
    found = xxhash.xxh64_intdigest(hashes.tobytes())
    return found - (1 << 64) if found >> 63 else found


def least(size: int | np.ndarray, percent: int = PERCENT):
    """The smallest overlap that two sets with so many elements together need."""
    return -(-size * percent // (100 + percent))


def first_hashes(hashes: np.ndarray, listed: np.ndarray, seen: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """So many of a set's hashes in the common order that any set similar enough has one of them among its own first ones.

    The order: hashes that are not listed by value, then listed ones by how often they were seen.
    """
    n = len(hashes)
    many = n - -(-n * percent // 100) + 1
    if not len(listed):
        return hashes[:many]
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    hit = listed[at] == hashes
    rare = hashes[~hit]
    if len(rare) >= many:
        return rare[:many]
    often, times = hashes[hit], seen[at[hit]]
    return np.concatenate((rare, often[np.lexsort((often, times))]))[:many]


def bitmap(hashes: np.ndarray, power: int) -> np.ndarray:
    """2 ** power bits: those at the leading bits of the hashes."""
    bits, at = np.zeros(max(1, (1 << power) >> 6), np.uint64), hashes >> np.uint64(64 - power)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def power_for(size: int) -> int:
    """Twice as many bits as hashes, up to the widest bitmap."""
    return min(WIDEST, max(6, int(2 * size - 1).bit_length()))


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def levels_of(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """(bitmaps, smallest size, largest size, most hashes without a bit of their own) by level; the sets first, one root last."""
    found = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1).astype(np.int64))]
    while len(found[-1][0]) > 1:
        bits, low, high, spare = found[-1]
        cuts = np.arange(0, len(bits), FAN)
        found.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))
    return found


class Signatures:
    """A tree without its sets: bitmaps and sizes of its nodes, like bitmaps side by side."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.lexsort((keys, sizes, bits[:, 0]))
        self.keys, self.sizes, self.bits = keys[order], sizes[order], bits[order]
        self.power = (bits.shape[1] << 6).bit_length() - 1
        self._levels: dict[int, list[Level]] = {}

    def pack(self) -> bytes:
        head = np.concatenate(([len(self.keys)], self.keys, self.sizes)).astype(np.int64).view(np.uint64)
        return zstandard.compress(np.concatenate((head, self.bits.ravel())).astype("<u8").tobytes(), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Signatures:
        whole = np.frombuffer(zstandard.decompress(packed), "<u8").astype(np.uint64)
        n = int(whole[0])
        return cls(whole[1 : 1 + n].view(np.int64), whole[1 + n : 1 + 2 * n].astype(np.int64), whole[1 + 2 * n :].reshape(n, -1))

    def levels(self, power: int) -> list[Level]:
        if power not in self._levels:
            bits = self.bits if power == self.power else np.stack([_folded(x, power) for x in self.bits])
            self._levels[power] = levels_of(bits, self.sizes)
        return self._levels[power]


class Tree:
    """Sets in an order that puts like ones side by side, under levels of tree nodes with FAN children each."""

    def __init__(self, keys: np.ndarray, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][1]) if len(sets[i]) > 1 else 0, len(sets[i]), int(keys[i])))
        self.keys, self.sets = keys[order], [sets[i] for i in order]
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.power = power_for(int(self.sizes.max()))
        self._levels: dict[int, list[Level]] = {}

    def pack(self) -> bytes:
        head = np.concatenate(([len(self.sets)], self.keys, self.sizes)).astype(np.int64).view(np.uint64)
        return zstandard.compress(np.concatenate((head, *self.sets)).astype("<u8").tobytes(), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Tree:
        whole = np.frombuffer(zstandard.decompress(packed), "<u8").astype(np.uint64)
        n = int(whole[0])
        sizes = whole[1 + n : 1 + 2 * n].astype(np.int64)
        return cls(whole[1 : 1 + n].view(np.int64), np.split(whole[1 + 2 * n :], np.cumsum(sizes)[:-1]))

    def levels(self, power: int) -> list[Level]:
        if power not in self._levels:
            self._levels[power] = levels_of(np.stack([bitmap(x, power) for x in self.sets]), self.sizes)
        return self._levels[power]


def may_reach(one: tuple, two: tuple, percent: int = PERCENT) -> np.ndarray:
    """For pairs of tree nodes (bitmaps, low, high, spare), one row a pair: whether two sets under them could be similar enough.

    A set's hashes in common with another are at most the bits in common and the hashes that have no bit of their own.
    """
    shared = np.bitwise_count(one[0] & two[0]).sum(-1).astype(np.int64) + np.minimum(one[3], two[3])
    most = np.minimum(shared, np.minimum(one[2], two[2]))
    sized = (100 * one[2] >= percent * two[1]) & (100 * two[2] >= percent * one[1])
    return sized & (most >= least(one[1] + two[1], percent))


class _Joined:
    """Which of some places are connected already."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _children(pairs: np.ndarray, sizes: tuple[int, int], same: bool) -> np.ndarray:
    """All pairs of children of pairs of tree nodes; within one tree each pair once."""
    steps = np.arange(FAN)
    left = (pairs[:, 0, None, None] * FAN + steps[:, None]) + np.zeros((1, 1, FAN), np.int64)
    right = (pairs[:, 1, None, None] * FAN + steps[None, :]) + np.zeros((1, FAN, 1), np.int64)
    found = np.stack((left.ravel(), right.ravel()), 1)
    inside = (found[:, 0] < sizes[0]) & (found[:, 1] < sizes[1])
    return found[inside & (found[:, 0] <= found[:, 1])] if same else found[inside]


def survivors(one: Signatures | Tree, two: Signatures | Tree, percent: int = PERCENT) -> tuple[np.ndarray, list[Level], list[Level]]:
    """Pairs of places of two trees, or of one given twice, that bitmaps and sizes leave at every level; and the levels compared."""
    same = one is two
    power = min(one.power, two.power)
    a, b = one.levels(power), two.levels(power)
    depth = max(len(a), len(b))
    a, b = a + [a[-1]] * (depth - len(a)), b + [b[-1]] * (depth - len(b))
    grown = [(len(a[k][0]) < len(a[k - 1][0]), len(b[k][0]) < len(b[k - 1][0])) for k in range(1, depth)]
    pairs = np.zeros((1, 2), np.int64)
    for k in range(depth - 1, -1, -1):
        if k < depth - 1:
            down = grown[k]
            if all(down):
                pairs = _children(pairs, (len(a[k][0]), len(b[k][0])), same)
            elif any(down):  # the lower tree waits at its root
                side = down.index(True)
                wide = (pairs[:, side, None] * FAN + np.arange(FAN)).ravel()
                other = np.repeat(pairs[:, 1 - side], FAN)
                pairs = np.stack((wide, other) if side == 0 else (other, wide), 1)
                pairs = pairs[pairs[:, side] < len((a, b)[side][k][0])]
        if same and k == 0:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        kept = []
        for at in range(0, len(pairs), 1 << 12):
            part = pairs[at : at + (1 << 12)]
            good = may_reach(tuple(x[part[:, 0]] for x in a[k]), tuple(x[part[:, 1]] for x in b[k]), percent)
            kept.append(part[good])
        pairs = np.concatenate(kept) if kept else pairs
        if not len(pairs):
            break
    return pairs, a, b


def traverse(one: Tree, two: Tree, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (key, key) between sets of two trees, or within one tree given twice: as many as connect what all links connect."""
    same = one is two
    pairs, a, b = survivors(one, two, percent)
    if not len(pairs):
        return []
    shared = np.bitwise_count(a[0][0][pairs[:, 0]] & b[0][0][pairs[:, 1]]).sum(1)
    order = np.argsort(-shared.astype(np.int64), kind="stable")  # likely links first, so that most others connect nothing new
    joined, links = _Joined(len(one.sets) + (0 if same else len(two.sets))), []
    away = 0 if same else len(one.sets)
    for i, j in pairs[order].tolist():
        x, y = joined.root(i), joined.root(away + j)
        if x == y:
            continue
        s, t = one.sets[i], two.sets[j]
        if one.keys[i] == two.keys[j]:
            continue
        overlap = len(np.intersect1d(s, t, assume_unique=True))
        if overlap >= least(len(s) + len(t), percent):
            joined.join(x, y)
            links.append((int(one.keys[i]), int(two.keys[j])))
    return links


MARKS = [
    *[T.StructField(c, T.LongType()) for c in ("__n", "__node")],
    T.StructField("__first", T.ArrayType(T.LongType())),
    T.StructField("__power", T.IntegerType()),
    T.StructField("__bits", T.BinaryType()),
]


def _listed(texts: DataFrame, words: int, share: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that a sample of the texts holds three times or more, sorted, and how often."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if most <= 0:
        return none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Hashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text or "", known, words))
                size += len(held[-1])
                if size > 1 << 21:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    drawn = texts.filter(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(share)) == 0)
    seen = drawn.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > 2)
    top = seen.orderBy(F.desc("n"), "h").limit(most).toArrow()
    if not top.num_rows:
        return none
    hashes, times = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def marks(docs: DataFrame, shared, words: int, percent: int) -> DataFrame:
    """Beside (doc_id): size of the set, its hash, its first hashes in the common order, and its bitmap."""

    def make():
        known = _Hashes()

        def run(texts: list[str]) -> list[list]:
            rows = []
            for t in texts:
                s = shingles(t, known, words)
                if len(s):
                    power = power_for(len(s))
                    rows.append((len(s), set_hash(s), first_hashes(s, *shared.value, percent).view(np.int64), power, bitmap(s, power).astype("<u8").tobytes()))
                else:
                    rows.append((0, 0, [], 0, b""))
            return list(zip(*rows)) if rows else [[] for _ in MARKS]

        return run

    return common.map_texts(docs, make, MARKS, keep=["doc_id"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of a stream sorted by tree, those of one tree together."""
    for _, group in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["tree"]):
        yield list(group)


def signatures(placed: DataFrame) -> DataFrame:
    """(tree, k, power, bits, low, high, spare, sign) of placed (tree, node, n, power, bits): roots, and trees without their sets."""
    kinds = pa.schema([("tree", pa.int64()), ("k", pa.int64()), ("power", pa.int32()), ("bits", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("spare", pa.int64()), ("sign", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in _runs(batches):
            each = {r["node"]: r for r in rows}
            bits = np.stack([np.frombuffer(r["bits"], "<u8").astype(np.uint64) for r in each.values()])
            one = Signatures(np.array(list(each), np.int64), np.array([r["n"] for r in each.values()], np.int64), bits)
            root, low, high, spare = one.levels(one.power)[-1]
            out.append({"tree": rows[0]["tree"], "k": len(each), "power": one.power, "bits": root[0].astype("<u8").tobytes(), "low": int(low[0]), "high": int(high[0]), "spare": int(spare[0]), "sign": one.pack()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    rows = placed.select("tree", "node", "n", "power", "bits").repartition("tree").sortWithinPartitions("tree")
    return rows.mapInArrow(run, "tree long, k long, power int, bits binary, low long, high long, spare long, sign binary")


def alike(pairs: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(t1, t2, nodes): those of the pairs whose signatures leave some sets that could be similar, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, one = None, None
        for batch in batches:
            out = []
            for t1, t2, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if x != packed:
                    packed, one = x, Signatures.unpack(x)
                two = one if t1 == t2 else Signatures.unpack(y)
                found = survivors(one, two, percent)[0]
                if len(found):
                    out.append((t1, t2, np.unique(np.concatenate((one.keys[found[:, 0]], two.keys[found[:, 1]])))))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["t1", "t2", "nodes"])

    signs = roots.select("tree", "sign")
    both = pairs.join(signs.toDF("t2", "y"), "t2").join(signs.toDF("t1", "x"), "t1")
    return settle(both.select("t1", "t2", "x", "y").mapInArrow(run, "t1 long, t2 long, nodes array<long>"), "alike-trees")


def root_pairs(pairs: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The pairs (t1, t2) whose roots could have similar sets under them, the larger tree first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for r in batch.to_pylist():
                power = min(r["p1"], r["p2"])
                # A folded bitmap leaves more hashes without a bit of their own, but the bound takes the smaller of both trees' numbers.
                one, two = [(_folded(np.frombuffer(r[f"b{k}"], "<u8"), power), *(np.int64(x) for x in (r[f"l{k}"], r[f"h{k}"], r[f"s{k}"] + (r[f"h{k}"] if r[f"p{k}"] > power else 0)))) for k in (1, 2)]
                good.append(bool(may_reach(one, two, percent)))
            yield batch.select(["t1", "t2"]).filter(pa.array(good, pa.bool_()))

    def root(k: int) -> list[Column]:
        return [F.col("tree").alias(f"t{k}"), F.col("power").alias(f"p{k}"), F.col("bits").alias(f"b{k}"), F.col("low").alias(f"l{k}"), F.col("high").alias(f"h{k}"), F.col("spare").alias(f"s{k}"), (F.col("k") * F.col("high")).alias(f"w{k}")]

    both = pairs.join(roots.select(*root(1)), "t1").join(roots.select(*root(2)), "t2")
    larger = F.col("w1") >= F.col("w2")
    ends = [F.when(larger, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("t1", "t2"), ("t2", "t1"))]
    both = both.select(*ends, *[f"{c}{k}" for k in (1, 2) for c in "pblhs"])
    return settle(both.mapInArrow(run, "t1 long, t2 long"), "root-pairs")


def trees(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(tree, blob, links) of (tree, node, text): a row a tree, with the links within it.

    Texts whose set is not the node's are left out: another text under the same id.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out = []
            for tree, node, text in zip(*[c.to_pylist() for c in batch.columns]):
                s = shingles(text or "", known, words)
                if len(s) and set_hash(s) == node:
                    out.append((tree, node, s.astype("<u8").tobytes()))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["tree", "node", "hashes"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("tree", pa.int64()), ("blob", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
        out, size = [], 0
        for rows in _runs(batches):
            each = {r["node"]: r["hashes"] for r in rows}
            one = Tree(np.array(list(each), np.int64), [np.frombuffer(h, "<u8").astype(np.uint64) for h in each.values()])
            links = [{"a": a, "b": b} for a, b in traverse(one, one, percent)] if len(each) > 1 else []
            out.append({"tree": rows[0]["tree"], "blob": one.pack(), "links": links})
            size += len(out[-1]["blob"])
            if size > 1 << 22 or len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    packed = texts.select("tree", "node", "text").mapInArrow(sets, "tree long, node long, hashes binary")
    return packed.repartition("tree").sortWithinPartitions("tree").mapInArrow(build, "tree long, blob binary, links array<struct<a: long, b: long>>")


def met(pairs: DataFrame, built: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the trees of pairs (t1, t2), as many as connect what all of them connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, one = None, None
        for batch in batches:
            links = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != packed:
                    packed, one = x, Tree.unpack(x)
                links += traverse(one, Tree.unpack(y), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    blobs = built.select("tree", "blob")
    # The smaller tree travels to the larger one.
    both = pairs.join(blobs.toDF("t2", "y"), "t2").join(blobs.toDF("t1", "x"), "t1")
    return settle(both.select("x", "y").mapInArrow(run, "a long, b long"), "tree-links")


def _folded(bits: np.ndarray, power: int) -> np.ndarray:
    """A bitmap of fewer bits: neighbours are combined, as fewer leading bits of the hashes would have it."""
    if len(bits) << 6 == 1 << power:
        return bits.astype(np.uint64)
    one = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), bitorder="little")
    return np.packbits(one.reshape(1 << power, -1).any(1), bitorder="little").view("<u8").astype(np.uint64)


def joined(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, frequent: int = FREQUENT, tree: int = TREE) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row a document; component_id is the smallest id reached by links, itself included.

    Two documents link when the overlap of their sets is at least percent of the union. Null, empty and blank texts have no shingles
    and no links. Rows without an id are in no component: null. Of rows with the same id each has the component of its own text, and the
    smallest id of all rows in it. Links are not listed pair by pair: as many are looked for as connect the same documents.
    """
    with _shuffles_go(docs.sparkSession):
        return _joined(docs, doc_id, text, words, percent, frequent, tree)


def _joined(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, frequent: int, tree: int) -> DataFrame:
    spark = docs.sparkSession
    ids = docs.select(common.quoted(doc_id).cast("long").alias("doc_id"), common.quoted(text).alias("text"))
    shared = spark.sparkContext.broadcast(_listed(ids.select("text"), words, SHARE, frequent))
    marked = settle(marks(ids, shared, words, percent), "marks")
    some = marked.filter((F.col("__n") > 0) & F.col("doc_id").isNotNull())
    nodes = settle(some.groupBy("__node").agg(F.min("doc_id").alias("first")), "nodes")
    # One row of each set speaks for it: what is known of a set is the same in all.
    spoken = some.join(nodes.withColumnRenamed("__node", "node"), (F.col("__node") == F.col("node")) & (F.col("doc_id") == F.col("first")), "left_semi")
    rows = settle(spoken.select(F.col("__node").alias("node"), F.posexplode("__first").alias("at", "hash")), "first-hashes")
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    held = settle(rows.join(often, "hash"), "shared-hashes")
    # A node lives with those that share the hash which most nodes share with it: copies of one text come together.
    lives = held.groupBy("node").agg(F.max(F.struct("k", "hash")).alias("most")).select(F.col("node").alias("__node"), F.col("most.hash").alias("home"))
    homes = spoken.join(lives, "__node").select(F.col("__node").alias("node"), "doc_id", F.col("__n").alias("n"), F.col("__power").alias("power"), F.col("__bits").alias("bits"), "home")
    homes = settle(homes, "homes")
    crowds = homes.groupBy("home", "power").agg(F.count(F.lit(1)).alias("k"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / tree))
    placed = settle(homes.join(crowds, ["home", "power"]).select("node", "doc_id", "n", "power", "bits", F.xxhash64("home", "power", part).alias("tree")), "placed")
    roots = settle(signatures(placed), "tree-roots")

    def between(pairs: DataFrame) -> DataFrame:
        """Links within and between trees of pairs: roots meet first, then signatures, then the sets that are left."""
        near = alike(pairs, roots, percent)
        nodes_left = near.select(F.explode("nodes").alias("node")).distinct()
        chosen = placed.join(nodes_left, "node", "left_semi").select("tree", "node", "doc_id")
        built = settle(trees(ids.join(chosen, "doc_id"), words, percent), "trees")
        return built.select(F.inline("links")).union(met(near.filter(F.col("t1") != F.col("t2")).select("t1", "t2"), built, percent))

    # Trees that share a hash: first each with itself and its neighbour in the hash's list, then those that are not connected by that.
    by_hash = settle(held.join(placed.select("node", "tree", "n"), "node").select("hash", "tree", "node", "n", (F.col("n") - F.col("at")).alias("reach")), "hash-trees")
    sizes = [F.min("n").alias("small"), F.max("n").alias("large"), F.max("reach").alias("reach")]
    first = settle(_neighbours(by_hash.groupBy("hash", "tree").agg(*sizes), percent), "next-trees")
    themselves = roots.filter(F.col("k") > 1).select(F.col("tree").alias("t1"), F.col("tree").alias("t2"))
    links = between(root_pairs(first, roots, percent).union(themselves))
    connected = components(links)
    named = by_hash.join(connected, by_hash["node"] == connected["node"], "left").select("hash", "tree", "n", "reach", F.coalesce(connected["root"], by_hash["node"]).alias("root"))
    spread = settle(named.groupBy("hash", "tree").agg(F.min("root").alias("low"), F.max("root").alias("high"), *sizes), "tree-components")
    mixed = spread.groupBy("hash").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count(F.lit(1)).alias("k"))
    open_ = settle(spread.join(mixed.filter((F.col("lowest") != F.col("highest")) & (F.col("k") > 1)).select("hash"), "hash"), "open-trees")
    x, y = [open_.toDF("hash", f"t{k}", f"low{k}", f"high{k}", f"small{k}", f"large{k}", f"reach{k}") for k in (1, 2)]
    apart = (F.least("low1", "low2") != F.greatest("high1", "high2")) & (F.col("t1") < F.col("t2")) & may_meet(percent)
    rest = x.join(y, "hash").filter(apart).select("t1", "t2").distinct().join(first, ["t1", "t2"], "left_anti")
    links = settle(links.union(between(root_pairs(settle(rest, "open-pairs"), roots, percent))), "links")
    connected = components(links).withColumnsRenamed({"node": "__node", "root": "__root"})
    rooted = nodes.join(connected, "__node", "left").select("__node", "first", F.coalesce("__root", "__node").alias("__root"))
    least_id = rooted.join(rooted.groupBy("__root").agg(F.min("first").alias("component_id")), "__root").select("__node", "component_id")
    found = marked.select("doc_id", "__n", "__node").join(least_id, "__node", "left")
    alone = F.when(F.col("__n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("__n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def may_meet(percent: int) -> Column:
    """For sets of two trees that hold a hash (small1, large1, reach1, small2, large2, reach2): whether it could be the first hash of two that are similar.

    small and large are the sizes of a tree's sets, reach is the most hashes that one of them has from this one on. The overlap of two sets
    is at most the smaller of what both have from their first common hash on.
    """
    sized = (100 * F.col("large1") >= percent * F.col("small2")) & (100 * F.col("large2") >= percent * F.col("small1"))
    return sized & ((100 + percent) * F.least("reach1", "reach2") >= percent * (F.col("small1") + F.col("small2")))


def _neighbours(listed: DataFrame, percent: int) -> DataFrame:
    """(t1, t2), t1 < t2: trees next to one another by size in the list of a hash that could meet there, a pair once."""
    after = F.lead(F.struct("tree", "small", "large", "reach")).over(Window.partitionBy("hash").orderBy("small", "tree"))
    mine = [F.col(c).alias(f"{c}1") for c in ("tree", "small", "large", "reach")]
    both = listed.select(*mine, after.alias("after")).filter(F.col("after").isNotNull())
    both = both.select("*", *[F.col(f"after.{c}").alias(f"{c}2") for c in ("tree", "small", "large", "reach")])
    return both.filter(may_meet(percent)).select(F.least("tree1", "tree2").alias("t1"), F.greatest("tree1", "tree2").alias("t2")).distinct()


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it has ended; what it made is settled by then. Else they wait for the driver's garbage collection."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def op13_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its set of four-word shingles and the component that links of 0.85 put it in."""
    return joined(common.table(spark, folder, "documents"))


QUERIES = {"op13_ngram_jaccard": op13_ngram_jaccard}
ORACLES: dict[str, str] = {}
