"""Byte-level BPE: whole texts to token ids and back.

A vocabulary maps byte strings to ranks. Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton
over strings finds every token of a piece in one pass. The encoder then walks from the longest token at a position
and goes on to the next one as long as the two are compatible, that is, as long as merging by rank would never join
bytes across their border; otherwise it tries the next shorter token and steps back when none is left. A sequence
whose neighbours are all compatible is the one that the merges give, so the result is exact, in time linear in the piece.
Compatibility is remembered by pair and encodings by piece; both memories are bounded and only save time.
"""

from __future__ import annotations

import base64
import re
import struct

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NEVER = float("inf")
#: Most entries of a worker's memories of pieces and of pairs; a full one starts anew.
PIECES, PAIRS = 200_000, 200_000


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """ids of a piece by a vocabulary given as the bytes of a rank file."""

    def __init__(self, vocabulary: bytes):
        self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.shorter = {rank: next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None) for token, rank in self.ranks.items()}
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}

    def merged(self, piece: bytes) -> list[bytes]:
        """The parts of a piece by merging the lowest rank first, leftmost on ties: the definition, for tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Which parts stand at a token's edge while it is merged, from a byte to the whole, with the rank at which each is absorbed."""
        key = (token, right)
        if key not in self.edges:
            piece, found, absorbed = self.tokens[token], [], NEVER
            while True:
                found.append((self.ranks[piece], absorbed))
                if len(piece) == 1:
                    break
                absorbed = self.ranks[piece]
                piece = self.halves(piece)[right]
            self.edges[key] = found[::-1]
        return self.edges[key]

    def halves(self, piece: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes a token: merge by rank without the token's own rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                raise ValueError(f"token {piece!r} can't be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two tokens.

        The parts facing each other at the border are followed from bytes upwards. They would be joined if their
        merge ranks before the left part is absorbed, and not after the right one is: equal ranks merge leftmost first.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(self.edge(left, True), self.edge(right, False))
        return known

    def _apart(self, lefts: list[tuple[int, float]], rights: list[tuple[int, float]]) -> bool:
        tokens, rank, i, j = self.tokens, self.ranks.get, 0, 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            joined = rank(tokens[a] + tokens[b])
            if joined is not None and joined < a_until and joined <= b_until:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends ascend, so the last one noted is the longest
        shorter, lengths, compatible = self.shorter, self.lengths, self.compatible
        dead = bytearray(n + 1)  # positions from which no way leads on
        ids: list[int] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            while token is not None and (dead[at + lengths[token]] or ids and not compatible(ids[-1], token)):
                token = shorter[token]
            if token is not None:
                ids.append(token)
                at += lengths[token]
                token = longest[at] if at < n else None
            elif ids:
                dead[at] = 1
                last = ids.pop()
                at -= lengths[last]
                token = shorter[last]
            else:
                raise ValueError("no sequence of tokens gives this piece")
        return ids


class Pieces(dict):
    """Packed ids by piece of text, computed when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        ids = self.encoder.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


def latin_pattern(pattern: str) -> str:
    """The same pattern for texts of code points below LATIN, its Unicode classes spelt out, for the faster standard library."""

    def spelt(name: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN) if regex.fullmatch(name, chr(c)))

    def inside(found: regex.Match) -> str:
        return regex.sub(r"\\p\{[LN]\}|\\s", lambda m: spelt(m[0]), found[0]) if found[0][0] == "[" else f"[{'^' * (found[0] == BLACK)}{spelt(WHITE if found[0] == BLACK else found[0])}]"

    return regex.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", inside, pattern)


LATIN, WHITE, BLACK = 0x250, r"\s", r"\S"


class Coder:
    """Texts to packed ids and back; a worker process keeps one."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.key = (vocabulary, pattern)
        self.pieces = Pieces(Encoder(vocabulary))
        self.split = regex.compile(pattern).findall
        self.latin_split = re.compile(latin_pattern(pattern)).findall
        self.beyond = re.compile(f"[^\0-{chr(LATIN - 1)}]").search

    def encode(self, text: str) -> bytes:
        split = self.split if self.beyond(text) else self.latin_split
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.encoder.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_KEPT: list[Coder] = []


def coder(vocabulary: bytes, pattern: str = public_tokenizers.PATTERN) -> Coder:
    if not _KEPT or _KEPT[0].key != (vocabulary, pattern):
        _KEPT[:] = [Coder(vocabulary, pattern)]
    return _KEPT[0]


IDS, DECODED = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, vocabulary: bytes, *, pattern: str = public_tokenizers.PATTERN, text: str = "text", decoded: bool = False) -> DataFrame:
    """`ids` beside the columns of docs: token ids packed as little-endian unsigned 32-bit integers; with decoded, also their bytes.

    Each match of pattern is encoded separately, without special tokens. Null and empty texts have no ids. A column of
    docs that is called ids (or decoded) gives way. Nothing is shuffled; the vocabulary, of a fixed size, goes to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        one = coder(shared.value, pattern)

        def run(texts: list[str]) -> list[list]:
            ids = [one.encode(t) for t in texts]
            return [ids, [one.decode(i) for i in ids]] if decoded else [ids]

        return run

    return common.map_texts(docs, make, [IDS, DECODED] if decoded else [IDS], text=text)


def decode(frame: DataFrame, vocabulary: bytes, *, ids: str = "ids") -> DataFrame:
    """`decoded` beside the columns of frame: the bytes of packed ids; null ids give no bytes, an id outside the vocabulary fails."""
    shared = frame.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        one = coder(shared.value)
        return lambda packed: [[one.decode(base64.b64decode(p)) for p in packed]]

    held = frame.withColumn("__packed", F.base64(common.quoted(ids)))
    return common.map_texts(held, make, [DECODED], text="__packed", keep=frame.columns)


def token_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents: counts and digests of ids and of what they decode to."""
    vocabulary = read_vocabulary(public_tokenizers.path(VOCABULARY))
    coded = encode(docs.select("doc_id", "text"), vocabulary, decoded=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(common.table(spark, folder, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
