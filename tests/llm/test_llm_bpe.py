"""Byte-level BPE beside the tiktoken library."""

import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import HARD, documents, hard

from ledgerloom.llm import bpe

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def packed(text):
    ids = REFERENCE.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_encoded_as_the_library_does(text):
    one = bpe.coder(VOCABULARY)
    assert one.encode(text) == packed(text)
    assert one.decode(one.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehtn rstio'.\n\téß² \x1c=-", max_size=400))
def test_texts_of_few_letters(text):
    assert bpe.coder(VOCABULARY).encode(text) == packed(text)


def test_edges_ascend_and_every_token_is_its_own_encoding():
    encoder = bpe.coder(VOCABULARY).pieces.encoder
    for token, piece in list(encoder.tokens.items())[::7]:
        for side in (False, True):
            until = [u for _, u in encoder.edge(token, side)]
            assert until == sorted(until)
        assert encoder.merged(piece) == [piece]


def test_pieces_without_end_and_bounded_memories(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 10)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    one = bpe.Coder(VOCABULARY, public_tokenizers.PATTERN)
    for text in ("a" * 20_000, "ab" * 9_000, "=" * 5_000, "中文" * 2_000, "thequickbrownfox" * 900):
        assert one.encode(text) == packed(text)
    assert len(one.pieces) <= 10 and len(one.pieces.encoder.pairs) <= 10


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(b"YQ== 0\n")


def test_hard_rows_keep_their_columns(spark):
    docs = hard(spark)
    rows = bpe.encode(docs, VOCABULARY).collect()
    assert len(rows) == docs.count()
    assert all(r["ids"] == packed(r["text"] or "") for r in rows)
    again = bpe.decode(bpe.encode(docs.select("doc_id", "text"), VOCABULARY), VOCABULARY).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again)
    assert bpe.encode(docs.limit(0), VOCABULARY).collect() == []


def test_digests_of_documents(spark):
    for r in bpe.token_digests(documents(spark, HARD)).collect():
        text = HARD[r["doc_id"]] or ""
        assert r["n_tokens"] == len(packed(text)) // 4
        assert r["ids_sha256"] == hashlib.sha256(packed(text)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_query_over_the_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = bpe.op1_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    assert all(r["ids_sha256"] == hashlib.sha256(packed(texts[r["doc_id"]])).hexdigest() for r in rows)
