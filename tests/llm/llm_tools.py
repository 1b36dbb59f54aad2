"""Frames and brute-force versions that several tests share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Texts that every operator has to bear: none, empty, blank, one word, no letter, odd characters, very long.
HARD = [None, "", " \n\t ", "word", "123 456!!", "ünïcödé ß    中文 😀", "a" * 30_000, "many words " * 20_000, "\n" * 500, "x\r\ny\x0b\x0cz"]


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def hard(spark):
    """The hard texts, some of them twice, with null and repeated ids and columns that clash with results and helper names."""
    docs = documents(spark, HARD + ["word", None])
    more = spark.createDataFrame([(None, "no id at all", "en", "s1", 3), (3, "word", "en", "s1", 4), (3, "another text", "en", None, 4)], DOCS)
    frame = docs.union(more)
    for name in ("ids", "Decoded", "fp", "score", "spans", "n_words", "kept", "lines", "size", "idx", "line", "key", "target", "gone", "at", "h1", "component_id", "lang_pred", "taken", "a", "b"):
        frame = frame.withColumn(name, frame["lang"])
    return frame


def write_tables(folder, documents_rows, labels=None, embeddings=None):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in documents_rows], schema=kinds), f"{folder}/documents.parquet")
    kinds = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in labels or []], schema=kinds), f"{folder}/labels.parquet")
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in embeddings or []], schema=kinds), f"{folder}/embeddings.parquet")
    return str(folder)
