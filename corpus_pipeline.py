"""A training corpus from raw documents: toxic ones go, shared lines go, one of each group of near copies stays, sources are mixed
to their target weights, and what is left is encoded.

Every stage takes the documents that the one before it kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common, line_dedup, mixing, simhash, toxicity
from ledgerloom.session import settle


def _texts(docs: DataFrame) -> DataFrame:
    common.prepare(docs.sparkSession)
    return docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold; the model learns from the labels of these documents."""
    docs = _texts(docs)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="__toxic").filter(F.col("__toxic") < toxicity.THRESHOLD).drop("__toxic")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text. All documents stay, if need be with an empty text."""
    kept = line_dedup.dedup(_texts(docs)).drop("n_lines", "n_dropped")
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that SimHash links."""
    return simhash.keep_one(_texts(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.mixed(_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): a row for each document taken, ids packed as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(_texts(docs).select("doc_id", "source", "text"), bpe.read_vocabulary(public_tokenizers.path(bpe.VOCABULARY)))
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores, whole-text fingerprints and token ids are beyond SQL; the tests rebuild the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again as the next stage's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
