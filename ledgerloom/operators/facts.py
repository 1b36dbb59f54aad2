"""Stored facts: immutable result rows keyed by source, operation, parameters and segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from ..sources.ledger import Ledger, live
from .ranking import keep_one

IDENTITY = ["source", "operation", "params"]
KEY = [*IDENTITY, "segment"]
PARTITIONS = ["source", "operation", "month"]
STAMPS = ["head", "code_version", "stored_at"]


def stamp(rows: DataFrame, source: str, operation: str, params, segment: str, head=None, code_version: str = "1", stored_at=None) -> DataFrame:
    """Result rows as facts; the month of the segment is the partition."""
    return rows.select(
        F.lit(source).alias("source"),
        F.lit(operation).alias("operation"),
        params.alias("params"),
        F.col(segment).cast("string").alias("segment"),
        *[F.col(c) for c in rows.columns if c != segment],
        (F.lit(None) if head is None else head).cast("string").alias("head"),
        F.lit(code_version).alias("code_version"),
        (F.current_timestamp() if stored_at is None else stored_at).alias("stored_at"),
        F.substring(F.col(segment).cast("string"), 1, 7).alias("month"),
    )


def _stored(ledger: Ledger, state: dict) -> DataFrame | None:
    entries = state["tables"].get("facts")
    if not entries:
        return None
    schema = T.StructType.fromJson(entries[-1]["schema"]).add("put", "string")
    folder = f"{ledger.path}/data/facts"
    rows = ledger.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/put={p}" for p in entries[-1]["puts"]])
    return live(rows, ledger.read("manifest", state), PARTITIONS).drop("put")


def read_facts(spark: SparkSession, path: str) -> DataFrame | None:
    """The facts of the newest whole commit; None if nothing was put yet. Later commits do not change a frame that was read."""
    ledger = Ledger(spark, path)
    return _stored(ledger, ledger.state())


def _any_of(partitions: Iterable[Row]) -> Column:
    """A literal filter for partitions. A filter a source and operation would nest too deep, so they are joined pairwise."""
    months: dict[tuple, list] = {}
    for row in partitions:
        months.setdefault((row[0], row[1]), []).append(row[2])
    equal = lambda name, value: F.col(name).isNull() if value is None else F.col(name) == value
    filters = [F.lit(False)]
    for (s, o), m in months.items():
        month = F.col("month").isin([x for x in m if x is not None])
        filters.append(equal("source", s) & equal("operation", o) & (month | F.col("month").isNull() if None in m else month))
    while len(filters) > 1:
        filters = [reduce(or_, filters[k : k + 2]) for k in range(0, len(filters), 2)]
    return filters[0]


def touched_by(new: DataFrame) -> Column:
    """A literal filter for the partitions that a batch brings."""
    return _any_of(new.select(*PARTITIONS).distinct().collect())


def slices(new: DataFrame, most: int) -> Iterator[Column]:
    """Literal filters for the partitions that a batch brings, `most` partitions each."""
    found = settle(new.select(*PARTITIONS).distinct(), "facts-partitions").toLocalIterator()
    while part := list(islice(found, most)):
        yield _any_of(part)


def put_facts(new: DataFrame, path: str, most: int = 20_000, cursor: int | None = None) -> None:
    """Insert or replace by key, all at once: readers see the table before the batch or after it.

    Inside a batch, and against what is stored, the row stored last wins. Putting the same batch again leaves the table as it is.
    Only the months that the batch touches are read back and written anew, to folders of their own; the batch's partitions become
    literal filters, `most` of them at a time, so the scan of the stored table opens no other partition. One commit then makes the new
    folders, the manifest (count, first and last segment by folder and identity) and the cursor visible together. Of two writers at a
    time the later one fails and has changed nothing.
    """
    spark = new.sparkSession
    ledger = Ledger(spark, path)
    base = ledger.state()
    stored = _stored(ledger, base)
    manifest = ledger.read("manifest", base)
    if stored is None:
        written = [_written(ledger, new)]
    else:
        new = settle(new, "facts-batch")
        written = [_written(ledger, stored.filter(touched).select(*new.columns).unionByName(new.filter(touched))) for touched in slices(new, most)]
    if not written:  # an empty batch moves the cursor only
        ledger.publish(base, {}, cursor=cursor)
        return
    fresh = reduce(DataFrame.union, [_described(ledger, entry) for entry in written])
    if manifest is not None:
        fresh = settle(fresh, "manifest")
        brought = fresh.select(*[F.col(c).alias(f"__{c}") for c in PARTITIONS]).distinct()
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in PARTITIONS))
        fresh = fresh.unionByName(manifest.join(brought, same, "left_anti"))
    entry = ledger.write(fresh.coalesce(1), "manifest")
    puts = [r[0] for r in ledger.read("manifest", {"tables": {"manifest": [entry]}}).select("put").distinct().collect()]  # at most one a batch and slice
    facts = {"put": entry["put"], "puts": puts or [written[-1]["put"]], "level": 0, "schema": written[-1]["schema"]}
    ledger.publish(base, {"facts": [facts], "manifest": [entry]}, cursor=cursor)


def _written(ledger: Ledger, rows: DataFrame) -> dict:
    order = [F.desc("stored_at"), F.desc("code_version"), F.desc_nulls_last("head")]
    return ledger.write(keep_one(rows, KEY, order).hint("rebalance", *PARTITIONS), "facts", *PARTITIONS)


def _described(ledger: Ledger, entry: dict) -> DataFrame:
    """What a folder holds, by partition and identity; reads its key columns only."""
    rows = ledger.read("facts", {"tables": {"facts": [entry]}})
    counted = rows.groupBy("source", "operation", "month", "params").agg(F.count(F.lit(1)).alias("segments"), F.min("segment").alias("first"), F.max("segment").alias("last"))
    return counted.withColumn("put", F.lit(entry["put"]))


def facts_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that puts every batch once: its number is the cursor committed with its rows, and a batch that is in already is passed over."""

    def write(batch: DataFrame, number: int) -> None:
        done = Ledger(batch.sparkSession, path).state()["cursor"]
        if done is None or number > done:
            put_facts(batch, path, cursor=number)

    return write


def facts_before(facts: DataFrame, source: str, operation: str, bound: str) -> DataFrame:
    """Facts of an operation with a segment below the bound, over all its parameter sets."""
    month = bound[:7]
    return facts.filter(
        (F.col("source") == source) & (F.col("operation") == operation) & (F.col("month") <= month) & (F.col("segment") < bound)
    )


def coverage(facts: DataFrame) -> DataFrame:
    """Segments, earliest and latest per identity, without reading any payload column."""
    return facts.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("segments"), F.min("segment").alias("earliest"), F.max("segment").alias("latest")
    )


def stored_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Segments, earliest and latest per identity from the manifest alone: no file of the table is opened."""
    ledger = Ledger(spark, path)
    manifest = ledger.read("manifest", ledger.state())
    if manifest is None:
        return spark.createDataFrame([], "source string, operation string, params string, segments long, earliest string, latest string")
    return manifest.groupBy(*IDENTITY).agg(F.sum("segments").alias("segments"), F.min("first").alias("earliest"), F.max("last").alias("latest"))
