"""What several operators share: reading tables, whole-text Python steps, the held-out split."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space of every contract here: space and the controls 9 to 13. bytes.split() splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch. Whole texts travel in them, so their memory is bounded by both.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: What these plans rely on: hot keys of joins are split, also below an aggregation.
ADAPTIVE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in {**BATCH, **ADAPTIVE}.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[Any]]]], fields: list[T.StructField], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns computed from whole texts, one Arrow batch at a time, beside the columns kept.

    make() runs once a task and gives a function from a batch's texts (null: empty) to one list a field.
    A kept column that has the name of a field gives way to it.
    """
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in taken]
    base = df.select(*[quoted(c) for c in kept], F.coalesce(quoted(text), F.lit("")).alias("__whole_text"))
    schema = T.StructType([*[base.schema[c] for c in kept], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            columns = fn(batch.column(len(kept)).to_pylist())
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], [*kept, *names])

    return base.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """At most about `rows` rows, the same on every run: those whose key hashes lowest."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < share)
