"""Readers for landed text: balance CSV, label CSV, newline-delimited blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

BALANCE_SCHEMA = "address string, block_number bigint, balance decimal(38,0), timestamp string"
BLOCK_SCHEMA = (
    "header struct<number:bigint,timestamp:bigint>, "
    "events array<struct<name:string,args:string>>, _corrupt string"
)


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    """Balance observations; the header must carry the schema's names. The day is the timestamp's first ten characters,
    because precisions differ from row to row."""
    prepare(spark)
    rows = (
        spark.read.schema(BALANCE_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.select(
        "address",
        F.col("block_number").alias("block"),
        "balance",
        F.to_date(F.substring("timestamp", 1, 10)).alias("day"),
    )


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, address, usable, line): every line that is not blank, split at the first comma; one without a comma is not usable."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    usable = F.col("value").contains(",")
    part = lambda k: F.when(usable, F.regexp_extract("value", r"^([^,]*),(.*)$", k))
    return lines.select(part(1).alias("name"), F.trim(part(2)).alias("address"), usable.alias("usable"), F.col("value").alias("line"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Usable labels: what follows the first comma may contain commas. `read_label_lines` also shows the lines that are left out."""
    return read_label_lines(spark, path).filter("usable").select("name", "address")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited blocks. Lines without a number or timestamp stay visible as `usable` = false."""
    rows = spark.read.schema(BLOCK_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    usable = F.col("header.number").isNotNull() & F.col("header.timestamp").isNotNull()
    return rows.select(
        F.col("header.number").alias("number"),
        F.col("header.timestamp").alias("timestamp"),
        "events",
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.col("_corrupt").isNotNull().alias("corrupt"),
    )


def write_series(df: DataFrame, path: str, *partition_by: str) -> None:
    """Archive dataset, one folder per partition value."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
