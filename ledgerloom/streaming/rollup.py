"""Streams: daily rollups that settle once, late rows, idempotent sinks, bounded ingest, order life cycles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import keep_one
from ..session import settle
from ..sources.ledger import read_written


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a landing folder as a stream, at most so many new files per batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # A table that is one file: its folder, and of that the one name.
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def settled_days(stream: DataFrame, at: str, delay: str, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """One row per day and key, given out once: when the newest event lies `delay` behind the day's end.

    Spark drops rows behind its watermark; `settlement.DaySettlement` keeps them apart and also waits for the clock.
    """
    window = F.window(at, "1 day")
    return (
        stream.withWatermark(at, delay)
        .groupBy(window.alias("w"), *keys)
        .agg(*[measure.alias(name) for name, measure in measures.items()])
        .select(F.to_date("w.start").alias("day"), *keys, *measures)
    )


def replace_partitions(path: str, *partition_by: str) -> Callable[[DataFrame, int], None]:
    """Sink that replaces the partitions a batch brings, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        (
            batch.hint("rebalance", *partition_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partition_by)
            .parquet(path)
        )

    return write


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take everything that has landed, in batches, and stop; the checkpoint is the cursor for the next run."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that adds every batch as a partition of its own; the same batch again replaces that partition."""

    def write(batch: DataFrame, number: int) -> None:
        replace_partitions(path, "batch")(batch.withColumn("batch", F.lit(number)), number)

    return write


def drop_redelivered(stream: DataFrame, key: Sequence[str], at: str, delay: str) -> DataFrame:
    """Each id once, as long as its copies arrive within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def month_sink(days_path: str, months_path: str) -> Callable[[DataFrame, int], None]:
    """Day rows as they settle; a month is passed on when every one of its days is there.

    Only the months a batch touches are read back, and a day delivered again replaces itself.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = settle(batch.withColumn("month", F.date_format("day", "yyyy-MM")).withColumn("fresh", F.lit(1)), "month-batch")
        stored = read_written(spark, days_path)
        if stored is not None:
            months = [r[0] for r in rows.select("month").distinct().collect()]  # bounded by the calendar
            touched = stored.filter(F.col("month").isin(months))
            rows = rows.unionByName(touched.select(*batch.columns, "month").withColumn("fresh", F.lit(0)))
        days = settle(keep_one(rows, ["month", "day"], [F.desc("fresh")]).drop("fresh"), "month-days")
        replace_partitions(days_path, "month")(days, _)
        sums = [F.sum(c).alias(c) for c in batch.columns if c != "day"]
        length = F.dayofmonth(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
        whole = days.groupBy("month").agg(F.count(F.lit(1)).alias("days"), *sums).filter(F.col("days") == length)
        replace_partitions(months_path, "month")(whole, _)

    return write


def newest_per_source(stream: DataFrame, source: str, at: str) -> DataFrame:
    """Head of every source so far; run in complete or update mode."""
    return stream.groupBy(source).agg(F.max(at).alias("head_at"), F.count(F.lit(1)).alias("rows"))


def life_cycle(placed: DataFrame, filled: DataFrame, delay: str, within: str) -> DataFrame:
    """Fills of each order with their latency. The time bound lets both sides' state expire.

    placed(order_id, placed_at), filled(order_id, filled_at).
    """
    p = placed.withWatermark("placed_at", delay)
    f = filled.withWatermark("filled_at", delay).withColumnRenamed("order_id", "filled_order")
    bound = (
        (F.col("order_id") == F.col("filled_order"))
        & (F.col("filled_at") >= F.col("placed_at"))
        & (F.col("filled_at") <= F.col("placed_at") + F.expr(f"interval {within}"))
    )
    latency = F.unix_seconds("filled_at") - F.unix_seconds("placed_at")
    return p.join(f, bound).drop("filled_order").withColumn("latency_s", latency)
