"""Message statistics and period rollups."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import counted_ranks
from ..session import settle
from .ranking import top_k, with_totals


def whole_day_window(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last whole days ending at the head, with the window and whether the source began later."""
    span = df.agg(F.max(day).alias("__hi"), F.min(day).alias("__lo"))
    asked = F.date_sub("__hi", days - 1)
    window = span.select(
        F.greatest(asked, "__lo").alias("window_from"),
        F.col("__hi").alias("window_to"),
        (asked < F.col("__lo")).alias("clamped"),
    )
    return with_totals(df, window).filter(F.col(day) >= F.col("window_from"))


def known_window(df: DataFrame, day: str, days: int, first, last) -> DataFrame:
    """The same window where the source's first and last day are known already: literals, no second look at the rows."""
    if last is None:
        return whole_day_window(df, day, days)
    asked = last - datetime.timedelta(days=days - 1)
    start = max(asked, first)
    window = {"window_from": F.lit(start), "window_to": F.lit(last), "clamped": F.lit(asked < first)}
    return df.filter(F.col(day) >= F.lit(start)).withColumns(window)


def window_summary(messages: DataFrame) -> DataFrame:
    """One row over a window of messages; latencies of matched messages only.

    Whole latencies repeat: messages are counted by outcome, match and latency first, and ranks come from those counts.
    """
    counted = settle(messages.groupBy("outcome", "match_status", "latency").agg(F.count(F.lit(1)).alias("n")), "message-counts")
    number = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    every, done = F.coalesce(F.sum("n"), F.lit(0)), F.col("outcome") == "Success"
    totals = counted.agg(
        every.alias("total"),
        number(done).alias("completed"),
        number(F.col("outcome") == "Failed").alias("failed"),
        (F.try_divide(number(done), every) * 100).alias("success_rate"),
        number(F.col("match_status") == "matched").alias("matched"),
    )
    ranks = {"median_latency": F.expr("n div 2 + 1"), "p95_latency": F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.95)))}
    return with_totals(totals, counted_ranks(counted.groupBy("latency").agg(F.sum("n").alias("m")), "latency", "m", ranks))


def daily_stats(messages: DataFrame, *by: str) -> DataFrame:
    """Completed, failed and unresolved messages per day and further keys."""
    return messages.groupBy("date", *by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "Success").alias("completed"),
        F.count_if(F.col("outcome") == "Failed").alias("failed"),
        F.count_if(F.col("outcome").isNull()).alias("unresolved"),
    )


def busiest_routes(messages: DataFrame, n: int, matched_only: bool = False) -> DataFrame:
    """Top routes with mean latency and delivered share."""
    if matched_only:
        messages = messages.filter(F.col("match_status") == "matched")
    routes = messages.groupBy("origin", "dest").agg(
        F.count(F.lit(1)).alias("messages"),
        (F.sum("latency") / F.count("latency")).alias("mean_latency"),
        (F.count_if(F.col("outcome") == "Success") / F.count(F.lit(1)) * 100).alias("delivered"),
    )
    return top_k(routes, [F.desc("messages"), F.asc("origin"), F.asc("dest")], n)


def rollup_by_period(df: DataFrame, period: Column, keys: Sequence[Column], aggs: Sequence[Column]) -> DataFrame:
    """Any set of measures per period and key."""
    return df.groupBy(period.alias("period"), *keys).agg(*aggs)
