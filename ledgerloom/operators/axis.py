"""Calendar axes and dense series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_axis(df: DataFrame, day: str) -> DataFrame:
    """Every day from the first to the last one present."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter(F.col("lo").isNotNull())
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))


def dense(df: DataFrame, day: str, fills: dict[str, object], keys: DataFrame | None = None) -> DataFrame:
    """Left join of a daily frame onto its axis; `fills` name the columns whose gaps become a value.

    With `keys` (a small dimension of distinct series) each series gets its own row on every day.
    """
    axis = day_axis(df, day)
    on = [day]
    if keys is not None:
        span = axis.agg(F.sort_array(F.collect_list(day)).alias("days")).scalar()
        axis = keys.withColumn("__days", span).select(*keys.columns, F.explode("__days").alias(day))
        on = [*keys.columns, day]
    return axis.join(df, on, "left").fillna(fills) if fills else axis.join(df, on, "left")


def running(df: DataFrame, order: Sequence[Column], value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Running sum over an already aggregated frame."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(window))


def months_between(df: DataFrame, day: str) -> DataFrame:
    """Month frames of the span: first day, last day, number of days."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter(F.col("lo").isNotNull())
    first = F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")))
    return span.select(first.alias("first_day")).select(
        F.date_format("first_day", "yyyy-MM").alias("month"),
        "first_day",
        F.last_day("first_day").alias("last_day"),
        F.dayofmonth(F.last_day("first_day")).cast("bigint").alias("days"),
    )


def settled_months(months: DataFrame, now: Column, head: Column, delay_hours: int, floors: DataFrame | None = None, source: str = "source") -> DataFrame:
    """A month is settled once its end lies `delay_hours` back on the clock and the source has passed it.

    With floors (source, floor day; one row a source, a small dimension) months also carry their source: months that begin below its floor,
    months of a source without one, and texts that are no month (`YYYY-MM`) are refused instead of settled, and `refused` says why.
    """
    delay = F.expr(f"interval {int(delay_hours)} hours")
    if floors is None:
        end = F.date_add("last_day", 1).cast("timestamp")
        return months.withColumn("settled", (now >= end + delay) & (head >= end))
    known = floors.select(F.col(source).alias("__source"), F.col("floor").alias("__floor"))
    joined = months.join(known, F.col(source) == F.col("__source"), "left")
    first = F.when(F.col("month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.try_to_date(F.concat("month", F.lit("-01")), "yyyy-MM-dd"))
    end = F.add_months(first, 1).cast("timestamp")
    refused = F.when(F.col("__source").isNull(), "unknown source").when(first.isNull(), "malformed month").when(first < F.col("__floor"), "below floor")
    settled = F.coalesce(refused.isNull() & (now >= end + delay) & (head >= end), F.lit(False))
    return joined.withColumn("refused", refused).withColumn("settled", settled).drop("__source", "__floor")


def fill_forward(dense_df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Last known value on or before each day; nothing before the first observation."""
    window = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return dense_df.withColumn(value, F.last(value, ignorenulls=True).over(window))


def zero_after_first(dense_df: DataFrame, keys: Sequence[str], day: str, value: str, present: str) -> DataFrame:
    """A series that dropped out is zero, one that has not begun is unknown, a day nobody read is unknown."""
    first = F.min(F.when(F.col(value).isNotNull(), F.col(day))).over(Window.partitionBy(*keys))
    filled = F.when(~F.col(present), F.lit(None)).when(F.col(day) < first, F.lit(None)).otherwise(
        F.coalesce(F.col(value), F.lit(0))
    )
    return dense_df.withColumn("__first", first).withColumn(
        value, F.when(F.col("__first").isNull(), F.lit(None)).otherwise(filled)
    ).drop("__first")


def peaks(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Largest value, the first day reaching it, last known value and its day."""
    known = F.col(value).isNotNull()
    ahead = F.struct(F.col(value), -F.unix_date(day))
    return df.groupBy(*keys).agg(
        F.max(value).alias("peak"),
        F.max_by(F.when(known, F.col(day)), F.when(known, ahead)).alias("peak_on"),
        F.max_by(F.when(known, F.col(value)), F.when(known, F.col(day))).alias("last"),
        F.max(F.when(known, F.col(day))).alias("last_on"),
    )


def carried(closes: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Sparse closes as intervals (from_day, to_day): each holds until the day before the next one, the last one until the last day of all."""
    last = closes.agg(F.max(day).alias("last")).scalar()
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    return closes.withColumn("from_day", F.col(day)).withColumn("to_day", F.coalesce(F.date_sub(following, 1), last))


def sparse_peaks(closes: DataFrame, read: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Peak and last value of series that are 0 after dropping out, from their closes alone; values must not be negative.

    On a read day from its first close on, a series has its close or else 0; unread days say nothing. closes(key, day, value), read(day).
    """
    days = read.agg(F.sort_array(F.collect_set(day)).alias("days")).scalar()  # bounded by the calendar
    spoken = closes.join(read.select(day).withColumn("__read", F.lit(True)), day, "left")
    seen = F.col("__read").isNotNull()
    folded = spoken.groupBy(key).agg(
        F.min(day).alias("__first"),
        F.max(F.when(seen, F.col(value))).alias("__most"),
        F.min_by(day, F.when(seen, F.struct(-F.col(value), F.col(day)))).alias("__most_on"),
        F.max(F.when(seen, F.col(day))).alias("__last_close"),
        F.max_by(value, F.when(seen, F.col(day))).alias("__last"),
    ).withColumn("__days", days)
    from_first = F.filter("__days", lambda d: d >= F.col("__first"))
    told = folded.withColumn("__next", F.get(from_first, F.lit(0))).withColumn("__end", F.when(F.col("__next").isNotNull(), F.element_at("__days", -1)))
    some = F.col("__next").isNotNull()
    above = F.coalesce(F.col("__most") > 0, F.lit(False))
    zero = F.lit(0).cast(closes.schema[value].dataType)
    return told.select(
        key,
        F.when(some, F.when(above, F.col("__most")).otherwise(zero)).alias("peak"),
        F.when(some, F.when(above, F.col("__most_on")).otherwise(F.col("__next"))).alias("peak_on"),
        F.when(some, F.when(F.col("__last_close") == F.col("__end"), F.col("__last")).otherwise(zero)).alias("last"),
        F.when(some, F.col("__end")).alias("last_on"),
    )


def prefer(stored: DataFrame, tail: DataFrame, keys: Sequence[str], winner: str) -> DataFrame:
    """Stored history and live tail with the stated side winning on a shared key."""
    if winner not in ("stored", "tail"):
        raise ValueError("winner is 'stored' or 'tail'")
    both = stored.withColumn("origin", F.lit("stored")).unionByName(tail.withColumn("origin", F.lit("tail")))
    values = [c for c in both.columns if c not in keys]
    best = F.max_by(F.struct(*values), (F.col("origin") == winner).cast("int")).alias("v")
    return both.groupBy(*keys).agg(best).select(*keys, "v.*")


def missing_days(df: DataFrame, day: str) -> DataFrame:
    """Days inside the span without a row."""
    return day_axis(df, day).join(df.select(day).distinct(), day, "left_anti")


def month_rollup(days: DataFrame, day: str) -> DataFrame:
    """Monthly sums over a daily axis with `trades`, `legs`, `usd` and `origin` columns."""
    return days.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("days"),
        F.count("trades").alias("present"),
        F.count_if(F.col("origin") == "stored").alias("stored"),
        F.count_if(F.col("origin") == "tail").alias("counted"),
        F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"),
        F.coalesce(F.sum("legs"), F.lit(0)).alias("legs"),
        F.sum("usd").alias("usd"),
        F.count("usd").alias("usd_days"),
    )
