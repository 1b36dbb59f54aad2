"""Checks that keep a figure honest: outliers, coverage, freshness, expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import middles
from ..session import settle
from .ranking import with_totals


def outlier_cuts(histogram: DataFrame, key: str, digits: str, n: str, decades: int = 4, support: int = 5, share: float = 0.2) -> DataFrame:
    """Per key the digit count from which amounts are detached from the rest, or NULL.

    Only the highest gap of `decades` counts, and only while the rows above it are a small part of all rows.
    The histogram has one row per key and digit count, so its windows are tiny.
    """
    low = Window.partitionBy(key).orderBy(digits)
    high = Window.partitionBy(key).orderBy(F.desc(digits)).rowsBetween(Window.unboundedPreceding, 0)
    steps = histogram.withColumn("__gap", F.col(digits) - F.lag(digits).over(low)).withColumn("__above", F.sum(n).over(high))
    gap = F.col("__gap") >= decades
    top = F.max(F.when(gap, F.struct(F.col(digits).alias("at"), F.col("__above").alias("above"))))
    found = steps.groupBy(key).agg(F.sum(n).alias("support"), top.alias("top"))
    small = (F.col("support") >= support) & (F.col("top.above") <= F.col("support") * share)
    return found.select(key, "support", F.when(small, F.col("top.at")).alias("cut"))


def flag_outliers(rows: DataFrame, ceiling: float, support: int = 5) -> DataFrame:
    """Every row with the first reason to leave it out, and what it was compared with.

    rows(symbol, digits, decimals, usd): decimals other than the symbol's usual ones, then detached magnitude,
    then a value above the ceiling.
    """
    counted = settle(rows.groupBy("symbol", "digits", "decimals").agg(F.count(F.lit(1)).alias("n")), "outlier-counts")
    histogram = counted.groupBy("symbol", "digits").agg(F.sum("n").alias("n"))
    by_decimals = counted.filter(F.col("decimals").isNotNull()).groupBy("symbol", "decimals").agg(F.sum("n").alias("n"))
    usual = by_decimals.groupBy("symbol").agg(F.min_by("decimals", F.struct(-F.col("n"), F.col("decimals"))).alias("usual_decimals"))
    profile = outlier_cuts(histogram, "symbol", "digits", "n", support=support).join(usual, "symbol", "left")
    comparable = F.col("support") >= support
    reason = (
        F.when(comparable & (F.col("decimals") != F.col("usual_decimals")), "decimals-disagree")
        .when(F.col("digits") >= F.col("cut"), "magnitude-outlier")
        .when(F.col("usd") > ceiling, "over-ceiling")
    )
    return rows.join(profile, "symbol", "left").withColumn("reason", reason)


def daily_grid(rows: DataFrame, day: str, chain: str, value: str) -> DataFrame:
    """Rows, chains, zero and unknown values per day. Zero and unknown are never folded into each other."""
    cells = rows.groupBy(day, chain).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(value) == 0).alias("zero_rows"),
        F.count_if(F.col(value).isNull()).alias("null_rows"),
    )
    return cells.groupBy(day).agg(
        F.sum("rows").alias("rows"), F.count(chain).alias("chains"), F.sum("zero_rows").alias("zero_rows"), F.sum("null_rows").alias("null_rows")
    )


def truncation(grid: DataFrame, day: str, cap: int, requested_to: str | None) -> DataFrame:
    """Was the read cut? True when exactly the cap came back short of the requested end; NULL when nobody can tell."""
    end = F.lit(requested_to).cast("date")
    totals = grid.agg(F.sum("rows").alias("rows"), F.min(day).alias("covered_from"), F.max(day).alias("covered_to"), F.count(F.lit(1)).alias("days"))
    at_cap = F.col("rows") == cap
    short = F.when(end.isNotNull(), F.col("covered_to") < end)
    truncated = F.when(short.isNull(), F.when(at_cap, F.lit(None).cast("boolean")).otherwise(F.lit(False))).otherwise(at_cap & short)
    return totals.select(
        "rows", "covered_from", "covered_to", "days", at_cap.alias("at_cap"), truncated.alias("truncated")
    )


def partial_tail(grid: DataFrame, day: str, entities: str, before: int = 7) -> DataFrame:
    """Is the last day thinner than the median of the days just before it? Works on the daily frame."""
    recent = settle(grid.select(day, entities).orderBy(F.desc(day)).limit(before + 1), "tail-days")
    last = recent.agg(F.max(day).alias("last_day"), F.max_by(entities, day).alias("last_count"))
    earlier = with_totals(recent, last).filter(F.col(day) < F.col("last_day"))
    med = middles(earlier, [], entities).select(((F.col("lower") + F.col("upper")) / 2).alias("typical"))
    return with_totals(last, med).withColumn("partial", F.col("last_count") < F.col("typical"))


def freshness(
    events: DataFrame, expected: DataFrame, source: str, at: str, observed: Column, stale_ms: int = 900_000, frozen_ms: int = 86_400_000, unreachable: Column | None = None
) -> DataFrame:
    """State per expected source from its newest event; a source without events is unknown."""
    heads = events.groupBy(source).agg(F.min(at).alias("covers_from"), F.max(at).alias("head_at"))
    lag = F.unix_millis(observed) - F.unix_millis("head_at")
    down = F.lit(False) if unreachable is None else F.coalesce(unreachable, F.lit(False))
    state = (
        F.when(down, "unreachable")
        .when(F.col("lag_ms").isNull(), "unknown")
        .when(F.col("lag_ms") >= frozen_ms, "frozen")
        .when(F.col("lag_ms") >= stale_ms, "stale")
        .otherwise("live")
    )
    return (
        expected.join(heads, source, "left")
        .withColumn("lag_ms", lag)
        .withColumn("state", state)
        .withColumn("clock_skew", F.coalesce(F.col("lag_ms") < -300_000, F.lit(False)))
    )


# Severity of the states, worst last.
SEVERITY = {"live": 0, "unknown": 1, "stale": 2, "unreachable": 3, "frozen": 4}


def worst_state(reports: DataFrame, source: str) -> DataFrame:
    """Sources per state and the worst of all."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(r)) for s, r in SEVERITY.items()])
    return reports.groupBy("state").agg(F.count(F.lit(1)).alias("sources"), F.min(source).alias("first_source"), F.max(rank).cast("bigint").alias("severity"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking each named expectation. An expectation that is NULL counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("broken")) for n in checks]))
    return counts.select(pairs.alias("p")).select("p.check", "p.broken").withColumn("holds", F.col("broken") == 0)


def require(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The same frame, failing on the first row that breaks an expectation, with its name in the error."""
    out = df
    for name, condition in checks.items():
        broken = ~F.coalesce(condition, F.lit(False))
        out = out.filter(F.when(broken, F.raise_error(F.lit(f"expectation broken: {name}"))).otherwise(F.lit(True)))
    return out


def count_check(read: DataFrame, claimed: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Rows read beside rows the source claims, per key."""
    have = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_read"))
    return claimed.join(have, list(keys), "full_outer").select(
        *keys,
        F.coalesce(expected, F.lit(0)).alias("claimed"),
        F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        (F.coalesce(expected, F.lit(0)) == F.coalesce("rows_read", F.lit(0))).alias("complete"),
    )


def numbering_gaps(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Is the numbering of each key consecutive? count = last − first + 1 over distinct numbers."""
    distinct = rows.select(*keys, number).distinct()
    return distinct.groupBy(*keys).agg(
        F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("present")
    ).withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("present"))


def durability(facts: DataFrame, floor: DataFrame, segment: str, has_content: Column) -> DataFrame:
    """Stored days below the source's floor that hold content can no longer be derived again.

    `floor` is a frame with one column and at most one row; without a floor the state is unknown, never ok.
    """
    marked = facts.withColumn("__floor", floor.scalar())
    below = F.col(segment) < F.col("__floor")
    lost = below & has_content
    totals = marked.agg(
        F.max("__floor").alias("floor"),
        F.count_if(below).alias("stored_below"),
        F.count_if(lost).alias("at_risk"),
        F.min(F.when(lost, F.col(segment))).alias("earliest"),
        F.max(F.when(lost, F.col(segment))).alias("latest"),
    )
    state = F.when(F.col("floor").isNull(), "unknown").when(F.col("at_risk") > 0, "at-risk").otherwise("ok")
    return totals.withColumn("state", state)


def cohort_check(seed: DataFrame, ident: str, amount: str, declared: DataFrame) -> DataFrame:
    """Well-formed ids, no duplicates, declared total equal to the sum."""
    per_id = seed.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("s"))
    totals = per_id.agg(
        F.sum("n").alias("rows"),
        F.count_if(~F.col(ident).rlike("^[0-9a-f]{64}$")).alias("malformed"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        F.sum("s").alias("total"),
    )
    return totals.withColumn("declared", declared.scalar()).withColumn("total_matches", F.col("total") == F.col("declared"))
